"""Necessary conditions are checked for batches of texts; the engine runs patterns only, on what is left."""

from pyspark.sql import functions as F

from tests.test_key_words import AWKWARD
from veilframe.functions.prefilter import in_re2, near_rules, needs
from veilframe.functions.recognizers import RECOGNIZERS, Recognizer, custom_recognizer
from veilframe.operators import detect as D
from veilframe.plans.fixtures import SENTENCES

MORE = [
    "logın: a password: b", "LOGİN = a pass = b", "ıd number: AB1234 number", "mrn number ID number: AB12345", "policy no. AB1234", "uſer: abc", "@abc", "x\n@abc d",
    "Nov 7, 2024", "1/2/24", "11/2/2443", "١٢٣-٤٥-٦٧٨٩", "pay +1 555 123 4567", "35 209900 176148 1", "35209900176148 1", "Kpassword: x", "a" * 40 + ".com", "=;=;=;", "a=b;c=d;e=f;",
]


def test_batches_and_engine_agree(spark):
    """Same spans whether the conditions are checked in Arrow batches, in the engine, or by bare patterns."""
    texts = AWKWARD + MORE + [f"{s} {t}{s}" for i, t in enumerate(AWKWARD + MORE) for s in SENTENCES[i % 7 :: 7]] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    spans = lambda d: {tuple(r) for r in D.explode_spans(d, "id").select("id", "pii_type", "start", "end").collect()}
    batches, engine = spans(D.find_spans(df, out="spans")), spans(D.find_spans(df, out="spans", in_engine=True))
    assert batches == engine and len({x[1] for x in batches}) == len(RECOGNIZERS)
    bare = spans(D.find_spans(df, recognizers=[Recognizer(r.pii_type, r.confidence, r.pattern, validator=r.validator) for r in RECOGNIZERS], out="spans"))
    odd = {i for i, t in enumerate(texts) if t and ("ı" in t or "İ" in t)}
    assert batches <= bare and {x for x in bare - batches if x[0] not in odd} == set()


def test_engine_runs_no_condition_over_the_texts(spark):
    """Key words, number runs and guards used to be searched in every text by the engine's backtracking patterns."""
    plan = D.detect(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "RLIKE(text" not in plan and "lower(text" not in plan


def test_near_rules_are_few(spark):
    """Only rules that can match are named: one for most planted sentences, and no number or login rule for look-alikes."""
    rows = [(i, s) for i, s in enumerate(SENTENCES)] + [(99, "a large number of members, twelve users; health; the policies")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("near", near_rules(F.col("text"), RECOGNIZERS))
    near = {r.id: r.near for r in df.collect()}
    assert all(i in near[i] for i in range(len(SENTENCES))) and near[99] == []
    assert sum(map(len, near.values())) <= 2 * len(SENTENCES)


def test_conditions_beyond_re2_are_left_out(spark):
    odd = Recognizer("X", 0.9, r"ab\d", words=("ab",), guard=r"a(?=b)")
    assert needs(odd) == [p for p in needs(Recognizer("X", 0.9, "x", words=("ab",)))] and needs(custom_recognizer("Y", "y", 0.9)) == []
    assert in_re2(r"\d[\s.]\s\.[\]\\\u017F]") == r"\p{Nd}[\t-\r \x{85}\p{Z}.][\t-\r \x{85}\p{Z}]\.[\]\\\x{017F}]"
    df = spark.createDataFrame([(1, "ab1 y"), (2, "zab2")], "id int, text string")
    spans = D.explode_spans(D.find_spans(df, recognizers=[odd, custom_recognizer("Y", "y", 0.9)], out="spans"), "id")
    assert {(r.id, r.pii_type) for r in spans.collect()} == {(1, "X"), (1, "Y")}


def test_bytes_that_are_no_text(spark):
    """A word behind a broken byte is found, as the engine sees a replacement character there."""
    df = spark.range(1).select(F.concat(F.unhex(F.lit("C3")), F.lit("password: x1").cast("binary")).cast("string").alias("text"))
    found = [D.find_spans(df, out="s", in_engine=e).select(F.transform("s", lambda s: s["pii_type"])).first()[0] for e in (True, False)]
    assert found[0] == found[1] == ["CREDENTIAL_PASSWORD"]
