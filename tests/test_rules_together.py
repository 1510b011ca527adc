"""Rules of a table searched together: nothing moves, and the matches are those of the engine."""

import random

from pyspark.sql import functions as F

from veilframe.functions.agreed import BLIND, agreed
from veilframe.functions.literals import leading_literals
from veilframe.operators import rule_table as R
from veilframe.operators.detect import detect, explode_spans

PARTS = ["a", "b", "(?:a|)", "(?:|b)", "ab", "[ab]", "[a-c]{2}", "(?:ab|ba)", "(?:a|bc|abc)", "(b|ab)", "b?", "a*", "a+?", "b{1,2}", "c{2,}", "s", "k", "i", "[is]", " ", r"\."]
ODD = [r"\d", r"\bab", "(?:ab)+", "[^a]", ".", "a++", "(?=a)b", "a$", "(?i)a(?-i)b", r"\w", "[a-z&&[b]]", "a{2}{2}", "a|", "é", "a**", "[b-a]", "(a", "a)", "(?i:a)"]


def _patterns(rng, n):
    for _ in range(n):
        one = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 5)))
        yield rng.choice(["", "", "(?i)"]) + rng.choice(["", "", "", "^"]) + "|".join(one() for _ in range(rng.choice([1, 1, 2, 3])))


def test_odd_patterns_are_left_to_the_engine():
    assert [p for p in ODD if agreed(p)] == []
    assert agreed("(?i)ab[rn]{2}")[1] and agreed("^10[0-9]-|a[a-z]*@b") and not agreed("a*")


def test_python_and_the_engine_find_the_same(spark):
    rng = random.Random(11)
    patterns = sorted({p for p in _patterns(rng, 400) if agreed(p)})
    texts = ["".join(rng.choice("aabbccsSkKiI .ABCé本\U0001F600") for _ in range(rng.randrange(30))) for _ in range(40)]
    rows = spark.createDataFrame(patterns, "string").crossJoin(spark.createDataFrame(texts, "string").withColumnRenamed("value", "text"))
    got = rows.select("value", "text", F.regexp_extract_all("text", F.concat(F.lit("(?U)"), F.col("value")), F.lit(0)).alias("m")).collect()
    hits = 0
    for r in got:
        found = [m[0] for m in agreed(r["value"])[0].finditer(r.text)]
        assert found == r.m, (r["value"], r.text)
        lead = leading_literals(r["value"])
        assert lead is None or all(any(f.lower().startswith(x) for x in lead) for f in found), (r["value"], lead)
        hits += len(found)
    assert len(patterns) > 200 and hits > 5000


def test_spans_equal_those_of_plan_constants(spark):
    deny = ["(?i)ski[ts]{1,2}", "ab[a-c]*b", "(?:tion|sch)[a-z]", "th[a-z]{2,4}e ", "aa", r"\bab+", "[ab]{3}", "é+a", "b{2,}a?"]
    allow = ["^10[0-9]-|abb", "(?i)KIT", r"7{3}\b"]
    rng = random.Random(3)
    words = ["skit", "SKIS", "ſkit", f"s{BLIND[3]}it", "abcab", "aaaa", "nation", "schéa", "there thrice ", "ababbb", "éa", "bob@abb.com", "100-", "777", "\U0001F600", "\n"]
    texts = spark.createDataFrame([(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(25)))) for i in range(120)] + [(200, None), (201, "")], "k int, text string")
    rows = [("deny", f"{i:02}", p) for i, p in enumerate(deny)] + [("allow", f"{i:02}", p) for i, p in enumerate(allow)]
    rules = spark.createDataFrame(rows, "list string, id string, pattern string")
    out = lambda df: sorted(tuple(r) for r in explode_spans(df, "k").collect())
    want = out(detect(texts, deny=deny, allow=allow))
    assert out(R.detect_with_rule_table(texts, rules, "k")) == want and len(want) > 300


def test_texts_do_not_move(spark):
    texts = spark.range(50).selectExpr("id as k", "concat('word', id, '. ') as text").repartition(4)
    rules = spark.range(500).selectExpr("'deny' as list", "cast(id as string) as id", "concat('word', id, '[ .]') as pattern")
    found = R.detect_with_rule_table(texts, rules, "k")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert explode_spans(found, "k").count() == 50
