"""Recognizers, guards, positions, overlaps and tokens on literal inputs and whole documents."""

import json
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions.checks import iban_ok, luhn_ok
from veilframe.functions.recognizers import RECOGNIZERS, Recognizer, custom_recognizer, recognizer_for
from veilframe.functions.spans import SPANS, resolve_overlaps
from veilframe.functions.taxonomy import SPECIFICITY
from veilframe.operators import detect as D
from veilframe.operators import pseudonymize as Z
from veilframe.operators import rehydrate as H
from veilframe.plans.fixtures import SENTENCES, docs_pii

POSITIVE = list(zip(SENTENCES, RECOGNIZERS))
# (text, type that must not be found)
NEGATIVE = [
    ("number 123456789 only digits", "US_SSN"),
    ("passport AB1234567", "PHONE_NUMBER"),
    ("at 37.7749, -122.4194", "PHONE_NUMBER"),
    ("card 4111 1111 1111 1112", "CREDIT_CARD"),
    ("The IBAN is GB82WEST12345698765431.", "IBAN_CODE"),
    ("case 94043 only", "US_ZIP_CODE"),
    ("host 300.20.30.40", "IP_ADDRESS"),
    ("001A2B3C4D5E", "DEVICE_MAC_ADDRESS"),
    ("x + y = z; only one", "CREDENTIAL_CONNECTION_STRING"),
]


def spans_of(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = D.explode_spans(D.detect(df, **kw), "id").collect()
    return [[(r.pii_type, r.text, r.start, r.end) for r in sorted(rows, key=lambda r: r.start) if r.id == i] for i in range(len(texts))]


def test_each_sentence_is_found_by_its_recognizer(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCES)], "id long, text string")
    found = D.explode_spans(D.find_spans(df, out="spans"), "id").select("id", "pii_type").collect()
    have = {(r.id, r.pii_type) for r in found}
    assert not [r.pii_type for i, (_, r) in enumerate(POSITIVE) if (i, r.pii_type) not in have]


def test_negative_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NEGATIVE)], "id long, text string")
    found = {(r.id, r.pii_type) for r in D.explode_spans(D.find_spans(df, out="spans"), "id").collect()}
    assert not [t for i, (_, t) in enumerate(NEGATIVE) if (i, t) in found]


def test_guards_never_lose_a_match(spark, sf_dir):
    """Guarded recognizers and bare patterns agree on all documents and on awkward texts."""
    extra = spark.createDataFrame(
        [(10**6 + i, t) for i, t in enumerate([
            "PAſſWORD: x", "tel (555) 123-4567", "+86 138 0000 0000", "ｖ１２３-４５-６７８９", "12 mg of Lipitor",
            "a=1;b=2;c=3;", "A = 1 ; B=2;\nC=3;", "1-2-3 04/05/2024", "Jan 5, 2024", "４111 1111 1111 1111", "see K.com",
        ])], "doc_id long, text string")
    docs = docs_pii(spark, sf_dir).select("doc_id", "text").unionByName(extra)
    bare = [Recognizer(r.pii_type, r.confidence, r.pattern, validator=r.validator) for r in RECOGNIZERS]
    cols = ("doc_id", "pii_type", "start", "end")
    a = D.explode_spans(D.find_spans(docs, out="spans"), "doc_id").select(*cols)
    b = D.explode_spans(D.find_spans(docs, recognizers=bare, out="spans"), "doc_id").select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_positions_against_python(spark, sf_dir):
    docs = docs_pii(spark, sf_dir)
    for kind in ("EMAIL_ADDRESS", "IP_ADDRESS", "US_SSN"):
        rec = recognizer_for(kind)
        got = {(r.doc_id, r.start, r.end, r.byte_start, r.byte_end) for r in D.explode_spans(D.scan_one(docs, rec), "doc_id").collect()}
        want = set()
        for row in docs.select("doc_id", "text").collect():
            for m in re.finditer(rec.pattern, row.text):
                b = len(row.text[: m.start()].encode())
                want.add((row.doc_id, m.start(), m.end(), b, b + len(m.group().encode())))
        assert got == want


def test_non_ascii_neighbours(spark):
    assert spans_of(spark, ["メールは tanaka@example.jp です。"])[0][0][:2] == ("EMAIL_ADDRESS", "tanaka@example.jp")
    assert spans_of(spark, ["Телефон: +7 912 345-67-89"])[0][0][:2] == ("PHONE_NUMBER", "+7 912 345-67-89")


def test_long_connection_string_does_not_overflow(spark):
    text = "key = value; " * 20_000
    assert len(spans_of(spark, [text])[0]) == 1


def test_connection_string_form_matches_plain_pattern(spark):
    plain = re.compile(r"(?i)(?:[a-z_ ]+\s*=\s*[^;]+;\s*){3,}")
    texts = ["x a=1; b=2; c=3; tail", "1a=1;b=2;c=3;d", "a=1; b=2;", "say: k=v; k=v; k=v;\n\nnext = 1; b = 2; c = 3; end", "q9a = b;c=d;e=f;;g=h;"]
    rec = recognizer_for("CREDENTIAL_CONNECTION_STRING")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = sorted((r.id, r.start, r.end) for r in D.explode_spans(D.scan_one(df, rec), "id").collect())
    assert got == sorted((i, m.start(), m.end()) for i, t in enumerate(texts) for m in plain.finditer(t))


def test_domain_form_matches_plain_pattern(spark):
    plain = re.compile(r"(?i)(?:(?:https?://)|(?:\b))(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?:/[^\s]*)?")
    rng = __import__("random").Random(11)
    texts = ["".join(rng.choice(["a", "bc", ".", ".", "-", "1", " ", "/", "https://", "com"]) for _ in range(30)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = sorted((r.id, r.start, r.end) for r in D.explode_spans(D.scan_one(df, recognizer_for("URL")), "id").collect())
    assert got == sorted((i, m.start(), m.end()) for i, t in enumerate(texts) for m in plain.finditer(t))


def test_very_long_dotted_text_does_not_overflow(spark):
    assert len(spans_of(spark, ["ab." * 50_000 + "com"])[0]) == 1


def fold(spans):
    kept = []
    for m in sorted(spans, key=lambda s: (s[1], s[2], -s[3], s[4])):
        if not kept or m[1] >= kept[-1][2]:
            kept.append(m)
            continue
        e = kept[-1]
        sm, se = SPECIFICITY.get(m[0], 1), SPECIFICITY.get(e[0], 1)
        surer = sm > se or (sm == se and m[3] > e[3])
        if (m[1], m[2]) == (e[1], e[2]):
            win = surer
        elif m[1] >= e[1] and m[2] <= e[2]:
            win = sm > se
        elif e[1] >= m[1] and e[2] <= m[2]:
            win = se <= sm
        else:
            win = surer
        if win:
            kept[-1] = m
    return kept


def test_overlap_fold_against_plain_python(spark):
    import random

    rng = random.Random(7)
    kinds = ["URL", "EMAIL_ADDRESS", "DATE_TIME", "SPECIAL_RELIGION", "PERSON"]
    cases = []
    for i in range(300):
        spans = []
        for k in range(rng.randint(0, 8) if i else 700):
            a = rng.randint(0, 20 if i else 3000)
            spans.append((rng.choice(kinds), a, a + rng.randint(1, 8), rng.choice([0.5, 0.85, 0.9]), k))
        cases.append(spans)
    rows = [(i, [(a, b, -c, k, SPECIFICITY.get(t, 1), t, "x", c, a, b) for t, a, b, c, k in s]) for i, s in enumerate(cases)]
    df = spark.createDataFrame(rows, f"id long, s {SPANS}").select("id", resolve_overlaps(F.col("s")).alias("r"))
    got = {r.id: [(x.pii_type, x.start, x.end, x.confidence, x["rank"]) for x in r.r] for r in df.collect()}
    assert got == {i: fold(s) for i, s in enumerate(cases)}


def test_validators(spark):
    df = spark.createDataFrame([("4111-1111-1111-1111", "GB82 WEST 1234 5698 7654 32"), ("4111111111111112", "GB82WEST12345698765433"), ("411", "GB8")], "c string, i string")
    rows = df.select(luhn_ok(F.col("c")), iban_ok(F.col("i"))).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (False, False)]


def test_tokens_numbered_from_the_end_and_shared_by_text(spark):
    text = "a@x.com then b@x.com then a@x.com and 10.0.0.1"
    row = Z.sanitize(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert row.sanitized == "[EMAIL_ADDRESS_1] then [EMAIL_ADDRESS_2] then [EMAIL_ADDRESS_1] and [IP_ADDRESS_1]"
    assert {m.token: m.original for m in row.mappings} == {
        "[EMAIL_ADDRESS_1]": "a@x.com", "[EMAIL_ADDRESS_2]": "b@x.com", "[IP_ADDRESS_1]": "10.0.0.1"}


def test_inserted_values_are_not_replaced_again(spark):
    texts = spark.createDataFrame([(1, "s", "x [A_1] y [B_2]")], "id long, session_id string, text string")
    tokens = spark.createDataFrame([("s", "[A_1]", "[B_2]"), ("s", "[B_2]", "two")], "session_id string, token string, original string")
    assert H.rehydrate(texts, tokens, "id").first().rehydrated == "x [B_2] y two"


def test_json_keys_keep_their_tokens(spark):
    bodies = spark.createDataFrame([(1, "s", '{"[A_1]":"[A_1] \\"q\\"", "n":[1,"[A_1]"]}')], "id long, session_id string, body string")
    tokens = spark.createDataFrame([("s", "[A_1]", 'say "hi"')], "session_id string, token string, original string")
    out = H.rehydrate_json(bodies, tokens, "id").first().rehydrated
    assert out == '{"[A_1]":"say \\"hi\\" \\"q\\"", "n":[1,"say \\"hi\\""]}'


@pytest.mark.parametrize("body,parts,user", [
    ('{"messages":[{"role":"user","content":"[not a list]"}]}', ["[not a list]"], "[not a list]"),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image","text":"b"},{"text":5}]}],"prompt":"p"}', ["a", "b", "p"], "a"),
    ('{"messages":[{"role":"system","content":"s"}]}', ["s"], None),
    ('{"messages":[{"role":"user"}]}', [], ""),
    ('{"prompt":7}', [], None),
])
def test_body_texts(spark, body, parts, user):
    from veilframe.functions import bodies as B

    df = Z.with_texts(spark.createDataFrame([(body,)], "body string"))
    row = df.select(F.transform("parts", lambda p: p["text"]).alias("t"), B.extract_user_text(F.col("body"), F.col("parts")).alias("u")).first()
    assert (row.t, row.u) == (parts, user)


def test_multi_line_messages_stay_in_place(spark):
    body = '{"messages":[{"role":"user","content":"one\\nmail a@x.com"},{"role":"user","content":"two 10.0.0.1"}],"k":{"z":[1,null]}}'
    row = Z.sanitize_bodies(spark.createDataFrame([(body,)], "body string")).first()
    assert json.loads(row.sanitized_body) == {
        "messages": [{"role": "user", "content": "one\nmail [EMAIL_ADDRESS_1]"}, {"role": "user", "content": "two [IP_ADDRESS_1]"}],
        "k": {"z": [1, None]},
    }


def test_custom_recognizer_and_lists(spark):
    found = spans_of(spark, ["badge X-77 of alice@example.com"], external=[custom_recognizer("BADGE", r"X-\d+", 0.8)], allow=[r"example\.com"])
    assert found == [[("BADGE", "X-77", 6, 10)]]


def test_failing_model_gives_no_spans(spark):
    from veilframe.operators.hooks import model_spans

    def broken(texts):
        raise RuntimeError("model down")

    df = model_spans(spark.createDataFrame([(1, "mail a@x.com")], "id long, text string"), broken)
    assert [s.pii_type for s in D.detect(df, feeds=["feed"]).first().spans] == ["EMAIL_ADDRESS"]
