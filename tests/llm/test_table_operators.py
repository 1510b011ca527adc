"""Operators on whole tables: archives, personal data, digest index, licenses, mixing, pipeline."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, duck
from tests.llm import brute
from veilframe.llm import exact_dedup, licenses, mixing, pii, warc
from veilframe.llm.queries import QUERIES
from veilframe.session import work_path


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle))
def test_sql_twin(name, spark, sf_dir):
    assert compare(spark, sf_dir, QUERIES[name].run, QUERIES[name].oracle, duck(sf_dir)) is None


def test_archives(spark):
    tricky = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n<b>é</b>" + "WARC/1.1\r\n" * 3
    rows = [(3, "http://a\r\nb", tricky), (1, "http://c", tricky), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (None, "u", "n" * 200), (7, "u", tricky), (7, "u", tricky), (8, "u", "日本" * 80)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = work_path(spark, "archive")
    warc.write_pages(pages, path)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(rows) and records.where("not complete").count() == 0
    whole = warc.captures(records)
    assert whole.count() == len(rows)
    assert whole.where("request is null or metadata is null or response is null").count() == 0
    texts = {r.page_id: r.text for r in whole.where("record_type = 'response'").select("page_id", F.col("response.payload").alias("text")).collect()}
    assert texts[1] == tricky and texts[8] == "日本" * 80 and texts[2] == ""
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.resolved(whole).collect()}
    assert {(3, "revisit", 1), (7, "revisit", 1), (1, "response", None), (5, "response", None), (6, "response", None), (None, "response", None)} <= got
    sizes = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.resolved(whole).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        assert sizes[page] == (len(data), hashlib.sha256(data).hexdigest())


def _luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def _base(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


PRIVATE = [
    *brute.HARD, "a@b.c+d@e.f.g, x.y@z and 1.2.3.4.5.6.7.8 300.1.1.1 001.02.003.255", "card 4111 1111 1111 1111, 4111111111111112 and 4111-1111-1111-1111-1",
    "call +49 (0) 30 1234567. or +1 2 +", "é😀 mail me@host.example.org ñ 10.0.0.1é", "9" * 3000, "a" * 20000 + "@", "me@x.yz " * 3000, "1.2.3.4 " * 2000 + "token = \"abc123def456ghi\"",
]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PRIVATE)], "doc_id long, text string, spans string")
    got = pii.find(docs).select("id", pii.span_text(F.col("base")).alias("base"), pii.span_text(F.col("spans")).alias("spans")).collect()
    assert len(got) == len(PRIVATE)
    for r in got:
        want = [f"{k}:{a}:{b}" for k, a, b in _base(PRIVATE[r.id])]
        assert [x for x in r.base.split(",") if x] == want
        assert set(want) <= {x for x in r.spans.split(",") if x}
    assert pii.find(docs.limit(0)).count() == 0


def test_reliabilities_tell_good_labelers():
    votes = [((1, 1, 1, 0, 0), 900), ((1, 1, 0, 0, 0), 100), ((-1, -1, 0, 0, -1), 800), ((-1, -1, 0, 0, 0), 150), ((-1, 1, 0, 0, 0), 50)]
    patterns = [("card", v, (0, 1, 0), n) for v, n in votes]
    p = pii.reliabilities(patterns)
    assert p[0] > 0.99 and p[1] > 0.9 and p[2] < 0.01 and p[3] < 0.1


def test_digest_index_takes_new_data(spark):
    first = spark.createDataFrame([(3, "a b"), (1, "ab "), (2, " a  b"), (2, " a  b"), (4, None), (5, " "), (None, "z")], "doc_id long, text string")
    index = exact_dedup.new_index(first, "doc_id")
    rows = exact_dedup.duplicate_groups(first, index=index).collect()
    assert sum(r.kept for r in rows) == 3 and len(rows) == 7
    assert {r.keep_id for r in rows if r.group_size == 4} == {2} and sum(r.kept for r in rows if r.id == 2) == 1
    again = spark.createDataFrame([(9, "AB"), (10, "a\tb"), (11, "AB")], "doc_id long, text string")
    rows = {r.id: r for r in exact_dedup.duplicate_groups(again, index=exact_dedup.DigestIndex(spark, index.path, 8)).collect()}
    assert (rows[9].kept, rows[10].kept, rows[11].kept) == (True, False, False) and rows[10].keep_id == 2
    kept = exact_dedup.drop_duplicates(first)
    assert kept.columns == first.columns and kept.count() == 3
    assert exact_dedup.drop_duplicates(first.limit(0)).count() == 0


def test_licenses(spark):
    long_line = "filler " * 500 + licenses.TEMPLATES[2][1] + " filler" * 500
    texts = [*brute.HARD, "MIT License mit license, x", long_line, "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software and associated documentation files (the Software), to deal in the Software", "mİt license"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want = (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == want
        blocks = [set(word.findall(line.lower())) for line in (t or "").split("\n")]
        more = {label for label, text in licenses.TEMPLATES for b in blocks if len(b & set(text.split())) >= 0.8 * len(set(text.split()))}
        assert got[i].labels == sorted(more | {label for _, label in places})
    assert licenses.scan(docs.limit(0)).count() == 0


def _fill(budget, children):
    """Water-filling of one node: name -> (capacity, weight)."""
    out, open_ = {k: 0.0 for k in children}, {k for k, (c, w) in children.items() if w > 0}
    while open_:
        total = sum(children[k][1] for k in open_)
        share = {k: budget * children[k][1] / total for k in open_}
        full = {k for k in open_ if share[k] >= children[k][0]}
        if not full:
            return out | share
        for k in full:
            out[k] = children[k][0]
            budget -= children[k][0]
        open_ -= full
    return out


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "ab"[i % 3 % 2], None if i % 11 == 0 else f"s{i % 4}") for i in range(600)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    weights = {"lang": {"a": 3, "b": 1, "*": 0.5}, "source": {"s0": 5, "s1": 0, "*": 1}}
    mixed = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, 0.7, weights, epochs=2).collect()
    assert len(mixed) == len(rows)
    leaves = {}
    for r in mixed:
        leaves.setdefault((r.lang, r.source), []).append(r)
    tokens = {k: sum(r.n_tokens for r in v) for k, v in leaves.items()}
    w = lambda level, name: weights[level].get(name, weights[level]["*"])
    langs = _fill(int(sum(tokens.values()) * 0.7), {x: (2 * sum(t for k, t in tokens.items() if k[0] == x), w("lang", x)) for x in {k[0] for k in leaves}})
    for lang, pool in langs.items():
        want = _fill(int(pool + 1e-6), {k: (2 * t, w("source", k[1])) for k, t in tokens.items() if k[0] == lang})
        for k, part in want.items():
            budget = leaves[k][0].budget
            assert abs(budget - part) <= 1
            taken = sum(r.n_tokens * r.n_copies for r in leaves[k])
            assert taken <= budget and (budget - taken < 7 or all(r.n_copies == 2 for r in leaves[k] if r.n_tokens))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
