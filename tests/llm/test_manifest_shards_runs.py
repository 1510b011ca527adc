"""Manifest, sharding and periodic runs against plain versions, on hard tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import HARD, words
from veilframe.llm import merkle, runs, sharding

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root of a list of digests, and each one's steps (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            steps[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        leaves = sorted((leaf_of(r), r) for r in by_source[s])
        leaves.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, bytes.fromhex(x[0])))
        built.append(([r for _, r in leaves], *climb([h for h, _ in leaves])))
    root, upper = climb([b[1] for b in built])
    out = []
    for (members, subroot, steps), more in zip(built, upper, strict=True):
        for r, own in zip(members, steps, strict=True):
            path = own + more
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            now = leaf_of((*r[:4], low))
            for a, b in path:
                now = H(a + now + b)
            out.append((r[0], leaf_of(r), subroot, root, "".join(a + b for a, b in path), now))
    return Counter(out)


def manifest_of(docs):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.verified(merkle.build(docs, "doc_id", "source", LEAF, {"text": low}))


def hard_rows():
    rng = random.Random(3)
    rows = [(i, "big", "en", 5, f"Text {i}") for i in rng.sample(range(10_000), 300)]
    rows += [(i, f"s{i % 40}", None, None, t) for i, t in enumerate(HARD * 3)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, None, "de", None, "x"), (-1, "", "", 0, ""), (7, "é", "l", 1, "A")]
    return rows + rows[:10] + [(3, "big", "en", 5, "same id, other text")]


@pytest.mark.parametrize("rows", [hard_rows(), [(1, "a", "b", 2, "C")], [(1, None, "b", 2, "C"), (2, None, "b", 2, None)]])
def test_manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("lo", "Tree", "members", "number", "path", "claim", "row"):
        docs = docs.withColumn(name, F.lit(name))
    got = Counter(tuple(r) for r in manifest_of(docs).select("id", "leaf", "subroot", "root", "proof", "folded_root").collect())
    assert got == plain_manifest(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest_of(docs).count() == 0
    assert sharding.interleave(docs).count() == 0
    assert runs.with_runs(docs, "found").count() == 0


@pytest.mark.parametrize("shards", [7, 40])
def test_sharding(spark, shards):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("draw", "At", "place", "size", "of", "first", "rows", "shard", "fraction"):
        docs = docs.withColumn(name, F.lit(name))
    got = sharding.interleave(docs, shards).collect()
    want = Counter((r[0], r[1], len((r[4] or "").encode()) + 16, zlib.crc32((r[4] or "").encode())) for r in rows)
    assert Counter((r.id, r.source, r.size, r.crc) for r in got) == want
    by_shard = Counter(r.shard for r in got)
    assert set(by_shard) <= set(range(shards)) and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(shards) for k in range(by_shard[s])]
    sources = Counter(r.source for r in got)
    for source, n in sources.items():
        for s in range(shards):
            mine = sum(r.shard == s and r.source == source for r in got)
            assert abs(mine - n * by_shard[s] / len(got)) <= 2 + len(sources) ** 0.5
    again = sharding.interleave(docs.repartition(5), shards).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_another_seed_gives_another_order(spark):
    docs = spark.createDataFrame([(i, "a", "en", 1, "t") for i in range(500)], SCHEMA)
    one, two = ({r.id: (r.shard, r.slot) for r in sharding.interleave(docs, 10, seed).collect()} for seed in (1, 2))
    assert one != two


def plain_runs(w, least=6, exponent=4):
    """All stretches of equal words q apart, smallest period first."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q):
                best.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in best.items())


def expected(text):
    w = words(text)
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)


def as_tuple(found):
    return found["n_words"], [(r["start"], r["length"], r["period"]) for r in found["runs"]], found["collapsed"]


def test_runs_of_random_words():
    rng = random.Random(1)
    texts = []
    for _ in range(3000):
        parts = []
        for _ in range(rng.randrange(6)):
            unit = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(1, 7))]
            parts += (unit * 12)[: rng.randrange(1, len(unit) * 8 + 1)]
        texts.append(" ".join(parts))
    for i in range(0, len(texts), 100):
        got = runs._judged(pa.array(texts[i : i + 100]), 6, 4).to_pylist()
        assert [as_tuple(g) for g in got] == [expected(t) for t in texts[i : i + 100]]


def test_runs_of_hard_texts(spark):
    texts = [*HARD, "a b " * 30_000, " ".join(map(str, range(50_000)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "runs int, text string")
    got = {r["runs"]: as_tuple(r["found"]) for r in runs.with_runs(docs, "found").collect()}
    assert got[len(HARD)] == (60_000, [(0, 60_000, 2)], "a b")
    assert got[len(HARD) + 1][:2] == (50_000, [])
    assert [got[i] for i in range(len(HARD))] == [expected(t) for t in HARD]


def test_query_of_planted_runs(spark, sf_dir):
    from veilframe.llm.queries import QUERIES

    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"].run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = words(d.text)
        h = zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        _, found, collapsed = expected(" ".join(w))
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        want = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert got[d.doc_id] == (len(found), *want, H(lines), H(collapsed)), d.doc_id
