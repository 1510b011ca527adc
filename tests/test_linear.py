"""One text with very many findings costs its length, not the square."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from veilframe.functions import tokens as K
from veilframe.functions.arrays import counts_until, cut, group_starts, running_max, running_sum, text_blocks
from veilframe.functions.spans import SPANS, drop_repeated_ranges, layer_rank
from veilframe.operators.pseudonymize import sanitize, sanitize_bodies


def _text(n):
    return "; ".join(f"user{i % (n // 2)}@mail{i}.example.com" for i in range(n))


def _seconds(df, column):
    """The faster of two runs."""
    took = []
    for _ in range(2):
        begin = time.perf_counter()
        assert df.agg(F.sum(F.length(column))).first()[0] > 0
        took.append(time.perf_counter() - begin)
    return min(took)


def test_sanitizing_one_text_of_many_findings(spark):
    run = lambda n: _seconds(sanitize(spark.createDataFrame([(1, _text(n))], "id int, text string")), "sanitized")
    run(2_000)
    small, large = run(8_000), run(32_000)
    assert large <= 5 * max(small, 0.5), (small, large)


def test_sanitizing_one_body_of_many_messages(spark):
    def run(n):
        parts = ",".join(f'{{"role":"user","content":"mail user{i}@example.com"}}' for i in range(n))
        return _seconds(sanitize_bodies(spark.createDataFrame([(1, f'{{"messages":[{parts}]}}')], "id int, body string")), "sanitized_body")

    run(500)
    small, large = run(2_000), run(8_000)
    assert large <= 5 * max(small, 0.5), (small, large)


def test_cut_and_counts(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "🎉" for i in range(5_000))
    ranges = [(0, 0), (0, 1), (5, 1024), (0, 1024), (1023, 1025), (1024, 2048), (100, 4_999), (4_990, 5_000), (5_000, 5_000), (0, 5_000)]
    df = spark.createDataFrame([(text, i, a, b) for i, (a, b) in enumerate(ranges)], "t string, i int, a int, b int")
    got = df.select("i", cut(text_blocks(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: text[a:b] for i, (a, b) in enumerate(ranges)}
    points, values = [5, 0, 3, 3, 9], [3, 1, 3, 8]
    df = spark.createDataFrame([(points, values)], "p array<int>, v array<int>")
    row = df.select(counts_until(F.col("p"), F.col("v"), False).alias("less"), counts_until(F.col("p"), F.col("v"), True).alias("upto")).first()
    assert list(row.less) == [sum(v < p for v in values) for p in points]
    assert list(row.upto) == [sum(v <= p for v in values) for p in points]


def test_running_values(spark):
    rng = random.Random(2)
    lists = [[rng.randrange(-5, 100) for _ in range(n)] for n in (0, 1, 31, 32, 33, 64, 1_000, 4_000)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, a array<int>").coalesce(1)
    tens = F.transform("a", lambda x: F.floor(x / 30))
    rows = df.select("i", running_sum(F.col("a")).alias("s"), running_max(F.col("a")).alias("m"), group_starts(tens, lambda x, y: x != y).alias("g")).collect()
    for row in rows:
        values = lists[row.i]
        assert list(row.s) == list(itertools.accumulate(values))
        assert list(row.m) == list(itertools.accumulate(values, max))
        starts = [i if i == 0 or values[i] // 30 != values[i - 1] // 30 else 0 for i in range(len(values))]
        assert list(row.g) == list(itertools.accumulate(starts, max))


def test_unknown_originals_stay(spark):
    spans = [{"start": 0, "end": 1, "text": "a"}, {"start": 2, "end": 3, "text": "b"}, {"start": 4, "end": 5, "text": "a"}]
    df = spark.createDataFrame([("a b a!", spans, [("[X_1]", "a"), ("[X_2]", "a"), ("[X_3]", "c")])],
                               "t string, s array<struct<start:int,end:int,text:string>>, m array<struct<token:string,original:string>>")
    assert df.select(K.replace_spans(F.col("t"), F.col("s"), F.col("m")).alias("r")).first().r == "[X_1] b [X_1]!"


def test_repeated_ranges_give_way_once(spark):
    deny, outer = layer_rank("denylist"), layer_rank("external")
    rows = [(0, 5, layer_rank("pattern")), (0, 5, layer_rank("pattern") + 1), (0, 5, deny), (1, 5, deny), (1, 5, deny + 1), (1, 5, outer), (2, 3, outer), (0, 4, outer)]
    spans = [dict(start=s, end=e, neg_conf=-0.5, rank=r, spec=1, pii_type="T", text="x", confidence=0.5, byte_start=s, byte_end=e) for s, e, r in rows]
    df = spark.createDataFrame([(spans,)], f"s {SPANS}")
    left = df.select(F.explode(drop_repeated_ranges(F.col("s"))).alias("x")).select("x.start", "x.end", "x.rank").collect()
    assert sorted(map(tuple, left)) == sorted([rows[0], rows[1], rows[3], rows[6], rows[7]])
