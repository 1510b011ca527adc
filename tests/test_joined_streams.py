"""Chunks and token map as two streams: late map rows, tokens past their life, bounded state."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.plans.streams import _slices
from veilframe.session import work_path
from veilframe.streaming import jobs as J

CHUNKS = "stream_id long, seq long, session_id string, ts timestamp, data string"
TOKENS = "session_id string, token string, original string, ts timestamp"


def _at(minute):
    minute += 120
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def _write(spark, path, rows, schema):
    plain = schema.replace("ts timestamp", "ts string")
    spark.createDataFrame(rows, plain).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_late_maps_meet_their_chunks_and_state_stays_small(spark):
    base = work_path(spark, "joined")

    def step(chunks, tokens):
        _write(spark, f"{base}/chunks", chunks, CHUNKS)
        _write(spark, f"{base}/tokens", tokens, TOKENS)
        streams = [spark.readStream.schema(s).parquet(f"{base}/{n}") for n, s in (("chunks", CHUNKS), ("tokens", TOKENS))]
        query = J.run_to_parquet(J.rehydrate_stream(*streams), f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
        return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])

    say = "data: {t} and {t}".replace("{t}", "[NAME_1]")
    sizes = []
    for k in range(8):
        chunks = [(k, i, "s", _at(60 * k + 30 + i), say if i else "data: [DONE]") for i in range(3)]
        # The map rows of an hour come one step late: one too early, two within the life (the later one counts).
        late = [] if k == 0 else [("s", "[NAME_1]", f"old{k - 1}", _at(60 * k - 60 - 1)), ("s", "[NAME_1]", f"first{k - 1}", _at(60 * k - 60 + 10)),
                                  ("s", "[NAME_1]", f"name{k - 1}", _at(60 * k - 60 + 30)), ("other", "[NAME_1]", "no", _at(60 * k - 60 + 30))]
        sizes.append(step(chunks, late))
    step([(99, 0, "x", _at(21 * 60), "data: end")], [("x", "[NAME_1]", "x", _at(21 * 60))])
    got = {(r.stream_id, r.seq): r.rehydrated for r in spark.read.parquet(f"{base}/out").collect()}
    assert len(got) == 24
    for k in range(8):
        name = "[NAME_1]" if k == 7 else f"name{k}"
        assert got[k, 0] == "data: [DONE]\n\n" and got[k, 1] == got[k, 2] == f"data: {name} and {name}\n\n"
    assert max(sizes[4:]) <= max(sizes[:4]) + 4


def test_slices_keep_rows_without_a_time_and_take_empty_tables(spark):
    folder = work_path(spark, "slices")
    rows = [(1, "2024-01-01"), (2, None), (3, "2024-01-03")]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, "event_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/{name}/events.parquet")
    ids = [r.event_id for part in _slices(spark, f"{folder}/full", "events", False) for r in part.collect()]
    assert sorted(ids) == [1, 2, 3]
    assert sum(part.count() for part in _slices(spark, f"{folder}/none", "events", False)) == 0


def test_rows_of_any_order_get_the_decisions_of_the_ordered_log(spark):
    import random
    from collections import deque

    from veilframe.operators.limits import HOUR, MINUTE, Limits
    from veilframe.plans.streams import _rocksdb
    from veilframe.streaming import state as S

    rng = random.Random(4)
    limits = Limits(3, 20)
    rows = [(i, rng.choice("aab"), rng.randrange(0, 3 * 3600 * 1_000_000)) for i in range(400)]
    want = {}
    for client in "ab":
        taken = deque()
        for us, i in sorted((us, i) for i, c, us in rows if c == client):
            recent = [t for t in taken if t > us - HOUR]
            if sum(t > us - MINUTE for t in recent) >= limits.per_minute:
                want[i] = "DeniedMinuteLimit"
            elif len(recent) >= limits.per_hour:
                want[i] = "DeniedHourLimit"
            else:
                want[i] = "Allowed"
                taken.append(us)
    assert len(set(want.values())) == 3
    base = work_path(spark, "shuffled")
    schema = "event_id long, client_id string, ts timestamp"
    # Batches of shuffled rows; the watermark's delay covers all of them. A last row lets everything close.
    rng.shuffle(rows)
    with _rocksdb(spark):
        for part in [*(rows[k::4] for k in range(4)), [(-1, "z", 40 * HOUR)]]:
            made = spark.createDataFrame([(i, c, us) for i, c, us in part], "event_id long, client_id string, us long")
            made.select("event_id", "client_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"{base}/in")
            source = spark.readStream.schema(schema).parquet(f"{base}/in")
            J.run_to_parquet(S.rate_limit_stream(source, limits, "6 hours"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    got = {r.row_id: r.decision for r in spark.read.schema("client_id string, row_id long, decision string").parquet(f"{base}/out").collect()}
    assert got == want
