"""Skew, limits, sessions and plan checks."""

import random

from pyspark.sql import functions as F

from veilframe.functions.columns import newest_per_key, previous_value
from veilframe.operators import limits as L
from veilframe.operators import sessions as N
from veilframe.operators.detect import detect
from veilframe.plans.fixtures import docs_pii, usage
from veilframe.session import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def walk(times, per_minute, per_hour):
    accepted, out = [], []
    for t in times:
        if sum(a > t - L.MINUTE for a in accepted) >= per_minute:
            out.append(L.DENIED_MINUTE)
        elif sum(a > t - L.HOUR for a in accepted) >= per_hour:
            out.append(L.DENIED_HOUR)
        else:
            out.append(L.ALLOWED)
            accepted.append(t)
    return out


def test_rate_limits_with_hot_quiet_and_bursty_clients(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for client, n, span in (("hot", 900, 4), ("quiet", 40, 40), ("bursty", 300, 12)):
        times = sorted(rng.randrange(span * L.HOUR) if client != "bursty" else rng.choice([1, 5, 6]) * L.HOUR + rng.randrange(L.HOUR // 6) for _ in range(n))
        for i, t in enumerate(times):
            rows.append((len(rows), client, t))
        ids = [r[0] for r in rows if r[1] == client]
        want.update(zip(ids, walk(times, 3, 50)))
    df = spark.createDataFrame(rows, "event_id long, client_id string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = {r.event_id: r.decision for r in L.rate_limit_decisions(df, L.Limits(3, 50)).collect()}
    assert got == want


def test_concurrency_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, s, s + rng.randrange(1, 9_000_000_000)) for i, s in enumerate(rng.randrange(5 * L.HOUR) for _ in range(400))]
    df = spark.createDataFrame(rows, "event_id long, a long, b long").select("event_id", F.timestamp_micros("a").alias("ts"), F.timestamp_micros("b").alias("end_ts"))
    got = {r.event_id: r.active for r in L.concurrency_decisions(df).collect()}
    assert got == {i: sum(1 for j, s2, e2 in rows if (s2, j) < (s, i) and e2 > s) for i, s, _ in rows}


def test_sessions_over_midnight_and_at_the_exact_gap(spark):
    rows = [("u", "2024-01-01 23:50:00"), ("u", "2024-01-02 00:10:00"), ("u", "2024-01-02 00:40:00"), ("u", "2024-01-02 01:09:59")]
    df = spark.createDataFrame(rows, "u string, t string").select("u", F.col("t").cast("timestamp").alias("ts"))
    got = sorted((str(r.session_start), r.events) for r in N.sessionize(df, "u").collect())
    assert got == [("2024-01-01 23:50:00", 2), ("2024-01-02 00:40:00", 2)]


def test_newest_per_key_equals_single_ranking(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("user_id").cast("string")))
    got = newest_per_key(e, ["k"], [F.desc("ts"), F.desc("event_id")], 5, F.col("event_id")).select("k", "event_id")
    pdf = e.select("k", "ts", "event_id").toPandas().sort_values(["ts", "event_id"], ascending=False).groupby("k").head(5)
    assert {(r.k, r.event_id) for r in got.collect()} == set(zip(pdf.k, pdf.event_id))


def test_previous_value_crosses_days(spark):
    rows = [("u", 1, "2024-01-01 10:00:00", "a"), ("u", 2, "2024-01-03 10:00:00", None), ("u", 3, "2024-01-03 11:00:00", "c")]
    df = spark.createDataFrame(rows, "k string, i long, t string, v string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.i: r.p for r in previous_value(df, "k", "ts", ["ts", "i"], F.col("v"), "p").collect()}
    assert got == {1: None, 2: "a", 3: None}


def test_detection_is_map_only_and_runs_once(spark, sf_dir):
    found = detect(table(spark, sf_dir, "documents"))
    text = plan(found.where(F.size("spans") > 0).select("doc_id", "spans"))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("RLIKE(text") <= plan(found.select("doc_id", "spans")).count("RLIKE(text")


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(detect(docs_pii(spark, sf_dir, table)).select("doc_id", "spans"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_statistics_use_partial_aggregation(spark, sf_dir):
    from veilframe.operators.rollups import all_grains

    text = plan(all_grains(usage(spark, sf_dir)))
    assert "partial_sum" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_events_carry_no_content(spark):
    from veilframe.sources.usage_store import USAGE_SCHEMA

    assert not {"text", "content", "prompt", "body"} & set(USAGE_SCHEMA.fieldNames())
