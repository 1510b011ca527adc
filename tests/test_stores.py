"""Snapshot store of events, store of findings, looked-up sides of unknown size, sessions of two tenants."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from veilframe.operators import rollups as R
from veilframe.operators.detect import detect
from veilframe.operators.findings_store import FindingsStore, store_counts
from veilframe.operators.routing import provider_dim, resolve_provider
from veilframe.plans.fixtures import usage
from veilframe.session import lookup_join, work_path
from veilframe.sources.snapshot_store import SnapshotStore


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, ts string, tenant_id string").select(
        F.lit(2).alias("schema_version"), "event_id", F.col("ts").cast("timestamp").alias("event_ts"), "tenant_id", F.lit("s").alias("session_id"))


ROWS = [("a", "2024-01-01 10:00:00", "acme"), ("b", "2024-01-01 11:00:00", "globex"), ("c", "2024-01-02 10:00:00", "globex"),
        ("d", "2024-01-03 10:00:00", "acme"), ("e", None, "globex"), ("f", "2024-01-03 11:00:00", None)]


def _ids(df):
    return sorted(r.event_id for r in df.collect())


def _files(store):
    return set(glob.glob(f"{store.path}/data/*/*/*.parquet"))


def test_deletion_rewrites_only_the_days_it_touches(spark):
    store = SnapshotStore(spark, work_path(spark, "store"))
    assert store.read().count() == 0 and store.delete_tenant("acme") == 0
    store.append(_events(spark, ROWS))
    store.append(_events(spark, [("g", "2024-01-03 12:00:00", "acme")]))
    listed = dict.fromkeys(store.parts())
    assert store.delete_tenant("globex") == 3
    assert _ids(store.read()) == ["a", "d", "f", "g"]
    left = set(store.parts())
    assert {p for p in listed if p[0] == "2024-01-03"} <= left and not {p for p in listed if p[0] in ("2024-01-01", "2024-01-02", None)} & left
    assert _ids(store.read(version=2)) == ["a", "b", "c", "d", "e", "f", "g"]
    assert store.delete_tenant("globex") == 0 and store.version() == 3
    assert store.vacuum() == 3 and _ids(store.read()) == ["a", "d", "f", "g"]


def test_retention_in_a_store(spark):
    store = SnapshotStore(spark, work_path(spark, "store"))
    store.append(_events(spark, ROWS))
    assert store.purge_older_than("2024-01-03 10:30:00", 1) == 3
    assert _ids(store.read()) == ["d", "e", "f"]
    assert _ids(store.read(since="2024-01-03")) == ["d", "f"]
    assert _ids(store.read(since="2025-01-01")) == []


def test_a_crash_before_the_switch_changes_nothing(spark, monkeypatch):
    store = SnapshotStore(spark, work_path(spark, "store"))
    store.append(_events(spark, ROWS))
    before = _files(store)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(SnapshotStore, "_switch", dies)
    with pytest.raises(KeyboardInterrupt):
        store.delete_tenant("globex")
    monkeypatch.undo()
    again = SnapshotStore(spark, store.path)
    assert _ids(again.read()) == sorted(r[0] for r in ROWS) and before < _files(store)
    again.vacuum()
    assert _files(store) == before
    assert again.delete_tenant("globex") == 3 and again.delete_tenant("acme") == 2 and _ids(again.read()) == ["f"]


def test_a_writer_that_comes_second_fails(spark):
    one = SnapshotStore(spark, work_path(spark, "store"))
    one.append(_events(spark, ROWS))
    with pytest.raises(RuntimeError):
        one._switch(0, [])


def test_a_day_is_read_alone(spark):
    store = SnapshotStore(spark, work_path(spark, "store"))
    store.append(_events(spark, ROWS))
    files = store.read(since="2024-01-03").inputFiles()
    assert files and all("event_date=2024-01-03" in f for f in files)


def test_findings_are_detected_once(spark):
    store = FindingsStore(spark, work_path(spark, "findings"), life_seconds=300)
    rows = [(1, "mail a@example.com"), (2, "mail a@example.com"), (3, None), (4, "nothing"), (5, "call 555-123-4567")]
    docs = spark.createDataFrame(rows, "k int, text string")
    first = store.detect(docs.where("k < 4"), "k", "2024-01-01 00:00:00")
    assert store_counts(first).first().asDict() == {"hits": 0, "misses": 1}
    second = store.detect(docs, "k", "2024-01-01 00:04:59")
    assert store_counts(second).first().asDict() == {"hits": 1, "misses": 2}
    want = {r.k: r.spans for r in detect(docs, "text").select("k", F.coalesce("spans", F.array()).alias("spans")).collect()}
    assert {r.k: r.spans for r in second.collect()} == want
    late = store.detect(docs, "k", "2024-01-01 00:05:00")
    assert store_counts(late).first().asDict() == {"hits": 2, "misses": 1}
    assert store.compact("2024-01-01 00:09:59") == {"kept": 1, "evicted": 2}
    store.capacity = 0
    assert store.compact("2024-01-01 00:09:59") == {"kept": 0, "evicted": 1}
    assert store.entries().count() == 0
    assert store.detect(docs.where("false"), "k", "2024-01-02 00:00:00").count() == 0


def test_contents_are_grouped_without_their_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "k int, text string")
    store = FindingsStore(spark, work_path(spark, "findings"))
    plan = store.detect(docs, "k", "2024-01-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_facts_stay_in_place_beside_a_small_side(spark):
    facts = spark.range(1_000).selectExpr("id", "concat('gpt-4o-', id % 3) as model_id")
    routed = resolve_provider(facts, provider_dim(spark))
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(model_id" not in plan
    assert routed.where("provider = 'OpenAI'").count() == 1_000


def test_a_large_side_is_repeated(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 2 else f"m{i % 10}", i % 3) for i in range(300)] + [(999, None, 0)], "id int, m string, x int")
    dim = spark.createDataFrame([("hot", 1), ("m0", 2), ("m4", 3)], "m string, y int")
    key = lambda df: sorted((r.id, r.m or "", r.y or 0) for r in df.collect())
    assert key(lookup_join(facts, dim, ["m"], most=1)) == key(lookup_join(facts, dim, ["m"])) == key(facts.join(dim, "m", "left"))


def test_a_session_of_two_tenants(spark, sf_dir):
    events = usage(spark, sf_dir)
    one = events.select("session_id").first().session_id
    both = events.unionByName(events.where(F.col("session_id") == one).withColumn("tenant_id", F.lit("other")))
    wanted = spark.createDataFrame([(one, "other"), (one, "nobody"), ("no such", "other")], "session_id string, tenant_id string")
    rows = {(r.session_id, r.tenant_id): r.call_count for r in R.session_stats_or_default(R.session_stats(both), wanted).collect()}
    n = events.where(F.col("session_id") == one).count()
    assert rows == {(one, "other"): n, (one, "nobody"): 0, ("no such", "other"): 0}
