"""Cases that once failed: colliding tokens, two tenants, failing models, null texts, ties."""

import pandas as pd

from veilframe.operators.detect import detect_distinct
from veilframe.operators.hooks import _found
from veilframe.operators.keys import events_for_key
from veilframe.operators.rehydrate import rehydrate
from veilframe.sources.usage_store import dedup_events


def test_colliding_tokens_of_a_session(spark):
    texts = spark.createDataFrame([(1, "s", "to [EMAIL_ADDRESS_1]")], "doc_id int, session_id string, sanitized string")
    tokens = spark.createDataFrame(
        [("s", "[EMAIL_ADDRESS_1]", "a@b.org", 1), ("s", "[EMAIL_ADDRESS_1]", "c@d.org", 2)],
        "session_id string, token string, original string, last_accessed int",
    )
    assert rehydrate(texts, tokens, "doc_id", text_col="sanitized").first().rehydrated == "to c@d.org"
    assert rehydrate(texts, tokens.drop("last_accessed"), "doc_id", text_col="sanitized").first().rehydrated == "to c@d.org"


def test_one_failing_text_keeps_the_others():
    def finder(texts):
        if (texts == "bad").any():
            raise ValueError
        return [[("X", 0, 1, 1.0)] for _ in texts]

    assert [len(x) for x in _found(finder, pd.Series(["a", "bad", "b", "c"]))] == [1, 0, 1, 1]


def test_null_texts_keep_their_row(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org"), (2, None), (3, "mail a@b.org")], "doc_id int, text string")
    assert {r.doc_id for r in detect_distinct(docs, "doc_id").collect()} == {1, 2, 3}


def test_quiet_keys_keep_their_events(spark):
    rows = [(i, "busy", str(i)) for i in range(10, 30)] + [(1, "quiet", "e")]
    events = spark.createDataFrame(rows, "timestamp int, key_id string, event_id string")
    assert events_for_key(events, "quiet", 5).count() == 1


def test_ties_are_decided_by_content(spark):
    rows = [("e", 1, f"p{i}") for i in range(50)]
    a = spark.createDataFrame(rows, "event_id string, event_ts int, payload string")
    b = spark.createDataFrame(rows[::-1], a.schema).repartition(7)
    assert dedup_events(a).collect() == dedup_events(b).collect()


def test_durations_of_a_hot_key_are_exact_over_all_events(spark):
    from veilframe.operators.rollups import duration_percentiles, global_duration_percentiles

    n = 30_001  # more than any ring buffer
    rows = spark.range(n).selectExpr("'hot' as k", "id as event_id", "timestamp_seconds(id) as event_ts", "(id * 7919) % 30001 as duration_ms")
    rows = rows.unionByName(spark.sql("select 'none' as k, -1L as event_id, timestamp_seconds(0) as event_ts, cast(null as bigint) as duration_ms"))
    got = {r["k"]: tuple(r)[1:] for r in duration_percentiles(rows, ["k"]).collect()}
    assert got == {"hot": (15000.0, 15000.0, 29700.0), "none": (0.0, 0.0, 0.0)}
    assert tuple(global_duration_percentiles(rows).first()) == (15000.0, 15000.0, 29700.0)
    newest = rows.where("k = 'hot' and event_id >= 30000").first()["duration_ms"]
    assert duration_percentiles(rows.where("k = 'hot'"), ["k"], samples=1).first()["p99_duration_ms"] == newest


def test_latency_percentiles_are_exact_also_inside_one_millisecond(spark):
    from veilframe.operators.latency import STAGES, latency_stats

    def of(values):
        rows = [(f"e{i}", i, *[float(v)] * len(STAGES)) for i, v in enumerate(values)]
        return latency_stats(spark.createDataFrame(rows, "event_id string, timestamp long, " + ", ".join(f"{s} double" for s in STAGES))).first()

    fine = of([5 + i / 1000 for i in range(1000)])
    assert fine["p95_total_ms"] == 5 + 950 / 1000 and fine["p99_total_ms"] == 5 + 990 / 1000
    spread = of(range(5000))
    assert (spread["p95_total_ms"], spread["p99_total_ms"]) == (4750.0, 4950.0)
    none = of([])
    assert (none["sample_count"], none["p95_total_ms"], none["within_budget"]) == (0, 0.0, True)


def test_retention_prunes_day_folders(spark, tmp_path):
    from veilframe.sources import usage_store as S

    rows = spark.range(40).selectExpr("concat('e', id) as event_id", "timestamp'2024-01-01' + make_dt_interval(cast(id as int)) as event_ts")
    S.write_usage_events(S.upgrade_events(rows), str(tmp_path / "store"))
    kept = S.purge_older_than(S.read_usage_events(spark, str(tmp_path / "store")), "2024-02-10", 10)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
    assert kept.count() == 10  # 31 January to 9 February
    gone = S.purged_count(S.read_usage_events(spark, str(tmp_path / "store")), "2024-02-10", 10)
    assert gone.first()["purged"] == 30


def test_logs_and_exports_have_no_hidden_bound(spark, tmp_path):
    from veilframe.operators.keys import events_for_key
    from veilframe.sources import usage_store as S

    rows = spark.range(12_000).selectExpr("concat('e', id) as event_id", "timestamp_seconds(id) as timestamp", "'k' as key_id")
    assert events_for_key(rows, "k").count() == 12_000 and events_for_key(rows, "k", 5).count() == 5
    events = S.upgrade_events(rows.selectExpr("event_id", "timestamp as event_ts", "'acme' as tenant_id"))
    S.export_events(events, str(tmp_path / "all"), "acme")
    assert spark.read.json(str(tmp_path / "all")).count() == 12_000


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    from veilframe.sources import rule_lists as L

    rows = [("1", r"\p{Lu}\d+", "names"), ("2", r"(?P<n>x)", "python only"), ("3", "(", "broken"), ("4", "  ", "blank"), ("5", "a" * 501, "long")]
    rules = spark.createDataFrame(rows, "id string, pattern string, label string").selectExpr("*", "'deny' as list", "true as enabled", "'' as created_at")
    good, bad = L.load_patterns(L.validate_rules(rules), "deny")
    assert good == [r"\p{Lu}\d+"] and [p for p, _ in bad] == ["(?P<n>x)", "("]
    assert {r.id: r.reason for r in L.rejected_rules(rules).collect()} == {"4": "blank pattern", "5": "pattern too long"}


def test_rules_from_a_table(spark):
    from veilframe.operators import policy as P

    docs = spark.createDataFrame(
        [(1, "Discard the API  Key, api keys and Cards"), (2, None), (3, ""), (4, "É é \\E 日本語 " * 300)], "id int, text string")
    rules = spark.createDataFrame(
        [(0, "api key", "block"), (1, "card", "warn"), (2, " ", "warn"), (3, "é", "warn"), (4, "\\E", "warn"), (5, "本", "warn"), (6, None, "warn")]
        + [(100 + i, f"rule number {i}", "warn") for i in range(3000)], "rule_index int, rule_text string, action string")
    got = [tuple(r) for r in P.lint_with_table(docs, rules, "id", "text").collect()]
    wanted = []
    for d in docs.collect():
        for r in rules.collect():
            low, t = (d.text or "").lower(), (r.rule_text or "").strip() and r.rule_text.lower()
            at = low.find(t) if t else -1
            while at >= 0:
                wanted.append((d.id, r.rule_index, r.rule_text, r.action, d.text[at:at + len(t)], at, at + len(t), 1.0))
                at = low.find(t, at + len(t))
    assert sorted(got) == sorted(wanted) and len(wanted) > 1200
    few, many = (P.lint_with_table(docs, rules.where(c), "id", "text")._jdf.queryExecution().optimizedPlan().toString() for c in ("rule_index < 9", "true"))
    assert abs(len(few) - len(many)) < 500


def test_alerts_do_not_depend_on_the_batches(spark, tmp_path):
    from veilframe.operators import alerts as A
    from veilframe.streaming import jobs as J

    rows = spark.range(600).selectExpr(
        "concat('s', id % 7) as session_id", "concat('t', id % 2) as tenant_id", "timestamp_seconds(id * 900) as event_ts", "id % 97 as cost_estimate_cents",
        *[f"id as {c}" for c in ("tokens_in_system", "tokens_in_user", "tokens_in_cached", "tokens_out", "tokens_in_cache_write", "actual_cost_cents")],
        "if(id % 5 = 0, 3L, 0L) as tokens_truncated", "true as success", "cast(id % 3 as int) as retry_attempt", "false as was_partial", "false as cost_unavailable")
    t = A.Thresholds(1.1, 1_000, 0.2, 4_000, 0.1)
    for i in range(4):
        rows.where(f"cast(event_ts as long) div 900 % 4 = {i}").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        J.run_alerts(source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), t).awaitTermination()
    got = J.latest_alerts(spark, str(tmp_path / "out")).collect()
    wanted = A.all_alerts(rows, t).collect()
    assert len({r.alert_type for r in wanted}) >= 4 and sorted(map(str, got)) == sorted(map(str, wanted))
