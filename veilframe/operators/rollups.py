"""Usage statistics at all grains: global, session, tool, model, day, and their trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilframe.functions.columns import count_where, fixed, nearest_rank, newest_per_key, ranked_values, ratio
from veilframe.functions.pricing import PRICING_AS_OF, usd
from veilframe.sources.usage_store import DEFAULT_TENANT

IDLE_MINUTES = 30

# Texts of the statistics.
BASELINE_METHOD = "full_file_read"
SUGGEST_TRUNCATION = "You hit context limits on %s%% of calls. Consider breaking your task into smaller steps."
SUGGEST_SYSTEM = "%s%% of input tokens are system prompt. Consider optimizing your system prompt."
SUGGEST_CACHED = "%s%% of input tokens were served from cache, saving cost."
SUGGEST_SAVED = "Token caching saved %s%% of input tokens. Good efficiency!"
SUGGEST_NORMAL = "Token usage is within normal parameters."

SUMS = (
    "tokens_in_system", "tokens_in_user", "tokens_in_cached", "tokens_out", "tokens_truncated",
    "tokens_in_cache_write", "cost_estimate_cents", "actual_cost_cents",
)
COUNTS = ("call_count", "success_count", "retry_count", "partial_count", "truncation_count", "unpriced_count")


def minute_truncate(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Privacy step: timestamps keep only the minute."""
    return df.withColumn(ts, F.date_trunc("minute", ts))


def counters() -> list[Column]:
    """The counter aggregates; ``actual_cost_cents`` stays null when no event reported one."""
    return [
        *[F.sum(c).alias(c) for c in SUMS],
        F.count("*").alias("call_count"),
        count_where(F.col("success")).alias("success_count"),
        count_where(F.col("retry_attempt") > 0).alias("retry_count"),
        count_where(F.col("was_partial")).alias("partial_count"),
        count_where(F.col("tokens_truncated") > 0).alias("truncation_count"),
        count_where(F.col("cost_unavailable")).alias("unpriced_count"),
    ]


def recount() -> list[Column]:
    """Counters of already counted rows."""
    return [F.sum(c).alias(c) for c in (*SUMS, *COUNTS)]


def duration_percentiles(df: DataFrame, keys: list[str], samples: int | None = None) -> DataFrame:
    """avg, p50 and p99 of ``duration_ms`` of each key over all events, or over its newest ``samples``."""
    rows = df.select(*keys, "event_ts", "event_id", "duration_ms")
    if samples is not None:
        rows = newest_per_key(rows, keys, [F.desc("event_ts"), F.desc("event_id")], samples, F.col("event_id"))
    return _duration_stats(rows, keys)


def global_duration_percentiles(df: DataFrame, samples: int | None = None) -> DataFrame:
    if samples is not None:
        df = df.orderBy(F.desc("event_ts"), F.desc("event_id")).limit(samples)
    return _duration_stats(df, [])


def _duration_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = ranked_values(df, keys, "duration_ms", {"p50": nearest_rank(0.50), "p99": nearest_rank(0.99)})
    return rows.select(
        *keys,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{name}_duration_ms") for c, name in (("mean", "avg"), ("p50", "p50"), ("p99", "p99"))],
    )


def _with_durations(stats: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    return stats.join(duration_percentiles(df, keys), keys, "left")


# ── sessions ────────────────────────────────────────────────────────────────


def session_counters(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id", "tenant_id").agg(
        *counters(), F.min("event_ts").alias("first_event"), F.max("event_ts").alias("last_event")
    )


def session_stats(df: DataFrame) -> DataFrame:
    stats = session_counters(df).withColumns({
        "duration_seconds": F.col("last_event").cast("bigint") - F.col("first_event").cast("bigint"),
        "cost_unavailable": (F.col("cost_estimate_cents") == 0) & (F.col("call_count") > 0),
        "tokens_saved_vs_full_file_read": F.col("tokens_in_cached"),
        "status": F.lit("active"),
    }).drop("unpriced_count")
    return _with_durations(stats, df, ["session_id", "tenant_id"])


def session_stats_or_default(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stats of the wanted sessions; unknown ones give a row of zeros.

    A session id may occur in several tenants. ``wanted`` names the session by both keys and gets one row for each
    pair; without a tenant column it gets the session of every tenant that has it.
    """
    keys = [c for c in ("session_id", "tenant_id") if c in wanted.columns]
    joined = wanted.select(*keys).distinct().join(stats, keys, "left")
    zero_long = [
        "duration_seconds", "tokens_in_system", "tokens_in_user", "tokens_in_cached", "tokens_out",
        "tokens_truncated", "tokens_in_cache_write", "cost_estimate_cents", "truncation_count", "retry_count",
        "partial_count", "call_count", "success_count", "tokens_saved_vs_full_file_read",
    ]
    return joined.withColumns({
        **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in zero_long},
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("avg_duration_ms", "p50_duration_ms", "p99_duration_ms")},
        "tenant_id": F.coalesce("tenant_id", F.lit(DEFAULT_TENANT)),
        "status": F.coalesce("status", F.lit("active")),
        "cost_unavailable": F.coalesce("cost_unavailable", F.lit(True)),
    })


def orphaned_sessions(df: DataFrame, as_of: str) -> DataFrame:
    """Sessions whose last event lies more than the idle time before ``as_of``."""
    last = df.groupBy("session_id").agg(F.max("event_ts").alias("last_event"))
    return last.where(F.col("last_event") < idle_cutoff(as_of))


def is_orphaned(df: DataFrame, wanted: DataFrame, as_of: str) -> DataFrame:
    """Per wanted session whether it is orphaned; an unknown session is."""
    last = df.groupBy("session_id").agg(F.max("event_ts").alias("last_event"))
    return wanted.select("session_id").distinct().join(last, "session_id", "left").select(
        "session_id", F.coalesce(F.col("last_event") < idle_cutoff(as_of), F.lit(True)).alias("orphaned")
    )


def idle_cutoff(as_of: str, minutes: int = IDLE_MINUTES) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(minutes)} minutes")


def event_cap(df: DataFrame, n: int) -> DataFrame:
    """Newest n events of each session."""
    order = [F.desc("event_ts"), F.desc("event_id")]
    return newest_per_key(df, ["session_id"], order, n, F.col("event_id")).drop("newest_rank")


def trimmed_sessions(df: DataFrame, n: int) -> DataFrame:
    sizes = df.groupBy("session_id").agg(F.count("*").alias("n"))
    return sizes.agg(count_where(F.col("n") > n).alias("trimmed"))


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """Rows a tenant may see: the default tenant sees all, others only their own."""
    if tenant in (DEFAULT_TENANT, ""):
        return df
    return df.where(F.col("tenant_id") == tenant)


def tenant_totals(df: DataFrame) -> DataFrame:
    """Counters per tenant, with the number of sessions."""
    return session_counters(df).groupBy("tenant_id").agg(*recount(), F.count("*").alias("sessions"))


# ── tools and models ────────────────────────────────────────────────────────


def tool_stats(df: DataFrame) -> DataFrame:
    by_tool = df.groupBy("tool_name").agg(*counters())
    total = df.agg(F.sum("tokens_out").alias("t")).scalar()
    stats = by_tool.select(
        F.col("tool_name").alias("tool"), *SUMS, "call_count",
        ratio(F.col("success_count"), F.col("call_count"), 1.0).alias("success_rate"),
        ratio(F.col("retry_count"), F.col("call_count"), 0.0).alias("retry_rate"),
        ratio(F.col("partial_count"), F.col("call_count"), 0.0).alias("partial_rate"),
        (ratio(F.col("tokens_out"), total, 0.0) * 100).alias("pct_of_total"),
    )
    return _with_durations(stats, df.withColumnRenamed("tool_name", "tool"), ["tool"])


def model_stats(df: DataFrame) -> DataFrame:
    stats = df.groupBy("model_id").agg(*counters()).select(
        "model_id", *[c for c in SUMS if c != "tokens_truncated"], "call_count",
        (F.col("unpriced_count") > 0).alias("cost_unavailable"),
        F.lit(PRICING_AS_OF).alias("pricing_as_of"),
    )
    return _with_durations(stats, df, ["model_id"])


# ── trends ──────────────────────────────────────────────────────────────────


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("event_ts"))


def daily_trends(df: DataFrame) -> DataFrame:
    dated = _dated(df)
    stats = dated.groupBy("date").agg(*counters()).select(
        "date", *SUMS, "call_count", "success_count", "retry_count", "partial_count",
        ratio(F.col("truncation_count"), F.col("call_count"), 0.0).alias("truncation_rate"),
    )
    return stats.join(duration_percentiles(dated, ["date"]).select("date", "avg_duration_ms"), "date", "left")


def _tokens_in() -> Column:
    return F.col("tokens_in_system") + F.col("tokens_in_user") + F.col("tokens_in_cached")


def tool_trends(df: DataFrame) -> DataFrame:
    dated = _dated(df).withColumnRenamed("tool_name", "tool")
    stats = dated.groupBy("date", "tool").agg(*counters()).select(
        "date", "tool", _tokens_in().alias("tokens_in"), "tokens_out", "cost_estimate_cents", "call_count",
        ratio(F.col("success_count"), F.col("call_count"), 1.0).alias("success_rate"),
    )
    durations = duration_percentiles(dated, ["date", "tool"]).select("date", "tool", "avg_duration_ms")
    return stats.join(durations, ["date", "tool"], "left")


def model_trends(df: DataFrame) -> DataFrame:
    dated = _dated(df)
    stats = dated.groupBy("date", "model_id").agg(*counters()).select(
        "date", "model_id", _tokens_in().alias("tokens_in"), "tokens_out", "tokens_in_cached",
        "tokens_in_cache_write", "actual_cost_cents", "cost_estimate_cents", "call_count",
        ratio(F.col("success_count"), F.col("call_count"), 1.0).alias("success_rate"),
    )
    durations = duration_percentiles(dated, ["date", "model_id"]).select("date", "model_id", "avg_duration_ms")
    return stats.join(durations, ["date", "model_id"], "left")


GRAINS = ("session_id", "tool_name", "model_id", "date")


def all_grains(df: DataFrame) -> DataFrame:
    """Counters at global, session, tool, model and day grain from one read of the events.

    Events are first counted per combination of the four keys; only those few rows are
    expanded to the five grouping sets.
    """
    fine = _dated(df).groupBy(*GRAINS).agg(*counters())
    sets = [[], *[[F.col(g)] for g in GRAINS]]
    rolled = fine.groupingSets(sets, *[F.col(g) for g in GRAINS]).agg(
        *recount(), F.grouping_id().alias("gid")
    )
    # grouping_id has one bit per key, set where the key is rolled up.
    grain = F.when(F.col("gid") == 15, "global")
    for i, name in enumerate(GRAINS):
        grain = grain.when(F.col("gid") == 15 - (8 >> i), name.removesuffix("_id").removesuffix("_name").replace("date", "day"))
    key = F.coalesce("session_id", "tool_name", "model_id", F.col("date").cast("string"), F.lit(""))
    return rolled.select(grain.alias("grain"), key.alias("key"), *SUMS, *COUNTS)


def trend_gaps(days: DataFrame) -> DataFrame:
    """Consecutive days of a trend that are not adjacent.

    The ordered pass sees one row per calendar day, so its size is bounded by the calendar.
    """
    nxt = F.lead("date").over(Window.orderBy("date"))
    pairs = days.select("date").distinct().withColumn("next_date", nxt)
    gaps = pairs.where(F.col("next_date") != F.date_add("date", 1))
    return gaps.select(
        F.col("date").alias("prev_date"), "next_date",
        F.format_string("Gap between %s and %s (expected %s)", F.col("date").cast("string"),
                        F.col("next_date").cast("string"), F.date_add("date", 1).cast("string")).alias("message"),
    )


# ── global, efficiency, meta ────────────────────────────────────────────────


def _totals(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row of counters, sessions and active sessions, aggregated by session first."""
    active = count_where(F.col("last_event") > idle_cutoff(as_of)) if as_of else F.lit(None)
    return session_counters(df).agg(
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in (*SUMS, *COUNTS) if c != "actual_cost_cents"],
        F.sum("actual_cost_cents").alias("actual_cost_cents"),
        F.count_distinct("session_id").alias("total_sessions"),
        active.alias("active_sessions"),
    )


def _percentages(row: DataFrame) -> DataFrame:
    total_in = _tokens_in()
    return row.withColumns({
        "total_tokens_in": total_in,
        "success_rate": ratio(F.col("success_count"), F.col("call_count"), 1.0),
        "retry_rate": ratio(F.col("retry_count"), F.col("call_count"), 0.0),
        "truncation_rate": ratio(F.col("truncation_count"), F.col("call_count"), 0.0),
        "system_overhead_pct": ratio(F.col("tokens_in_system"), total_in, 0.0) * 100,
        "tokens_saved_pct": ratio(F.col("tokens_in_cached"), total_in, 0.0) * 100,
    })


def _advice(with_cached: bool) -> Column:
    tips = [
        F.when(F.col("truncation_rate") > 0.05, F.format_string(SUGGEST_TRUNCATION, fixed(F.col("truncation_rate") * 100, 0))),
        F.when(F.col("system_overhead_pct") > 30.0, F.format_string(SUGGEST_SYSTEM, fixed(F.col("system_overhead_pct"), 0))),
    ]
    if with_cached:
        tips.append(F.when((F.col("tokens_in_cached") > 0) & (F.col("call_count") > 0),
                           F.format_string(SUGGEST_CACHED, fixed(F.col("tokens_saved_pct"), 0))))
    joined = F.concat_ws(" ", *tips)
    quiet = F.lit(SUGGEST_NORMAL)
    if not with_cached:
        quiet = F.when(F.col("tokens_saved_pct") > 0, F.format_string(SUGGEST_SAVED, fixed(F.col("tokens_saved_pct"), 1))).otherwise(quiet)
    return F.when(joined == "", quiet).otherwise(joined)


def suggestions(totals: DataFrame, *keys: str) -> DataFrame:
    """Both suggestion texts for rows of counters."""
    return _percentages(totals).select(
        *keys, _advice(with_cached=False).alias("global_suggestion"),
        _advice(with_cached=True).alias("efficiency_suggestion"),
    )


def global_stats(df: DataFrame, as_of: str) -> DataFrame:
    average = global_duration_percentiles(df).select("avg_duration_ms").scalar()
    row = _percentages(_totals(df, as_of))
    return row.select(
        "total_tokens_in",
        F.col("tokens_out").alias("total_tokens_out"),
        F.col("tokens_in_cached").alias("total_tokens_cached"),
        F.col("tokens_truncated").alias("total_tokens_truncated"),
        F.col("tokens_in_cache_write").alias("total_tokens_in_cache_write"),
        F.col("actual_cost_cents").alias("total_actual_cost_cents"),
        F.col("cost_estimate_cents").alias("total_cost_cents"),
        (F.col("unpriced_count") > 0).alias("total_cost_unavailable"),
        F.col("call_count").alias("total_calls"),
        "total_sessions", "active_sessions",
        average.alias("avg_duration_ms"),
        "success_rate", "truncation_rate",
        usd(F.col("cost_estimate_cents")).alias("cost_estimate_usd"),
        F.lit(BASELINE_METHOD).alias("baseline_method"),
        _advice(with_cached=False).alias("suggestion"),
    )


def efficiency(df: DataFrame) -> DataFrame:
    days = _dated(df).select("date").distinct().agg(F.count("*").alias("n")).scalar()
    row = _percentages(_totals(df)).withColumn("active_days", days)
    calls, ok = F.col("call_count"), F.col("success_rate") > 0
    component = lambda rate: F.when(ok, (1 - F.least(rate, F.lit(1.0))) * 0.2).otherwise(0.0)
    score = F.col("success_rate") * 0.6 + component(F.col("retry_rate")) + component(F.col("truncation_rate"))
    all_tokens = F.col("total_tokens_in") + F.col("tokens_out")
    return row.select(
        F.when(F.col("tokens_out") > 0, (F.col("tokens_in_user") + F.col("tokens_in_cached")) / F.col("tokens_out"))
        .alias("context_to_output_ratio"),
        "system_overhead_pct",
        F.when(F.col("success_count") > 0, F.call_function("div", F.col("cost_estimate_cents"), F.col("success_count")))
        .alias("cost_per_successful_task_cents"),
        "tokens_saved_pct",
        F.lit(BASELINE_METHOD).alias("baseline_method"),
        "truncation_rate",
        _advice(with_cached=True).alias("suggestion"),
        F.when(F.col("active_days") > 0, all_tokens / F.col("active_days")).alias("tokens_per_active_day"),
        F.when(F.col("active_days") > 0, F.call_function("div", F.col("cost_estimate_cents"), F.col("active_days")))
        .alias("cost_per_active_day_cents"),
        F.when(calls > 0, F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))).alias("quality_score"),
    )


def source_breakdown(df: DataFrame) -> DataFrame:
    source = F.col("token_count_source")
    return df.agg(*[count_where(source == s).alias(s) for s in ("api_reported", "estimated", "unavailable")])


def stats_meta(df: DataFrame, access_level: str = "full") -> DataFrame:
    counts = source_breakdown(df)
    other = F.col("estimated") + F.col("unavailable")
    return counts.select(
        "*", ratio(other, other + F.col("api_reported"), 0.0).alias("__share"),
    ).select(
        "api_reported", "estimated", "unavailable",
        (F.col("__share") > 0.5).alias("token_count_reconciliation_issue"),
        F.lit(False).alias("incomplete_data"),
        F.lit(access_level).alias("access_level"),
    )


def redact_tools(tools: DataFrame, level: str) -> DataFrame:
    if level != "redacted":
        return tools
    general = (
        F.when(F.col("tool").isin("chat_completions", "chat"), "llm")
        .when(F.col("tool") == "passthrough", "passthrough").otherwise("tool")
    )
    return tools.withColumn("tool", general)


def redact_models(models: DataFrame, level: str) -> DataFrame:
    if level != "redacted":
        return models
    return models.withColumns({
        "actual_cost_cents": F.lit(None).cast("bigint"),
        "cost_estimate_cents": F.lit(0).cast("bigint"),
        "cost_unavailable": F.lit(True),
    })


def full_stats(df: DataFrame, as_of: str, session_id: str | None = None, level: str = "full") -> dict[str, DataFrame]:
    """All parts of the statistics report as separate lazy tables."""
    sessions = session_stats(df)
    if session_id is not None:
        wanted = df.sparkSession.createDataFrame([(session_id,)], "session_id string")
        sessions = session_stats_or_default(sessions, wanted)
    return {
        "session": sessions,
        "by_tool": redact_tools(tool_stats(df), level),
        "by_model": redact_models(model_stats(df), level),
        "daily_trends": daily_trends(df),
        "efficiency": efficiency(df),
        "meta": stats_meta(df, level),
        "global": global_stats(df, as_of),
    }


# ── reconciliation ──────────────────────────────────────────────────────────

MEASURES = (
    "tokens_in_system", "tokens_in_user", "tokens_in_cached", "tokens_out", "tokens_truncated",
    "tokens_in_cache_write", "call_count", "success_count", "retry_count", "truncation_count",
)


def reconcile(stats: DataFrame, events: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Measures of session stats that differ from their events by more than the tolerance."""
    keys = ["session_id", "tenant_id"]
    expected = session_counters(events).select(*keys, *[F.col(m).alias(f"e_{m}") for m in MEASURES])
    both = stats.select(*keys, *MEASURES).join(expected, keys, "full_outer")
    zero = F.lit(0).cast("bigint")
    rows = both.select(
        "session_id",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(m), zero).alias("actual"),
                     F.coalesce(F.col(f"e_{m}"), zero).alias("expected"))
            for m in MEASURES
        ])).alias("r"),
    ).select("session_id", "r.*")
    delta = F.abs(F.col("actual") - F.col("expected")) / F.col("expected")
    wrong = F.when(F.col("expected") == 0, F.col("actual") != 0).otherwise(delta > tolerance)
    message = F.when(
        F.col("expected") == 0, F.format_string("%s: expected 0, got %d", "measure", "actual")
    ).otherwise(F.format_string("%s: expected %d, got %d (delta %s%%)", F.col("measure"), F.col("expected"),
                                F.col("actual"), fixed(delta * 100, 2)))
    return rows.where(wrong).withColumn("issue", message)
