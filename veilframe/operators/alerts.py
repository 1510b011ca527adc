"""Cost and stability alerts in one common schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.columns import count_where, fixed, ratio
from veilframe.operators.rollups import counters, recount


@dataclass(frozen=True)
class Thresholds:
    cost_spike_multiplier: float = 3.0
    runaway_session_cents: int = 1_000
    abnormal_retry_rate: float = 0.20
    daily_cost_spike_cents: int = 0
    high_truncation_rate: float = 0.10


APP_THRESHOLDS = Thresholds(5.0, 500, 0.30, 1_000)


def _alert(severity: str, kind: str, message, session, value, threshold: float) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(kind).alias("alert_type"), message.alias("message"),
        session.alias("session_id"), value.cast("double").alias("current_value"),
        F.lit(float(threshold)).alias("threshold"),
    )


def _raise(df: DataFrame, *alerts: Column) -> DataFrame:
    """One row per alert; several alerts of a row come from the same pass over the table."""
    rows = df.select(F.explode(F.array_compact(F.array(*alerts))).alias("a"))
    return rows.select("a.*")


def _runaway(t: Thresholds) -> Column:
    cost = F.col("cost_estimate_cents")
    message = F.format_string(
        "Session %s has exceeded $%.2f in estimated cost. This may indicate a runaway agent or misconfigured prompt.",
        F.col("session_id"), cost / 100.0)
    return F.when(cost > t.runaway_session_cents,
                  _alert("critical", "runaway_session", message, F.col("session_id"), cost, t.runaway_session_cents))


def _retrying(t: Thresholds) -> Column:
    rate = ratio(F.col("retry_count"), F.col("call_count"), 0.0)
    message = F.format_string(
        "Session %s has a %s%% retry rate (%d/%d calls). This may indicate an unstable upstream provider.",
        F.col("session_id"), fixed(rate * 100, 0), F.col("retry_count"), F.col("call_count"))
    return F.when(rate > t.abnormal_retry_rate,
                  _alert("warning", "abnormal_retry_rate", message, F.col("session_id"), rate, t.abnormal_retry_rate))


def _spiking(t: Thresholds, base: Column) -> Column:
    cost = F.col("cost_estimate_cents").cast("double")
    message = F.format_string(
        "Session %s cost ($%.2f) is %s× the per-session daily average ($%s). "
        "This may indicate an unusually expensive operation.",
        F.col("session_id"), cost / 100.0, fixed(cost / base, 1), fixed(base / 100.0, 4))
    return F.when((base > 0) & (cost > base * t.cost_spike_multiplier),
                  _alert("warning", "cost_spike", message, F.col("session_id"), cost / base, t.cost_spike_multiplier))


def _with_base(sessions: DataFrame, daily: DataFrame) -> DataFrame:
    """Add the mean daily cost divided by the number of sessions."""
    mean_daily = daily.agg(F.avg("cost_estimate_cents")).scalar()
    n_sessions = sessions.agg(F.count("*")).scalar()
    return sessions.withColumn("__base", mean_daily / F.greatest(n_sessions, F.lit(1)))


def runaway_sessions(sessions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return _raise(sessions, _runaway(t))


def abnormal_retry_rates(sessions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return _raise(sessions, _retrying(t))


def cost_spikes(sessions: DataFrame, daily: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Sessions dearer than N times the mean daily cost divided by the number of sessions."""
    return _raise(_with_base(sessions, daily), _spiking(t, F.col("__base")))


def session_alerts(sessions: DataFrame, daily: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """All per-session alerts in one pass over the session statistics."""
    return _raise(_with_base(sessions, daily), _runaway(t), _retrying(t), _spiking(t, F.col("__base")))


def daily_cost_spikes(daily: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    cost, limit = F.col("cost_estimate_cents"), t.daily_cost_spike_cents
    message = F.format_string("Daily cost on %s was $%.2f, exceeding the $%.2f threshold.",
                              F.col("date").cast("string"), cost / 100.0, F.lit(limit / 100.0))
    fires = (cost > limit) if limit > 0 else F.lit(False)
    return _raise(daily, F.when(fires, _alert("warning", "daily_cost_spike", message,
                                              F.lit(None).cast("string"), cost, limit)))


def high_truncation_rate(daily: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    row = daily.agg(F.sum("truncation_count").alias("cut"), F.sum("call_count").alias("calls"))
    rate = ratio(F.col("cut"), F.col("calls"), 0.0)
    message = F.format_string(
        "Global truncation rate is %s%% — users may be hitting context limits frequently. "
        "Consider reducing prompt size or breaking tasks into smaller steps.", fixed(rate * 100, 0))
    return _raise(row, F.when(rate > t.high_truncation_rate,
                              _alert("info", "high_truncation_rate", message, F.lit(None).cast("string"), rate,
                                     t.high_truncation_rate)))


def day_counters(df: DataFrame) -> DataFrame:
    """Counters per session, tenant and day: all that the alerts need of the events."""
    return df.groupBy("session_id", "tenant_id", F.to_date("event_ts").alias("date")).agg(*counters())


def merge_day_counters(fine: DataFrame) -> DataFrame:
    """Counter rows of several batches as one row per session, tenant and day."""
    return fine.groupBy("session_id", "tenant_id", "date").agg(*recount())


def alerts_of_counters(fine: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Every alert of the counted events, global ones and per session."""
    sessions = fine.groupBy("session_id", "tenant_id").agg(*recount())
    daily = fine.groupBy("date").agg(
        *[F.sum(c).alias(c) for c in ("cost_estimate_cents", "truncation_count", "call_count")])
    parts = [daily_cost_spikes(daily, t), high_truncation_rate(daily, t), session_alerts(sessions, daily, t)]
    return reduce(DataFrame.unionByName, parts)


def daily_costs(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("event_ts").alias("date")).agg(
        F.sum("cost_estimate_cents").alias("cost_estimate_cents"),
        count_where(F.col("tokens_truncated") > 0).alias("truncation_count"),
        F.count("*").alias("call_count"),
    )


def all_alerts(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Every alert of the events, global ones and per session."""
    return alerts_of_counters(day_counters(df), t)
