"""Session and client identity, session tables, inactivity sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.columns import count_where
from veilframe.operators.rollups import IDLE_MINUTES, idle_cutoff


def session_id(explicit: Column, authorization: Column, user_agent: Column, origin: Column,
               referer: Column, forwarded_for: Column) -> Column:
    """Explicit id, else a fingerprint of the identifying headers, else a fresh UUID."""
    part = lambda tag, c: F.concat(F.lit(tag), c)
    place = F.when(origin.isNotNull(), part("origin:", origin)).otherwise(part("referer:", referer))
    known = F.concat_ws("", part("auth:", authorization), part("ua:", user_agent), place, part("xff:", forwarded_for))
    fingerprint = F.when(known != "", F.substring(F.sha2(known, 256), 1, 24))
    return F.coalesce(F.nullif(explicit, F.lit("")), fingerprint, F.uuid())


def client_id(authorization: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(authorization, F.lit("anonymous")), 256), 1, 16)


def sessions(requests: DataFrame) -> DataFrame:
    """Session table from requests (session_id, ts, entities, provider, model); null keeps the last value."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "request_id")))
    return requests.groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"),
        F.count("*").alias("request_count"), F.sum("entities").alias("entities_detected"),
        latest("provider").alias("provider"), latest("model").alias("model"),
    )


def expired_sessions(table: DataFrame, as_of: str, minutes: int = IDLE_MINUTES) -> DataFrame:
    return table.where(F.col("last_activity") <= idle_cutoff(as_of, minutes))


def active_sessions(table: DataFrame, as_of: str, minutes: int = IDLE_MINUTES) -> DataFrame:
    return table.where(F.col("last_activity") > idle_cutoff(as_of, minutes))


def active_count(table: DataFrame, as_of: str, minutes: int = IDLE_MINUTES) -> DataFrame:
    return table.agg(count_where(F.col("last_activity") > idle_cutoff(as_of, minutes)).alias("active"))


def surviving_mappings(mappings: DataFrame, table: DataFrame, as_of: str, minutes: int = IDLE_MINUTES) -> DataFrame:
    """Token rows without those of expired sessions."""
    return mappings.join(expired_sessions(table, as_of, minutes).select("session_id"), "session_id", "left_anti")


def sessionize(df: DataFrame, key: str, ts: str = "ts", minutes: int = IDLE_MINUTES) -> DataFrame:
    """Inactivity sessions in two steps.

    Events of a key are first joined to fragments inside one day; a fragment list is short
    (fragments are at least the gap apart). The second step joins fragments over day borders.
    A key with a third of all events is so spread over its days.
    """
    gap = F.expr(f"interval {int(minutes)} minutes")
    day = Window.partitionBy(key, "__day").orderBy(ts)
    upto = day.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(key, F.col(ts).alias(ts), F.to_date(ts).alias("__day"))
    rows = rows.withColumn("__new", (F.lag(ts).over(day) + gap <= F.col(ts)).cast("int"))
    rows = rows.withColumn("__frag", F.sum(F.coalesce("__new", F.lit(1))).over(upto))
    fragments = rows.groupBy(key, "__day", "__frag").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))
    whole = Window.partitionBy(key).orderBy("first_ts")
    joined = fragments.withColumn("__new", (F.lag("last_ts").over(whole) + gap <= F.col("first_ts")).cast("int"))
    joined = joined.withColumn(
        "__session", F.sum(F.coalesce("__new", F.lit(1))).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(key, "__session").agg(
        F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_last"), F.sum("events").alias("events")
    ).drop("__session")


def gateway_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row from several one-row tables, without joining them."""
    columns = {c: t for df in parts.values() for c, t in df.dtypes}
    rows = [
        df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])
        for df in parts.values()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.agg(*[F.max(c).alias(c) for c in columns])


def dashboard_cards(summary: DataFrame) -> DataFrame:
    """Cards of the dashboard: token cards only with tokens, the cost card only with a known cost."""
    tokens = (F.col("tokens_in") > 0) | (F.col("tokens_out") > 0)
    always = F.lit(True)
    cards = [
        ("Total Requests", F.col("total_requests"), always), ("Entities Caught", F.col("total_entities"), always),
        ("Active Sessions", F.col("active_sessions"), always), ("Providers", F.col("provider_count"), always),
        ("Tokens In", F.col("tokens_in"), tokens), ("Tokens Out", F.col("tokens_out"), tokens),
        ("Est. Cost", F.col("cost_cents"), tokens & ~F.col("cost_unavailable")),
    ]
    listed = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(label).alias("card"), value.cast("bigint").alias("value"))) for label, value, cond in cards
    ]))
    return summary.select(F.explode(listed).alias("c")).select("c.*")
