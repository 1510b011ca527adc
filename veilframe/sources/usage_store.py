"""Usage events: schema, upgrade, guard, deduplication, retention, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2
DEFAULT_TENANT = "default"
RETENTION_DAYS = 30
DAY = "event_date"

# The columns of a usage event.
USAGE_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("retry_attempt", T.IntegerType()),
    T.StructField("tokens_in_system", T.LongType()),
    T.StructField("tokens_in_user", T.LongType()),
    T.StructField("tokens_in_cached", T.LongType()),
    T.StructField("tokens_out", T.LongType()),
    T.StructField("tokens_truncated", T.LongType()),
    T.StructField("tokens_in_cache_write", T.LongType()),
    T.StructField("token_count_source", T.StringType()),
    T.StructField("was_streamed", T.BooleanType()),
    T.StructField("was_partial", T.BooleanType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("actual_cost_cents", T.LongType()),
    T.StructField("cost_estimate_cents", T.LongType()),
    T.StructField("pricing_as_of", T.StringType()),
    T.StructField("cost_unavailable", T.BooleanType()),
    T.StructField("success", T.BooleanType()),
])


def upgrade_events(df: DataFrame) -> DataFrame:
    """Any stored version in the current columns: absent columns are null, write tokens 0.

    The day column of a partitioned store stays, so that day filters prune folders.
    """
    full = df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in USAGE_SCHEMA.fields
    ], *[c for c in df.columns if c == DAY])
    return full.withColumn(
        "tokens_in_cache_write", F.coalesce("tokens_in_cache_write", F.lit(0).cast("bigint"))
    )


def read_usage_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Usage events of one or more parquet folders, also of the older layout."""
    parts = [upgrade_events(spark.read.parquet(p)) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_usage_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append events partitioned by day, so that retention and day filters prune folders."""
    df.withColumn(DAY, F.to_date("event_ts")).write.mode(mode).partitionBy(DAY).parquet(path)


def guard_schema_version(df: DataFrame, newest: int = SCHEMA_VERSION) -> DataFrame:
    return df.where(F.col("schema_version") <= newest)


def dedup_events(df: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("event_ts",)) -> DataFrame:
    """First event per id wins.

    ``row_number() = 1`` lets Spark keep one row per id already before the shuffle, so an id
    that is repeated very often does not pile up in one task. Events that tie in the order are
    told apart by a hash of all their columns, so the same event wins in every run.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*plain))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def purge_older_than(df: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Events kept by the retention rule."""
    cutoff = _cutoff(as_of, days)
    return df.where(_day(df, lambda d: d >= F.to_date(cutoff)) & (F.col("event_ts") >= cutoff))


def purged_count(df: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    cutoff = _cutoff(as_of, days)
    return df.where(_day(df, lambda d: d <= F.to_date(cutoff)) & (F.col("event_ts") < cutoff)).agg(F.count("*").alias("purged"))


def _day(df: DataFrame, condition: Callable[[Column], Column]) -> Column:
    """The condition on the day column, true where there is none (the older layout)."""
    return F.col(DAY).isNull() | condition(F.col(DAY)) if DAY in df.columns else F.lit(True)


def _cutoff(as_of: str, days: int):
    return F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")


def recent(df: DataFrame, n: int, tenant: str | None = None) -> DataFrame:
    """Newest events, optionally of one tenant."""
    rows = df if tenant is None else df.where(F.col("tenant_id") == tenant)
    return rows.orderBy(F.desc("event_ts"), F.desc("event_id")).limit(n)


def delete_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def tenant_count(df: DataFrame, tenant: str) -> DataFrame:
    return df.where(F.col("tenant_id") == tenant).agg(F.count("*").alias("deleted"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def export_events(df: DataFrame, path: str, tenant: str | None = None, limit: int | None = None) -> None:
    """JSON export of all events, optionally of one tenant or of the newest ``limit`` only."""
    rows = df if tenant is None else df.where(F.col("tenant_id") == tenant)
    if limit is not None:
        rows = recent(rows, limit)
    rows.write.mode("overwrite").json(path)
