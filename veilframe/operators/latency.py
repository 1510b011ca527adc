"""Latency statistics of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.columns import ceiling_rank

BUDGET_MS = 500.0
STAGES = ("auth_ms", "pii_detect_ms", "pseudonymize_ms", "upstream_ms", "rehydrate_ms", "total_ms")


def latency_stats(df: DataFrame, samples: int | None = None, budget_ms: float = BUDGET_MS) -> DataFrame:
    """Averages, extremes and exact percentiles over all requests, or over the newest ``samples``.

    A percentile is found in two steps: requests are counted per whole millisecond, and only those
    of the millisecond that holds the wanted rank are counted by their exact value.
    """
    if samples is not None:
        df = df.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(samples)
    row = df.agg(
        F.count("*").alias("sample_count"),
        *[F.coalesce(F.avg(s), F.lit(0.0)).alias(f"avg_{s}") for s in STAGES],
        F.coalesce(F.min("total_ms"), F.lit(0.0)).alias("min_total_ms"),
        F.coalesce(F.max("total_ms"), F.lit(0.0)).alias("max_total_ms"),
    )
    for p in (0.95, 0.99):
        row = row.withColumn(f"p{p * 100:.0f}_total_ms", F.coalesce(_percentile(df, "total_ms", p).scalar(), F.lit(0.0)))
    return row.withColumn("within_budget", F.col("avg_total_ms") < budget_ms)


def _percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """The value at rank ceil(p*(n-1)) of a column, as one row."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.floor(value).alias("bin"))
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumns({"before": upto - F.col("n"), "rank": ceiling_rank(p)(F.sum("n").over(Window.partitionBy()))})
    home = bins.where("before <= rank and rank < before + n")  # one row
    inside = rows.where(F.col("bin") == home.select("bin").scalar()).groupBy("value").agg(F.count("*").alias("n"))
    reach = home.select("before").scalar() + F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("reach", reach).where(F.col("reach") > home.select("rank").scalar()).agg(F.min("value").alias("value"))
