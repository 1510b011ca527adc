"""Rate and concurrency limits over request logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    per_minute: int = 60
    per_hour: int = 1_000


COMMAND_LIMITS = Limits(300, 10_000)
MAX_CONCURRENT = 10
MINUTE, HOUR = 60_000_000, 3_600_000_000
ALLOWED, DENIED_MINUTE, DENIED_HOUR = "Allowed", "DeniedMinuteLimit", "DeniedHourLimit"


def rate_limit_usage(df: DataFrame, key: str = "client_id", ts: str = "ts") -> DataFrame:
    """Requests of the same key in the trailing minute and hour, the row itself included.

    Rows are counted per key and clock hour; every row also joins the next hour as context, so
    that its trailing hour is complete there. A busy key is spread over its hours. A count is the
    difference of two counts from the start of the frame, which only grow: one pass over the
    rows, however many fall into an hour.
    """
    micros = F.unix_micros(ts)
    hour = F.call_function("div", micros, F.lit(HOUR))
    rows = df.withColumns({"__us": micros, "__own": hour})
    rows = rows.withColumn("__hour", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(key, "__hour").orderBy("__us")
    until = lambda end: F.count("*").over(w.rangeBetween(Window.unboundedPreceding, end))
    counted = rows.withColumns({"last_minute": until(0) - until(-MINUTE), "last_hour": until(0) - until(-HOUR)})
    return counted.where(F.col("__hour") == F.col("__own")).drop("__us", "__own", "__hour")


def _walker(key: str, limits: Limits):
    """Sequential decisions over rows sorted by (key, segment, time); state is the recent accepts."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, minute, hour = None, deque(), deque()
        for batch in batches:
            keep, decisions = [], []
            for row_key, segment, us, context in zip(batch[key], batch["segment"], batch["us"], batch["context"]):
                if (row_key, segment) != current:
                    current, minute, hour = (row_key, segment), deque(), deque()
                while minute and minute[0] <= us - MINUTE:
                    minute.popleft()
                while hour and hour[0] <= us - HOUR:
                    hour.popleft()
                if not context and len(minute) >= limits.per_minute:
                    decision = DENIED_MINUTE
                elif not context and len(hour) >= limits.per_hour:
                    decision = DENIED_HOUR
                else:
                    decision = ALLOWED
                    minute.append(us)
                    hour.append(us)
                keep.append(not context)
                decisions.append(decision)
            out = batch.assign(decision=decisions)[keep]
            yield out[[key, "row_id", "decision"]]

    return walk


def rate_limit_decisions(df: DataFrame, limits: Limits = Limits(), key: str = "client_id",
                         ts: str = "ts", row_id: str = "event_id") -> DataFrame:
    """Allowed or denied per request, where denied requests do not count themselves.

    A request whose raw trailing counts are below the limits is allowed whatever came before.
    Only clock hours with a request at a limit need the ordered walk; a run of such hours
    starts from the hour before it, in which every request was allowed, so the runs of one
    key are independent. Inside a run rows stream in order with the recent accepts as the
    only state; no group is collected.
    """
    used = rate_limit_usage(df.select(key, ts, row_id), key, ts).select(
        key, F.col(row_id).alias("row_id"), F.unix_micros(ts).alias("us"), "last_minute", "last_hour")
    used = used.withColumn("hour", F.call_function("div", F.col("us"), F.lit(HOUR)))
    tight = (F.col("last_minute") > limits.per_minute) | (F.col("last_hour") > limits.per_hour)
    hours = used.groupBy(key, "hour").agg(F.bool_or(tight).alias("tight")).where("tight").drop("tight")
    w = Window.partitionBy(key).orderBy("hour")
    starts = (F.col("hour") - F.coalesce(F.lag("hour").over(w), F.lit(-10)) > 1).cast("int")
    runs = hours.withColumn("starts", starts).withColumn("segment", F.sum("starts").over(w))
    # Context: the untouched hour before a run feeds its state.
    context = runs.where("starts = 1").select(key, (F.col("hour") - 1).alias("hour"), "segment", F.lit(True).alias("context"))
    walked_hours = runs.select(key, "hour", "segment", F.lit(False).alias("context")).unionByName(context)
    rows = used.select(key, "row_id", "us", "hour").join(walked_hours, [key, "hour"])
    ordered = rows.repartition(key, "segment").sortWithinPartitions(key, "segment", "us", "row_id")
    id_type, key_type = df.schema[row_id].dataType.simpleString(), df.schema[key].dataType.simpleString()
    walked = ordered.select(key, "row_id", "segment", "us", "context").mapInPandas(
        _walker(key, limits), f"`{key}` {key_type}, row_id {id_type}, decision string")
    free = used.join(hours, [key, "hour"], "left_anti").select(key, "row_id", F.lit(ALLOWED).alias("decision"))
    return free.unionByName(walked).withColumnRenamed("row_id", row_id)


def concurrency_decisions(df: DataFrame, limit: int = MAX_CONCURRENT, start: str = "ts", end: str = "end_ts",
                          row_id: str = "event_id", bucket_seconds: int = 3_600) -> DataFrame:
    """Requests running at each arrival, and whether the limit is reached.

    A sweep over starts (+1) and ends (-1). Running sums are taken inside time buckets and
    shifted by the net change of all buckets before; the only global pass sees one row per
    bucket of the calendar.
    """
    point = lambda t, delta, kind: df.select(
        F.col(row_id), F.unix_micros(t).alias("us"), F.lit(delta).alias("delta"), F.lit(kind).alias("kind"))
    points = point(start, 1, 1).unionByName(point(end, -1, 0))
    points = points.withColumn("bucket", F.call_function("div", F.col("us"), F.lit(bucket_seconds * 1_000_000)))
    net = points.groupBy("bucket").agg(F.sum("delta").alias("net"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = net.select("bucket", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("bucket").orderBy("us", "kind", row_id).rowsBetween(Window.unboundedPreceding, -1)
    swept = points.withColumn("run", F.coalesce(F.sum("delta").over(inside), F.lit(0)))
    arrivals = swept.where("kind = 1").join(shifts, "bucket")
    active = F.col("run") + F.col("shift")
    return arrivals.select(row_id, active.alias("active"), F.when(active >= limit, "DeniedConcurrentLimit").otherwise(ALLOWED).alias("decision"))


def command_limits(df: DataFrame, limits: Limits = COMMAND_LIMITS, key: str = "command") -> DataFrame:
    """The same limiter per command."""
    return rate_limit_decisions(df, limits, key)
