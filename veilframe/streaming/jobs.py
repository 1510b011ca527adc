"""Structured Streaming forms of ingest, counters, sessions, limits, scans and alerts.

Event time decides everything; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.functions.columns import count_where
from veilframe.operators.alerts import Thresholds, alerts_of_counters, day_counters, merge_day_counters
from veilframe.sources.usage_store import guard_schema_version

WATERMARK = "10 minutes"
IDLE_GAP = "30 minutes"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of every micro-batch over all cores by their keys, for CPU-heavy work.

    A micro-batch has as many tasks as its files have splits, which may be few and of very different length. Each
    row moves once; two tasks a core even out long rows.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def ingest_events(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Idempotent ingest: known versions only, one row per event id."""
    return guard_schema_version(events).withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def running_counters(events: DataFrame, *keys: str, span: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Counters per time window and key."""
    return events.withWatermark("event_ts", watermark).groupBy(F.window("event_ts", span).alias("w"), *keys).agg(
        F.count("*").alias("call_count"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_estimate_cents").alias("cost_estimate_cents"), count_where(F.col("success")).alias("success_count"),
    ).select(F.col("w.start").alias("window_start"), *keys, "call_count", "tokens_out", "cost_estimate_cents", "success_count")


def closing_sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = IDLE_GAP, watermark: str = WATERMARK) -> DataFrame:
    """Inactivity sessions, emitted once they are over."""
    return df.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("events")
    ).select(key, F.col("w.start").alias("session_start"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("session_last"), "events")


def sliding_usage(df: DataFrame, key: str, ts: str = "ts", span: str = "1 hour", slide: str = "1 minute",
                  watermark: str = WATERMARK) -> DataFrame:
    """Requests per key in sliding windows.

    Requests are first counted per minute, so only one row per key and minute is copied into
    the overlapping windows.
    """
    minutes = df.withWatermark(ts, watermark).groupBy(F.window(ts, "1 minute").alias("m"), key).agg(F.count("*").alias("n"))
    hours = minutes.groupBy(F.window(F.window_time("m"), span, slide).alias("h"), key).agg(F.sum("n").alias("requests"))
    return hours.select(key, F.col("h.start").alias("window_start"), "requests")


def closing_streams(chunks: DataFrame, key: str = "stream_id", ts: str = "ts", gap: str = "5 minutes",
                    watermark: str = WATERMARK) -> DataFrame:
    """Last usage chunk, chunk count and end marker of each response stream, emitted when it is over."""
    from veilframe.operators.responses import is_end_marker, is_usage_chunk

    data = F.col("data")
    usage = is_usage_chunk(data, F.startswith("model_id", F.lit("claude")))
    return chunks.where(data != "").withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.max_by(F.when(usage, data), F.when(usage, F.col("seq"))).alias("last_usage"),
        F.count("*").alias("chunk_count"), F.bool_or(is_end_marker(data)).alias("ended"),
    ).drop("w")


def rehydrate_stream(chunks: DataFrame, tokens: DataFrame, keys: tuple[str, ...] = ("stream_id", "seq"), scope: str = "session_id",
                     ts: str = "ts", data_col: str = "data", life: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Event-stream chunks with the values of their tokens, where the token map is a stream as well.

    ``tokens`` (scope, token, original, ts) may arrive after the chunks. A chunk's tokens are joined with the map rows of its
    scope from ``life`` before it to its own time; a chunk goes out once both streams have passed its time, and map rows
    are forgotten ``life`` after theirs, so the state holds what lies between the two streams and no more. Of several
    values of a token the last one counts; unknown tokens stay. Chunks and map rows later than the watermark are lost.
    """
    from veilframe.operators.rehydrate import escaped_original, sse_lines, tokens_in

    wanted = chunks.withWatermark(ts, watermark).select(
        *keys, F.col(ts).alias("chunk_ts"), F.col(scope).alias("chunk_scope"), F.col(data_col).alias("data"),
        F.explode_outer(tokens_in(F.col(data_col))).alias("wanted"))
    known = tokens.withColumn("escaped", escaped_original()).withWatermark(ts, watermark).select(
        F.col(ts).alias("map_ts"), F.col(scope).alias("map_scope"), "token", "original", "escaped")
    near = F.expr(f"map_scope = chunk_scope and token = wanted and map_ts >= chunk_ts - interval {life} and map_ts <= chunk_ts")
    entry = F.struct("token", "map_ts", "original", "escaped")
    met = wanted.join(known, near, "leftOuter").groupBy(*keys, "chunk_ts").agg(
        F.first("data").alias("data"), F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), entry))).alias("entries"))
    last = F.filter("entries", lambda e, i: ~F.coalesce(F.get("entries", i + 1)["token"] == e["token"], F.lit(False)))
    value = lambda name: F.map_from_entries(F.transform(last, lambda e: F.struct(e["token"], e[name])))
    return met.select(*keys, sse_lines(F.col("data"), value("original"), value("escaped")).alias("rehydrated"))


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Start a stream into a parquet folder; by default it takes what is there and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_each_batch(df: DataFrame, fn: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a batch transformation to every micro-batch.

    Each batch overwrites its own folder, so a batch that is repeated after a failure leaves
    the same result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_alerts(events: DataFrame, path: str, checkpoint: str, t: Thresholds = Thresholds(), **trigger) -> StreamingQuery:
    """Alerts over everything seen so far, renewed with every micro-batch.

    ``events`` are priced and free of duplicates (``ingest_events``). A batch adds its counters to
    those of the batch before and judges the sums, so the way events fall into batches does
    not matter. Counters and alerts of a batch have their own folders, which a repeated
    batch overwrites.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, state = batch.sparkSession, f"{path}/state/batch={batch_id}"
        fine = day_counters(batch)
        if batch_id > 0:
            fine = merge_day_counters(fine.unionByName(spark.read.parquet(f"{path}/state/batch={batch_id - 1}")))
        fine.write.mode("overwrite").parquet(state)
        alerts_of_counters(spark.read.parquet(state), t).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of the last batch; counters never shrink, so their last folder names it."""
    last = spark.read.parquet(f"{path}/state").agg(F.max("batch")).scalar()
    return spark.read.parquet(f"{path}/alerts").where(F.col("batch") == last).drop("batch")
