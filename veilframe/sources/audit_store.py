"""Audit entries and policy events: tables, reads, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_TYPES = "array<struct<entity_type:string,count:bigint>>"


def audit_entries(requests: DataFrame) -> DataFrame:
    """Entries from sanitized requests (request_id, ts, session_id, provider, model, spans, mappings, streaming)."""
    from veilframe.functions.spans import type_counts

    return requests.select(
        F.col("request_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), "session_id", "provider", "model",
        type_counts(F.col("spans")).cast(ENTITY_TYPES).alias("entity_types"),
        F.size("spans").cast("bigint").alias("total_entities"), "streaming",
        F.transform("mappings", lambda m: m["token"]).alias("tokens_generated"),
    )


def write_audit_entries(entries: DataFrame, path: str, mode: str = "append") -> None:
    entries.withColumn("entry_date", F.to_date("timestamp")).write.mode(mode).partitionBy("entry_date").parquet(path)


def read_audit_entries(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Entries with their day, in no order (``newest_first`` puts them in one); with ``since``, only folders from that day on."""
    entries = spark.read.parquet(path)
    return entries if since is None else entries.where(F.col("entry_date") >= F.lit(since).cast("date"))


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("timestamp"), F.desc("id"))


def decode_audit_rows(rows: DataFrame) -> DataFrame:
    """Entries whose lists are stored as JSON text ``[["TYPE", n], ...]``; bad text gives empty lists."""
    pairs = F.from_json("entity_types", "array<array<string>>")
    counts = F.transform(pairs, lambda p: F.struct(
        F.get(p, 0).alias("entity_type"), F.get(p, 1).try_cast("bigint").alias("count")))
    complete = F.forall(counts, lambda c: c["entity_type"].isNotNull() & c["count"].isNotNull())
    empty = F.array().cast(ENTITY_TYPES)
    return rows.withColumns({
        "entity_types": F.when(complete, counts).otherwise(empty).cast(ENTITY_TYPES),
        "tokens_generated": F.coalesce(F.from_json("tokens_generated", "array<string>"), F.array().cast("array<string>")),
    })


def recent_activity(entries: DataFrame, n: int = 6) -> DataFrame:
    return newest_first(entries).limit(n)


def audit_stats(entries: DataFrame) -> DataFrame:
    """One row: entries, entities, and the entities of each type (``entity_breakdown``, sorted by type), in one pass."""
    def part(whole: bool, kind: Column, n: Column) -> Column:
        return F.struct(F.lit(whole).alias("whole"), kind.cast("string").alias("entity_type"), n.cast("bigint").alias("count"))

    whole = F.array(part(True, F.lit(None), F.col("total_entities")))
    by_type = F.transform("entity_types", lambda e: part(False, e["entity_type"], e["count"]))
    rows = entries.select(F.inline(F.concat(whole, F.coalesce(by_type, F.slice(whole, F.lit(1), F.lit(0))))))
    totals = rows.groupBy("whole", "entity_type").agg(F.count("*").alias("rows"), F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"))
    named = F.when(~F.col("whole"), F.struct("entity_type", "count"))
    return totals.agg(
        F.coalesce(F.max(F.when(F.col("whole"), F.col("rows"))), F.lit(0).cast("bigint")).alias("total_requests"),
        F.coalesce(F.max(F.when(F.col("whole"), F.col("count"))), F.lit(0).cast("bigint")).alias("total_entities"),
        F.sort_array(F.collect_list(named)).cast(ENTITY_TYPES).alias("entity_breakdown"),
    )


def entity_totals(entries: DataFrame) -> DataFrame:
    rows = entries.select(F.explode("entity_types").alias("e"))
    return rows.groupBy(F.col("e.entity_type").alias("entity_type")).agg(F.sum("e.count").alias("n"))


def entity_breakdown(entries: DataFrame) -> DataFrame:
    """Totals per type and their share of the largest type."""
    totals = entity_totals(entries)
    largest = totals.agg(F.max("n")).scalar()
    return totals.withColumn("pct", F.col("n") / F.greatest(F.coalesce(largest, F.lit(1)), F.lit(1)) * 100)


def audit_csv_rows(entries: DataFrame) -> DataFrame:
    """Flat columns of the CSV export."""
    return entries.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "session_id", "provider", "model",
        "total_entities", "streaming",
        F.array_join(F.transform("entity_types", lambda e: F.concat_ws(":", e["entity_type"], e["count"].cast("string"))), ";").alias("entity_types"),
        F.array_join("tokens_generated", ";").alias("tokens"),
    )


def export_audit_csv(entries: DataFrame, path: str) -> None:
    audit_csv_rows(entries).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_audit_json(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


# ── policy events ───────────────────────────────────────────────────────────


def write_policy_events(events: DataFrame, path: str, mode: str = "append") -> None:
    events.withColumn("event_date", F.to_date("timestamp")).write.mode(mode).partitionBy("event_date").parquet(path)


def recent_policy_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def policy_csv_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.coalesce("session_id", F.lit("")).alias("session_id"), "rule_text", "action", "token_text",
        "start", "end", "score", "blocked",
    )


def export_policy_csv(events: DataFrame, path: str) -> None:
    """CSV with every field quoted and quotes doubled."""
    rows = policy_csv_rows(events)
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
