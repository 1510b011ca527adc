"""Key lifecycle events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DETAIL_BYTES = 100
# Prefixes that look like a key; a deployment adds the prefix of its own gateway keys.
KEY_PREFIXES = ("sk-",)


def key_log(events: DataFrame, size: int | None = None) -> DataFrame:
    """All events, or the newest ``size``; each task keeps only its own newest before they are merged."""
    if size is None:
        return events
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(size)


def events_for_key(events: DataFrame, key_id: str, size: int | None = None) -> DataFrame:
    """All or the newest events of one key; other keys' events do not push them out."""
    return key_log(events.where(F.col("key_id") == key_id), size)


def key_safety_audit(events: DataFrame, prefixes: Sequence[str] = KEY_PREFIXES) -> DataFrame:
    """Keys with a detail that starts like a key or is too long, with the finding text."""
    suspicious = F.octet_length("detail") > MAX_DETAIL_BYTES
    for p in prefixes:
        suspicious = suspicious | F.startswith(F.col("detail"), F.lit(p))
    found = events.where(suspicious).groupBy("key_id").agg(F.count("*").alias("suspicious_events"))
    return found.withColumn("finding", F.format_string(
        "Potential key leak in audit log for key '%s': detail too long or contains key prefix", "key_id"))
