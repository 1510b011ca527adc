"""Clipboard scans and the users' answers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.columns import previous_value
from veilframe.operators.detect import detect, entity_counts
from veilframe.operators.pseudonymize import sanitize

# Answers and what they turn a pending event into.
ANSWERS = {"sanitize": "Sanitized", "allow": "Allowed", "block": "Blocked"}


def changed_contents(df: DataFrame, key: str = "client", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Rows whose content differs from the one before of the same client.

    Only content hashes go through the ordered pass.
    """
    hashed = df.select(key, ts, tie, F.sha2("content", 256).alias("h"))
    rows = previous_value(hashed, key, ts, [ts, tie], F.col("h"), "before")
    fresh = rows.where(~F.col("h").eqNullSafe(F.col("before"))).select(tie)
    return df.join(fresh, tie, "left_semi")


def clipboard_scan(df: DataFrame, key: str = "client", ts: str = "ts", tie: str = "event_id", **layers) -> DataFrame:
    """Pending events for changed contents with findings."""
    scanned = entity_counts(detect(changed_contents(df, key, ts, tie), "content", **layers), out="detected_entities")
    return scanned.where(F.size("spans") > 0).select(
        tie, key, ts, F.octet_length("content").alias("content_length"), "detected_entities",
        F.lit("pending").alias("action"),
    )


def clipboard_respond(events: DataFrame, responses: DataFrame, key: str = "client", ts: str = "ts") -> DataFrame:
    """Answer the latest pending event before each valid response; each event is answered once.

    Events and responses of a client form one ordered stream. A response meets an event exactly
    when the row before it is that event; invalid responses are left out first.
    """
    valid = responses.where(F.col("response").isin(*ANSWERS))
    cols = [key, ts]
    both = events.select(*cols, "event_id", F.lit(None).cast("string").alias("response"), F.lit(0).alias("kind")).unionByName(
        valid.select(*cols, F.lit(None).cast("bigint").alias("event_id"), "response", F.lit(1).alias("kind")))
    marked = previous_value(both.withColumn("tie", F.coalesce("event_id", F.lit(-1))), key, ts, [ts, "kind", "tie"],
                            F.struct("kind", "event_id"), "before")
    hit = marked.where((F.col("kind") == 1) & (F.col("before.kind") == 0))
    action = F.create_map(*[F.lit(x) for kv in ANSWERS.items() for x in kv])[F.col("response")]
    return hit.select(key, F.col("before.event_id").alias("event_id"), F.col(ts).alias("answered_at"), action.alias("action"))


def invalid_responses(responses: DataFrame) -> DataFrame:
    return responses.where(~F.coalesce(F.col("response").isin(*ANSWERS), F.lit(False))).withColumn(
        "error", F.lit("Invalid response. Use: sanitize, allow, or block"))


def clipboard_sanitize(df: DataFrame, **layers) -> DataFrame:
    return sanitize(df, "content", **layers)
