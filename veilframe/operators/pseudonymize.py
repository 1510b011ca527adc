"""Replacing findings by typed tokens, and the token map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import bodies as B
from veilframe.functions import tokens as K
from veilframe.functions.columns import pinned
from veilframe.operators.detect import detect

TTL_MINUTES = 30


def assign_tokens(df: DataFrame, spans: str = "spans", out: str = "mappings") -> DataFrame:
    """Per-row token map of the spans: ``[TYPE_n]`` numbered from the last finding backwards."""
    step = df.withColumn("__reps", K.representatives(F.col(spans)))
    return pinned(step, {out: K.number_tokens(F.col("__reps"))}).drop("__reps")


def pseudonymize(df: DataFrame, text_col: str = "text", spans: str = "spans",
                 mappings: str = "mappings", out: str = "sanitized") -> DataFrame:
    """Replace every span by its token. Rows without spans keep their text."""
    return pinned(df, {out: K.replace_spans(F.col(text_col), F.col(spans), F.col(mappings))})


def sanitize(df: DataFrame, text_col: str = "text", **layers) -> DataFrame:
    """Detect, number and replace in one map-only stage."""
    return pseudonymize(assign_tokens(detect(df, text_col, **layers)), text_col)


def token_rows(df: DataFrame, *keys: str, mappings: str = "mappings") -> DataFrame:
    """Token map as rows."""
    rows = df.select(*keys, F.explode_outer(mappings).alias("m")).where(F.col("m.token").isNotNull())
    return rows.select(*keys, "m.token", "m.original", "m.pii_type", "m.confidence")


def scan_report(df: DataFrame, text_col: str = "text", **layers) -> DataFrame:
    """has_pii, per-type counts and the sanitized text (null for clean texts)."""
    from veilframe.operators.detect import entity_counts

    done = entity_counts(sanitize(df, text_col, **layers))
    has = F.size("spans") > 0
    return done.withColumns({
        "has_pii": has, "sanitized_content": F.when(has, F.col("sanitized")),
    }).drop("sanitized")


# ── bodies ──────────────────────────────────────────────────────────────────


def with_texts(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Add the text parts of a body and their joined text."""
    step = pinned(df, {"parts": B.text_parts(F.col(body_col))})
    return pinned(step, {"text": B.extract_text(F.col("parts"))})


def sanitize_bodies(df: DataFrame, body_col: str = "body", **layers) -> DataFrame:
    """Sanitize whole chat bodies; adds parts, text, spans, mappings, sanitized_body.

    Detection sees the joined text and tokens are numbered over the whole request. A finding
    that runs over a part border is cut there, and each part is rebuilt from its own range, so
    texts with line breaks stay in their message and nothing is lost in a round trip.
    """
    step = with_texts(df, body_col)
    step = pinned(detect(step, "text", out="__whole", **layers), {"__ranges": K.part_ranges(F.col("parts"))})
    clipped = K.clip_to_parts(F.col("text"), F.col("__whole"), F.col("__ranges"))
    step = assign_tokens(pinned(step, {"spans": clipped}))
    step = step.withColumn("__new", K.replace_in_parts(
        F.col("parts"), F.col("__ranges"), F.col("text"), F.col("spans"), F.col("mappings")))
    rebuilt = B.rebuild_body(F.col(body_col), F.col("__new"))
    new_body = F.when(F.size("spans") > 0, rebuilt).otherwise(F.col(body_col))
    return pinned(step, {"sanitized_body": new_body}).drop("__new", "__ranges", "__whole")


def sanitize_passthrough(df: DataFrame, body_col: str = "body", **layers) -> DataFrame:
    """Sanitized body only; the token map is not kept."""
    done = sanitize_bodies(df, body_col, **layers)
    return done.select(*[c for c in df.columns if c != body_col], F.col("sanitized_body").alias(body_col))


# ── scopes and lifetime ─────────────────────────────────────────────────────


def session_tokens(spans: DataFrame, scope: str = "session_id") -> DataFrame:
    """Collision-free token map for a whole scope: (scope, original) -> token.

    Values are made distinct with map-side aggregation first. Numbers are given inside 256
    hash groups per (scope, type) and shifted by the sizes of the groups before, so a scope
    that holds much of the data is numbered by many tasks.
    """
    values = spans.groupBy(scope, F.col("text").alias("original")).agg(
        F.min(F.struct("pii_type", "confidence")).alias("t")
    ).select(scope, "original", "t.pii_type", "t.confidence")
    grouped = values.withColumn("grp", F.substring(F.sha2("original", 256), 1, 2))
    sizes = grouped.groupBy(scope, "pii_type", "grp").agg(F.count("*").alias("n"))
    before = Window.partitionBy(scope, "pii_type").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(scope, "pii_type", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy(scope, "pii_type", "grp").orderBy("original")
    numbered = grouped.withColumn("i", F.row_number().over(inside)).join(shifts, [scope, "pii_type", "grp"])
    token = F.concat(F.lit("["), F.col("pii_type"), F.lit("_"), (F.col("i") + F.col("shift")).cast("string"), F.lit("]"))
    return numbered.select(scope, token.alias("token"), "original", "pii_type", "confidence")


def latest_tokens(rows: DataFrame, scope: str = "session_id", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Upsert view of token rows: the latest value of a token in its scope wins."""
    latest = F.max_by(F.struct("original", "pii_type", "confidence", F.col(ts).alias("last_accessed")),
                      F.struct(F.col(ts), F.col(tie)))
    return rows.groupBy(scope, "token").agg(latest.alias("m")).select(scope, "token", "m.*")


def live_mappings(accesses: DataFrame, as_of: str, minutes: int = TTL_MINUTES,
                  scope: str = "session_id", ts: str = "access_ts") -> DataFrame:
    """Tokens whose last add or lookup is within the lifetime."""
    last = accesses.groupBy(scope, "token").agg(F.max(ts).alias("last_accessed"))
    return last.where(F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(minutes)} minutes") <= F.col("last_accessed"))
