"""Detection: text column in, resolved spans out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.columns import pinned
from veilframe.functions.prefilter import near_rules, needs
from veilframe.functions.recognizers import (
    MIN_CONFIDENCE,
    RECOGNIZERS,
    Recognizer,
    active_recognizers,
)
from veilframe.functions.spans import (
    DENY_CONFIDENCE,
    DENY_TYPE,
    could_match,
    drop_repeated_ranges,
    fold_case,
    is_allowed,
    key_words,
    listed_spans,
    locate_matches,
    match_lists,
    no_spans,
    number_runs,
    ranked,
    resolve_overlaps,
    type_counts,
)


def find_spans(
    df: DataFrame,
    text_col: str = "text",
    recognizers: Sequence[Recognizer] = RECOGNIZERS,
    deny: Sequence[str] = (),
    external: Sequence[Recognizer] = (),
    allow: Sequence[str] = (),
    min_confidence: float = MIN_CONFIDENCE,
    enabled_types: Sequence[str] | None = None,
    feeds: Sequence[str] = (),
    deny_col: str | None = None,
    allow_col: str | None = None,
    deny_spans: str | None = None,
    out: str = "found",
    in_engine: bool = False,
) -> DataFrame:
    """All candidate spans of all layers, before overlap resolution.

    ``feeds`` names span-array columns already on ``df`` (encoder or NER output).
    Denylist and external spans are skipped where an earlier pattern or denylist span
    has exactly the same range; allow patterns drop spans of any layer. ``deny_col`` and
    ``allow_col`` name columns with further patterns for each text (arrays of engine patterns). ``deny_spans`` names a
    column of denylist spans found before; ``deny_col`` then holds (number, pattern) and a pattern ranks by its number.
    The rules' necessary conditions are checked in Arrow batches (``prefilter``); ``in_engine`` checks them in the engine
    instead, slower, where no Python worker may run beside an executor. The spans are the same.
    """
    text = F.col(text_col)
    rules = (
        ranked(active_recognizers(recognizers, min_confidence, enabled_types), "pattern")
        + ranked([Recognizer(DENY_TYPE, DENY_CONFIDENCE, p) for p in deny], "denylist")
        + ranked(active_recognizers(external, min_confidence, enabled_types), "external")
    )
    # Separate projections: regex matching stays in generated code, and each helper column is
    # computed once per text.
    if in_engine:
        step = df.withColumns({"__folded": fold_case(text), "__runs": number_runs(text)})
        step = step.withColumn("__words", key_words(F.col("__folded"), rules))
        checks = [could_match(r.rec, text, F.col("__folded"), F.col("__words"), F.col("__runs")) for r in rules]
    else:
        near = near_rules(text, [r.rec for r in rules])
        step = df if near is None else df.withColumn("__near", near)
        checks = [F.array_contains("__near", i) if needs(r.rec) else None for i, r in enumerate(rules)]
    step = step.withColumn("__lists", match_lists(text, checks, rules))
    step = step.withColumn(out, F.coalesce(locate_matches(F.col("__lists"), rules, allow), no_spans()))
    if deny_col:
        listed = listed_spans(text, F.col(deny_col), len(deny), numbered=deny_spans is not None)
        if deny_spans:
            listed = F.concat(F.col(deny_spans), listed)
        if allow:
            listed = F.filter(listed, lambda s: ~is_allowed(s["text"], allow))
        step = step.withColumn(out, F.concat(out, F.coalesce(listed, no_spans())))
    if deny or external or deny_col:
        step = step.withColumn(out, drop_repeated_ranges(F.col(out)))
    for feed in feeds:
        fed = F.coalesce(F.col(feed), no_spans())
        if allow:
            fed = F.filter(fed, lambda s: ~is_allowed(s["text"], allow))
        step = step.withColumn(out, F.concat(fed, F.col(out)))
    if allow_col:
        patterns = F.col(allow_col)
        step = step.withColumn(out, F.filter(out, lambda s: ~F.exists(patterns, lambda p: F.rlike(s["text"], p))))
    return step.drop("__folded", "__words", "__runs", "__near", "__lists")


def detect(df: DataFrame, text_col: str = "text", out: str = "spans", **layers) -> DataFrame:
    """Add the resolved, sorted, disjoint spans of ``text_col`` as an array column."""
    found = find_spans(df, text_col, out="__all", **layers)
    return pinned(found, {out: resolve_overlaps(F.col("__all"))}).drop("__all")


def explode_spans(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """Span table: one row per finding with the key columns."""
    rows = df.select(*keys, F.explode_outer(spans).alias("s")).where(F.col("s.pii_type").isNotNull())
    return rows.select(
        *keys,
        F.col("s.pii_type").alias("pii_type"),
        F.col("s.text").alias("text"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.col("s.byte_start").alias("byte_start"),
        F.col("s.byte_end").alias("byte_end"),
        F.col("s.confidence").alias("confidence"),
    )


def scan_one(df: DataFrame, rec: Recognizer, text_col: str = "text") -> DataFrame:
    """Span array of a single recognizer (no overlap resolution)."""
    return find_spans(df, text_col, recognizers=(rec,), min_confidence=0.0, out="spans")


def contains_pii(df: DataFrame, text_col: str = "text", **layers) -> DataFrame:
    return (
        detect(df, text_col, out="__spans", **layers)
        .withColumn("has_pii", F.size("__spans") > 0)
        .drop("__spans")
    )


def summarize_by_type(spans: DataFrame, *keys: str) -> DataFrame:
    """Findings per key and type from a span table."""
    return spans.groupBy(*keys, "pii_type").agg(F.count("*").alias("n"))


def entity_counts(df: DataFrame, spans: str = "spans", out: str = "entity_types") -> DataFrame:
    """Per-row type counts as a sorted array, without a shuffle."""
    return df.withColumn(out, type_counts(F.col(spans)))


def explode_counts(df: DataFrame, *keys: str, counts: str = "entity_types") -> DataFrame:
    """One row per text and type from the per-text counts; no shuffle."""
    rows = df.select(*keys, F.explode_outer(counts).alias("c")).where(F.col("c.entity_type").isNotNull())
    return rows.select(*keys, F.col("c.entity_type").alias("pii_type"), F.col("c.count").alias("n"))


def detect_distinct(df: DataFrame, key: str, text_col: str = "text", **layers) -> DataFrame:
    """Detect once per distinct content and hand the spans to every copy.

    The content hash is the join key. Copies shuffle as (key, hash) only; each distinct text
    moves once. A content that makes up much of the table is split by the skew-join rule,
    because its spans sit on the other, unique side.
    """
    hashed = df.withColumn("content_hash", F.sha2(F.col(text_col), 256))
    unique = hashed.select("content_hash", text_col).dropDuplicates(["content_hash"])
    found = detect(unique, text_col, **layers).drop(text_col)
    copies = hashed.select(key, F.col("content_hash").alias("copy_hash"))
    # Null texts have no hash; they meet the one null content.
    joined = copies.join(found, F.col("copy_hash").eqNullSafe(F.col("content_hash")))
    return joined.drop("content_hash").withColumnRenamed("copy_hash", "content_hash")
