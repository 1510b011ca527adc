"""Spans and catalogs reported by other tools as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.recognizers import MIN_CONFIDENCE
from veilframe.functions.spans import external_span, layer_rank
from veilframe.functions.taxonomy import generative_label, normalize_label, type_specificity

ENCODER_DEFAULT, MISSING_SCORE, GENERATIVE_CONFIDENCE = 0.85, 1.0, 0.85
_ANALYZER = "struct<result:array<struct<entity_type:string,start:int,end:int,score:double>>>"
_GENERATED = "array<struct<text:string,start:bigint,end:bigint,label:string>>"
_FIRST_LIST = r"\[(?:\s*\{[^\]]*\}\s*)*+\]"


def encoder_score(score: Column) -> Column:
    """A missing score counts as certain, a non-positive one as the default."""
    given = F.coalesce(score, F.lit(MISSING_SCORE))
    return F.when(given > 0, given).otherwise(F.lit(ENCODER_DEFAULT))


def ingest_external_spans(df: DataFrame, layer: str, text_col: str = "text", reply_col: str = "reply",
                          min_score: float = MIN_CONFIDENCE, out: str = "feed") -> DataFrame:
    """Analyzer replies as a span-array column that ``detect(feeds=[...])`` merges.

    Offsets are characters; ranges outside the text are dropped.
    """
    text = F.col(text_col)
    results = F.from_json(reply_col, _ANALYZER)["result"]

    def span(r: Column, i: Column) -> Column:
        score = encoder_score(r["score"]) if layer == "encoder" else r["score"]
        return external_span(text, r["start"], r["end"], normalize_label(r["entity_type"]), score, F.lit(layer_rank(layer)) + i)

    spans = F.filter(F.transform(results, span), lambda s: s["text"].isNotNull() & (s["confidence"] >= (0.0 if layer == "encoder" else min_score)))
    return df.withColumn(out, spans)


def parse_generated_spans(df: DataFrame, reply_col: str = "reply", out: str = "items") -> DataFrame:
    """Spans from a generative detector's free-form answer.

    The first JSON list in the text is read; items with a missing field are skipped; ends are
    clamped to the start and to the length of the item's own text.
    """
    raw = F.regexp_extract(reply_col, _FIRST_LIST, 0)
    items = F.filter(
        F.from_json(raw, _GENERATED),
        lambda x: x["text"].isNotNull() & x["start"].isNotNull() & x["end"].isNotNull() & x["label"].isNotNull(),
    )
    return df.withColumn(out, F.transform(items, lambda x: F.struct(
        generative_label(x["label"]).alias("pii_type"), x["text"].alias("text"), x["start"].alias("start"),
        F.least(F.greatest(x["end"], x["start"]), F.octet_length(x["text"]) + x["start"]).alias("end"),
        F.lit(GENERATIVE_CONFIDENCE).alias("confidence"),
    )))


def with_specificity(spans: DataFrame) -> DataFrame:
    return spans.withColumn("specificity", type_specificity(F.col("pii_type")))


def read_model_catalogs(df: DataFrame, body_col: str = "body", *keys: str) -> DataFrame:
    """Model names from ``{"data":[{"id"}]}``, a bare list or ``{"models":[...]}``."""
    body = F.col(body_col)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    parsed = F.try_parse_json(body)
    data = F.transform(F.try_variant_get(parsed, "$.data", "array<variant>"), lambda m: text(F.try_variant_get(m, "$.id", "variant")))
    bare = F.transform(F.when(F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY")), F.try_variant_get(parsed, "$", "array<variant>")), text)
    models = F.transform(F.try_variant_get(parsed, "$.models", "array<variant>"), text)
    rows = df.select(*keys, F.posexplode(F.coalesce(data, bare, models)).alias("position", "model"))
    return rows.where(F.col("model").isNotNull())
