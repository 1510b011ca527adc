"""Scoring: leak audit, corpus coverage, span scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.columns import count_where, ratio

WIRE_TOKEN = r"\[\s*([A-Z][A-Z0-9_]*)\s*_\d+\s*\]"


def escape_non_ascii(text: Column) -> Column:
    """Text as an ASCII-only JSON writer puts it: every non-ASCII character as ``\\uXXXX``."""

    def one(ch: Column) -> Column:
        code = F.lower(F.lpad(F.hex(F.ascii(ch)), 4, "0"))
        return F.when(F.octet_length(ch) > 1, F.concat(F.lit("\\u"), code)).otherwise(ch)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def raw_leaks(wire: DataFrame, terms: DataFrame, key: str, wire_col: str = "wire") -> DataFrame:
    """Sensitive terms that still appear in the wire text of their own row, plain or escaped."""
    joined = wire.join(terms.select(key, "term"), key)
    hit = F.contains(F.col(wire_col), F.col("term")) | F.contains(F.col(wire_col), escape_non_ascii(F.col("term")))
    return joined.where(hit).select(key, "term")


def corpus_coverage(expected: DataFrame, wire: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Per corpus row whether a token of an accepted type is on the wire, and all types seen."""
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all("wire", F.lit(WIRE_TOKEN), F.lit(1))))
    seen = wire.select(key, tokens.alias("seen"))
    types = accepted.groupBy("label").agg(F.collect_set("pii_type").alias("ok_types"))
    joined = expected.join(seen, key).join(types, "label", "left")
    matched = F.array_sort(F.array_intersect("seen", F.coalesce("ok_types", F.array().cast("array<string>"))))
    return joined.select(
        key, "label", (F.size(matched) > 0).alias("ok"), F.array_join(matched, ",").alias("matched"),
        F.array_join("seen", ",").alias("seen"),
    )


def coverage_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), count_where(F.col("ok")).alias("ok"), count_where(~F.col("ok")).alias("miss"))


def span_scores(pred: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("doc_id", "start", "end")) -> DataFrame:
    """Strict precision, recall, F1 and F2 per type from exact spans."""
    on = [*keys, "pii_type"]
    p = pred.select(*on, F.lit(1).alias("p")).distinct()
    g = gold.select(*on, F.lit(1).alias("g")).distinct()
    both = p.join(g, on, "full_outer")
    sums = both.groupBy("pii_type").agg(
        F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("g").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("p").isNull(), 1)).alias("fn"),
    )
    scored = sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0),
    })
    return scored.withColumns({"f1": f_beta(1), "f2": f_beta(2)})


def f_beta(beta: int) -> Column:
    p, r = F.col("precision"), F.col("recall")
    below = p * (beta * beta) + r
    return F.when(below > 0, p * r * (1 + beta * beta) / below).otherwise(0.0)
