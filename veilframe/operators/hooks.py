"""Plugging in models: span finders and scorers as vectorized Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.spans import external_span, layer_rank
from veilframe.functions.taxonomy import normalize_label

# A finder maps a batch of texts to one list of (label, start, end, score) per text.
Finder = Callable[[pd.Series], list[list[tuple[str, int, int, float]]]]
_RAW = "array<struct<label:string,start:int,end:int,score:double>>"


def _found(finder: Finder, texts: pd.Series) -> list[list[tuple[str, int, int, float]]]:
    """Findings of each text; a text that makes the finder raise has none."""
    try:
        return list(finder(texts))
    except Exception:
        if len(texts) <= 1:
            return [[] for _ in range(len(texts))]
        half = len(texts) // 2
        return _found(finder, texts.iloc[:half]) + _found(finder, texts.iloc[half:])


def model_spans(df: DataFrame, finder: Finder, layer: str = "ner", text_col: str = "text", out: str = "feed") -> DataFrame:
    """Run a span finder over batches of texts and add its spans as a feed column.

    If the finder raises, the batch is halved until the failing texts stand alone; only those
    give no spans, and detection goes on with the other layers.
    """
    kept = df.schema
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _found(finder, batch[text_col])
            rows = [[{"label": a, "start": b, "end": c, "score": d} for a, b, c, d in spans] for spans in found]
            yield batch.assign(__raw=rows)[[*names, "__raw"]]

    from pyspark.sql import types as T

    schema = T.StructType([*kept.fields, T.StructField("__raw", T._parse_datatype_string(_RAW))])
    raw = df.mapInPandas(run, schema)
    text = F.col(text_col)
    spans = F.filter(
        F.transform("__raw", lambda r, i: external_span(
            text, r["start"], r["end"], normalize_label(r["label"]), r["score"], F.lit(layer_rank(layer)) + i)),
        lambda s: s["text"].isNotNull(),
    )
    return raw.withColumn(out, spans).drop("__raw")


def model_scores(df: DataFrame, scorer: Callable[[pd.Series, str], pd.Series], rules, text_col: str = "user_text") -> DataFrame:
    """Score every text against every rule with a vectorized scorer; adds ``violations``.

    One Python pass per batch covers all rules. Scores above the floor become violations over
    the whole text.
    """
    from veilframe.operators.policy import SCORE_FLOOR, VIOLATION

    rules = list(rules)

    @F.pandas_udf("array<double>")
    def score_all(texts: pd.Series) -> pd.Series:
        if not rules:
            return pd.Series([[] for _ in range(len(texts))])
        scores = np.column_stack([np.asarray(scorer(texts, r.text), dtype="float64") for r in rules])
        return pd.Series(list(scores))

    facts = F.array(*[F.struct(F.lit(r.index).alias("i"), F.lit(r.text).alias("t"), F.lit(r.action).alias("a")) for r in rules])
    text = F.col(text_col)
    scored = df.withColumn("__scores", score_all(F.coalesce(text, F.lit(""))))
    hits = F.zip_with(facts, "__scores", lambda r, s: F.struct(
        r["i"].alias("rule_index"), r["t"].alias("rule_text"), r["a"].alias("action"), text.alias("token_text"),
        F.lit(0).alias("start"), F.length(text).alias("end"), s.alias("score")).cast(VIOLATION))
    return scored.withColumn("violations", F.filter(hits, lambda v: v["score"] > SCORE_FLOOR)).drop("__scores")
