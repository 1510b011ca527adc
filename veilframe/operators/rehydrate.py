"""Putting originals back: texts, JSON bodies, stream chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.bodies import json_string
from veilframe.functions.tokens import JSON_TOKEN_PATTERN, TOKEN_PATTERN


def tokens_in(text: Column) -> Column:
    """Distinct tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)))


def fill_tokens(text: Column, found: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """One pass over the text: known tokens become their values, others stay.

    ``found`` is a map token -> value. The text is cut at tokens, so an inserted value is
    never searched again.
    """
    parts = F.split(text, pattern, -1)
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    filled = F.zip_with(
        parts, tokens,
        lambda g, t: F.concat(g, F.coalesce(F.try_element_at(found, t), t, F.lit(""))),
    )
    return F.when(found.isNull() | (F.size(tokens) == 0), text).otherwise(F.array_join(filled, ""))


def token_values(texts: DataFrame, token_map: DataFrame, key: str, text_col: str, scope: str,
                 value: Column | None = None) -> DataFrame:
    """Per text the map of its tokens' values (key, found).

    Only (key, scope, token) rows are joined, never the texts. A scope with very many texts
    makes a hot join key on the text side only, so skewed partitions can be split. Requests of
    one session reuse token names: the value that came last wins (by ``last_accessed``; without
    that column, the greatest), so the map may hold a token several times.
    """
    wanted = texts.select(key, scope, F.explode(tokens_in(F.col(text_col))).alias("token"))
    shown = F.col("original") if value is None else value
    latest = F.max_by(shown, F.struct("last_accessed", "original")) if "last_accessed" in token_map.columns else F.max(shown)
    values = token_map.groupBy(scope, "token").agg(latest.alias("value"))
    hits = wanted.join(values, [scope, "token"])
    return hits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("found"))


def rehydrate(texts: DataFrame, token_map: DataFrame, key: str, text_col: str = "text",
              scope: str = "session_id", out: str = "rehydrated") -> DataFrame:
    """Texts with all known tokens of their scope replaced by the originals."""
    found = token_values(texts, token_map, key, text_col, scope)
    joined = texts.join(found, key, "left")
    return joined.withColumn(out, fill_tokens(F.col(text_col), F.col("found"))).drop("found")


def escaped_original() -> Column:
    """An original as it must appear inside a JSON string."""
    quoted = json_string(F.col("original"))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def rehydrate_json(bodies: DataFrame, token_map: DataFrame, key: str, body_col: str = "body",
                   scope: str = "session_id", out: str = "rehydrated") -> DataFrame:
    """JSON bodies with tokens inside their text replaced; an unparsable result keeps the old body."""
    found = token_values(bodies, token_map, key, body_col, scope, escaped_original())
    joined = bodies.join(found, key, "left")
    filled = joined.withColumn("__new", fill_tokens(F.col(body_col), F.col("found"), JSON_TOKEN_PATTERN))
    return filled.withColumn(
        out, F.when(F.try_parse_json("__new").isNotNull(), F.col("__new")).otherwise(F.col(body_col))
    ).drop("__new", "found")


def sse_lines(chunk: Column, found: Column, found_json: Column) -> Column:
    """A rehydrated event-stream chunk.

    ``data:`` lines are filled (JSON payloads with escaped values), the end marker stays as it
    is, blank lines go, and the block ends with an empty line.
    """

    def line(x: Column) -> Column:
        payload = F.substring(x, F.lit(7), F.length(x))
        filled = F.when(
            F.try_parse_json(payload).isNotNull(), fill_tokens(payload, found_json, JSON_TOKEN_PATTERN)
        ).otherwise(fill_tokens(payload, found))
        is_data = F.startswith(x, F.lit("data: ")) & (payload != "[DONE]")
        return F.when(is_data, F.concat(F.lit("data: "), filled)).otherwise(x)

    lines = F.filter(F.split(chunk, "\r?\n", -1), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(line(x), F.lit("\n"))), "")
    return F.concat(F.when(body == "", F.lit("\n")).otherwise(body), F.lit("\n"))


def rehydrate_sse(chunks: DataFrame, token_map: DataFrame, keys: list[str], data_col: str = "data",
                  scope: str = "session_id", out: str = "rehydrated") -> DataFrame:
    """Chunk-by-chunk rehydration; every chunk is a text of its own."""
    keyed = chunks.withColumn("__key", F.struct(*keys))
    plain = token_values(keyed, token_map, "__key", data_col, scope)
    inner = token_values(keyed, token_map, "__key", data_col, scope, escaped_original()).withColumnRenamed("found", "found_json")
    joined = keyed.join(plain, "__key", "left").join(inner, "__key", "left")
    return joined.withColumn(
        out, sse_lines(F.col(data_col), F.col("found"), F.col("found_json"))
    ).drop("__key", "found", "found_json")


def roundtrip_check(df: DataFrame, original: str = "text", wire: str = "sanitized",
                    restored: str = "rehydrated", mappings: str = "mappings") -> DataFrame:
    """Per row: restored text equals the original, tokens only on the wire, no original there."""
    wire_tokens = F.regexp_extract_all(F.col(wire), F.lit(TOKEN_PATTERN), F.lit(0))
    return df.withColumns({
        "restored_ok": F.col(original) == F.col(restored),
        "tokens_on_wire": F.size(wire_tokens),
        "tokens_left": F.size(F.array_intersect(
            F.transform(mappings, lambda m: m["token"]),
            F.regexp_extract_all(F.col(restored), F.lit(TOKEN_PATTERN), F.lit(0)))),
        "originals_on_wire": F.size(F.filter(mappings, lambda m: F.contains(F.col(wire), m["original"]))),
    })
