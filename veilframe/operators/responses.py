"""Token usage from provider responses and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import pricing as P
from veilframe.operators.usage import build_events, split_system_user

_USAGE = (
    "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, "
    "prompt_tokens_details struct<cached_tokens:bigint>, input_tokens bigint, output_tokens bigint, "
    "cache_creation_input_tokens bigint, cache_read_input_tokens bigint, cost_usd double"
)
RESPONSE = f"struct<model:string,cost_usd:double,usage:struct<{_USAGE.replace(' bigint', ':bigint').replace(' double', ':double').replace('details struct', 'details:struct')}>>"
STREAM_LINE = RESPONSE.replace("struct<model", "struct<delta:struct<usage:" + RESPONSE.split("usage:", 1)[1][:-1] + ">,model", 1)


def _count(value: Column) -> Column:
    """A reported count; absent or negative is 0."""
    return F.when(value >= 0, value).otherwise(F.lit(0).cast("bigint"))


def parse_response(response: Column) -> Column:
    return F.from_json(response, RESPONSE)


def openai_usage(usage: Column) -> dict[str, Column]:
    prompt, completion = _count(usage["prompt_tokens"]), _count(usage["completion_tokens"])
    return {
        "prompt_tokens": prompt,
        "completion_tokens": completion,
        "cached_tokens": _count(usage["prompt_tokens_details"]["cached_tokens"]),
        "total_tokens": F.coalesce(usage["total_tokens"], prompt + completion),
    }


def anthropic_usage(usage: Column) -> dict[str, Column]:
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return {n: _count(usage[n]) for n in names}


def provider_cost_cents(parsed: Column, is_anthropic: Column) -> Column:
    nested = F.when(is_anthropic, parsed["usage"]["cost_usd"])
    return F.round(F.coalesce(parsed["cost_usd"], nested) * 100).cast("bigint")


def reported(usage: Column, is_anthropic: Column) -> dict[str, Column]:
    """Input, output, cached and cache-write counts of either family."""
    o, a = openai_usage(usage), anthropic_usage(usage)
    pick = lambda x, y: F.when(is_anthropic, x).otherwise(y)
    return {
        "in": pick(a["input_tokens"], o["prompt_tokens"]),
        "out": pick(a["output_tokens"], o["completion_tokens"]),
        "cached": pick(a["cache_read_input_tokens"], o["cached_tokens"]),
        "cache_write": pick(a["cache_creation_input_tokens"], F.lit(0).cast("bigint")),
    }


def usage_events_from_responses(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Complete usage events of successful responses."""
    step = df.withColumn("__r", parse_response(F.col(response_col)))
    step = step.withColumns({f"__{k}": v for k, v in reported(F.col("__r.usage"), F.col("is_anthropic")).items()})
    system = P.system_tokens(P.static_price())
    absent = (F.col("__in") == 0) & (F.col("__out") == 0)
    zero = F.lit(0).cast("bigint")
    step = step.withColumns({
        **split_system_user(F.col("__in"), F.col("__out"), system),
        "tokens_in_cached": F.when(absent, zero).otherwise(F.col("__cached")),
        "tokens_in_cache_write": F.when(absent, zero).otherwise(F.col("__cache_write")),
        "actual_cost_cents": provider_cost_cents(F.col("__r"), F.col("is_anthropic")),
    })
    return build_events(step)


# ── streams ─────────────────────────────────────────────────────────────────


def is_usage_chunk(data: Column, is_anthropic: Column) -> Column:
    has = F.contains(data, F.lit('"usage"')) | (is_anthropic & F.contains(data, F.lit('"message_stop"')))
    return (data != "[DONE]") & has


def is_end_marker(data: Column) -> Column:
    return F.trim(F.regexp_replace(data, r"^\s+|\s+$", "")).isin("data: [DONE]", "[DONE]")


def close_streams(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per stream the last usage chunk, the chunk count and the end marker.

    All three are map-side aggregates; chunks of one stream are never collected.
    """
    data = F.col("data")
    anthropic = F.startswith("model_id", F.lit("claude"))
    rows = chunks.where(data != "")
    return rows.groupBy(*keys).agg(
        F.max_by(F.when(is_usage_chunk(data, anthropic), data), F.when(is_usage_chunk(data, anthropic), F.col("seq"))).alias("last_usage"),
        F.count("*").alias("chunk_count"),
        F.bool_or(is_end_marker(data)).alias("ended"),
    )


def partial_flag(last_usage: Column, ended: Column, chunk_count: Column) -> Column:
    return last_usage.isNull() & (~ended | (chunk_count < 3))


def stream_usage(chunk: Column, is_anthropic: Column) -> Column:
    """Counts (in, out, cached) of the first usable line of a chunk, null if there is none."""

    def counts(line: Column) -> Column:
        text = F.trim(F.regexp_replace(line, "^data: ", ""))
        parsed = F.from_json(text, STREAM_LINE)
        usage = F.when(parsed["usage"].isNotNull(), parsed["usage"]).otherwise(F.when(is_anthropic, parsed["delta"]["usage"]))
        r = reported(usage, is_anthropic)
        return F.struct(r["in"].alias("in"), r["out"].alias("out"), r["cached"].alias("cached"))

    lines = F.transform(F.split(chunk, "\r?\n", -1), counts)
    return F.get(F.filter(lines, lambda c: (c["in"] > 0) | (c["out"] > 0)), 0)


def usage_events_from_streams(closed: DataFrame) -> DataFrame:
    """Usage events of closed streams: estimated when no usage arrived."""
    anthropic = F.startswith("model_id", F.lit("claude"))
    step = closed.withColumn("__u", stream_usage(F.col("last_usage"), anthropic))
    system = P.system_tokens(P.static_price())
    zero = F.lit(0).cast("bigint")
    known = F.col("__u").isNotNull()
    user = F.when(F.col("__u.in") > system, F.col("__u.in") - system).otherwise(F.col("__u.in"))
    step = step.withColumns({
        "tokens_in_system": system,
        "tokens_in_user": F.when(known, user).otherwise(zero),
        "tokens_in_cached": F.when(known, F.col("__u.cached")).otherwise(zero),
        "tokens_out": F.when(known, F.col("__u.out")).otherwise(zero),
        "token_count_source": F.when(known, "api_reported").otherwise("estimated"),
        "was_partial": partial_flag(F.col("last_usage"), F.col("ended"), F.col("chunk_count")),
        "was_streamed": F.lit(True),
        "tool_name": F.lit("chat_completions"),
    })
    return build_events(step.withColumn("success", F.col("tokens_out") > 0))
