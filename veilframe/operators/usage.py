"""Usage events: cost columns, construction from responses and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import pricing as P
from veilframe.functions.columns import longest_prefix_match
from veilframe.session import lookup_join
from veilframe.sources.usage_store import DEFAULT_TENANT, SCHEMA_VERSION, USAGE_SCHEMA


def with_cost(df: DataFrame, cache_write: bool = False) -> DataFrame:
    """Add cost_estimate_cents, pricing_as_of, cost_unavailable from the static price table."""
    priced = df.withColumn("__price", P.static_price())
    cents = P.cost_cents(
        F.col("__price"), F.col("tokens_in_system"), F.col("tokens_in_user"), F.col("tokens_in_cached"),
        F.col("tokens_out"), F.col("tokens_in_cache_write") if cache_write else None,
    )
    return priced.withColumns({
        "cost_estimate_cents": cents,
        "pricing_as_of": F.lit(P.PRICING_AS_OF),
        "cost_unavailable": F.col("__price").isNull(),
    }).drop("__price")


def with_dynamic_cost(df: DataFrame, prices: DataFrame, prices_as_of: str) -> DataFrame:
    """Cost from a per-token USD table where it knows the model, else from the static table."""
    rates = prices.select(
        F.col("model").alias("__model"), "input_cost_per_token", "output_cost_per_token",
        "cache_read_input_token_cost", "cache_creation_input_token_cost",
    )
    found = longest_prefix_match(df, "model_id", rates, "__model")
    joined = lookup_join(with_cost(df, cache_write=True), found, ["model_id"])
    tokens_in = (F.col("tokens_in_system") + F.col("tokens_in_user")).cast("double")
    total_usd = (
        tokens_in * F.coalesce("input_cost_per_token", F.lit(P.FALLBACK_INPUT_USD))
        + F.col("tokens_in_cached") * F.coalesce("cache_read_input_token_cost", F.lit(0.0))
        + F.col("tokens_in_cache_write") * F.coalesce("cache_creation_input_token_cost", F.lit(0.0))
        + F.col("tokens_out") * F.coalesce("output_cost_per_token", F.lit(P.FALLBACK_OUTPUT_USD))
    )
    known = F.col("__model").isNotNull()
    return joined.withColumns({
        "cost_estimate_cents": F.when(known, F.round(total_usd * 100).cast("bigint")).otherwise(F.col("cost_estimate_cents")),
        "pricing_as_of": F.when(known, F.lit(f"litellm:{prices_as_of}")).otherwise(F.col("pricing_as_of")),
        "cost_unavailable": ~known & F.col("cost_unavailable"),
    }).drop(*rates.columns)


def pricing_coverage(df: DataFrame) -> DataFrame:
    """Distinct models with whether a price is known and their usual system-prompt size."""
    price = P.static_price()
    return df.select("model_id").distinct().select(
        "model_id", price.isNotNull().alias("has_pricing"), P.system_tokens(price).alias("system_tokens")
    )


def split_system_user(tokens_in: Column, tokens_out: Column, system: Column) -> dict[str, Column]:
    """Token columns from a reported input total and the model's usual system prompt."""
    absent = (tokens_in == 0) & (tokens_out == 0)
    zero = F.lit(0).cast("bigint")
    return {
        "tokens_in_system": system,
        "tokens_in_user": F.when(absent, zero).when(tokens_in > system, tokens_in - system).otherwise(tokens_in),
        "tokens_out": F.when(absent, zero).otherwise(tokens_out),
        "token_count_source": F.when(absent, "unavailable").otherwise("api_reported"),
    }


def _finish(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in USAGE_SCHEMA.fields])


def build_events(df: DataFrame) -> DataFrame:
    """Complete events from token counts: defaults, version and static cost."""
    defaults = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "tenant_id": F.lit(DEFAULT_TENANT),
        "retry_attempt": F.lit(0),
        "tokens_truncated": F.lit(0),
        "tokens_in_cache_write": F.lit(0),
        "was_streamed": F.lit(False),
        "was_partial": F.lit(False),
        "actual_cost_cents": F.lit(None).cast("bigint"),
        "success": F.lit(True),
        "event_id": F.uuid(),
    }
    missing = {k: v for k, v in defaults.items() if k not in df.columns}
    return _finish(with_cost(df.withColumns(missing) if missing else df))


def error_events(df: DataFrame) -> DataFrame:
    """Events of failed requests: no tokens, no price, not successful."""
    zero = F.lit(0)
    fields = {
        "schema_version": F.lit(SCHEMA_VERSION), "tenant_id": F.lit(DEFAULT_TENANT), "retry_attempt": zero,
        "tokens_in_system": zero, "tokens_in_user": zero, "tokens_in_cached": zero, "tokens_out": zero,
        "tokens_truncated": zero, "tokens_in_cache_write": zero, "token_count_source": F.lit("unavailable"),
        "was_streamed": F.lit(False), "was_partial": F.lit(False), "actual_cost_cents": F.lit(None),
        "cost_estimate_cents": zero, "pricing_as_of": F.lit(""), "cost_unavailable": F.lit(True),
        "success": F.lit(False),
    }
    if "event_id" not in df.columns:
        fields["event_id"] = F.uuid()
    return _finish(df.withColumns(fields))
