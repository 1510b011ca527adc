"""Price tables and integer cost expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cents per million tokens (input, cached input, cache write, output; a cache-write
# price of 0 means the input price) and the usual system-prompt size, as of the date below.
PRICING_AS_OF = "2025-01-15"
PRICES: dict[str, tuple[int, int, int, int, int]] = {
    "gpt-4o": (250, 125, 0, 1000, 500),
    "gpt-4o-mini": (15, 7, 0, 60, 400),
    "gpt-4-turbo": (1000, 500, 0, 3000, 600),
    "gpt-4": (3000, 3000, 0, 6000, 500),
    "gpt-3.5-turbo": (50, 50, 0, 150, 300),
    "o1": (1500, 750, 0, 6000, 800),
    "o1-mini": (300, 150, 0, 1200, 600),
    "o1-pro": (6000, 6000, 0, 6000, 800),
    "o3-mini": (110, 55, 0, 440, 600),
    "gpt-4.1": (200, 50, 0, 800, 500),
    "gpt-4.1-mini": (40, 10, 0, 160, 400),
    "gpt-4.1-nano": (10, 2, 0, 40, 300),
    "claude-3-5-sonnet": (300, 300, 375, 1500, 500),
    "claude-3-opus": (1500, 1500, 1875, 7500, 600),
    "claude-3-haiku": (25, 25, 31, 125, 400),
    "claude-3-5-haiku": (100, 100, 125, 500, 400),
    "claude-sonnet-4": (300, 300, 375, 1500, 500),
    "gemini-1.5-pro": (125, 125, 0, 500, 500),
    "gemini-1.5-flash": (7, 7, 0, 30, 400),
    "gemini-2.0-flash": (10, 10, 0, 40, 400),
    "gemini-2.5-pro": (125, 125, 0, 1000, 600),
}
PRICE_COLUMNS = ("input_cents", "cached_cents", "cache_write_cents", "output_cents", "system_tokens")
_MILLION = 1_000_000

# USD per token where a dynamic price row leaves a price open.
FALLBACK_INPUT_USD, FALLBACK_OUTPUT_USD = 0.000_003, 0.000_015

PRICE_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in PRICE_COLUMNS) + ">"


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(m, *p, PRICING_AS_OF) for m, p in PRICES.items()]
    columns = ", ".join(f"{c} bigint" for c in PRICE_COLUMNS)
    return spark.createDataFrame(rows, f"model string, {columns}, pricing_as_of string")


def static_price(model_col: str = "model_id") -> Column:
    """Price struct of the longest table entry that the model id starts with, else null.

    The table is a fixed handful of rows, so it is part of the expression: no join.
    """
    branches = " ".join(
        f"WHEN startswith({model_col}, '{name}') THEN named_struct("
        + ", ".join(f"'{c}', {v}L" for c, v in zip(PRICE_COLUMNS, PRICES[name])) + ")"
        for name in sorted(PRICES, key=len, reverse=True)
    )
    return F.expr(f"CASE {branches} END").cast(PRICE_STRUCT)


def system_tokens(price: Column) -> Column:
    return F.coalesce(price["system_tokens"], F.lit(0).cast("bigint"))


def _part(tokens: Column, cents: Column) -> Column:
    """Whole cents of one component; every component is floored on its own."""
    return F.call_function("div", tokens * cents, F.lit(_MILLION).cast("bigint"))


def cost_cents(price: Column, system: Column, user: Column, cached: Column, out: Column,
               cache_write: Column | None = None) -> Column:
    """Estimated cents; 0 when the price is unknown."""
    total = (
        _part(system + user, price["input_cents"])
        + _part(cached, price["cached_cents"])
        + _part(out, price["output_cents"])
    )
    if cache_write is not None:
        rate = F.when(price["cache_write_cents"] > 0, price["cache_write_cents"]).otherwise(price["input_cents"])
        total = total + _part(cache_write, rate)
    return F.coalesce(total, F.lit(0).cast("bigint"))


def usd(cents: Column) -> Column:
    return F.format_string("$%.2f", cents / F.lit(100.0))
