"""Price files: JSON objects keyed by model name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE_COLUMNS = (
    "input_cost_per_token", "output_cost_per_token",
    "cache_read_input_token_cost", "cache_creation_input_token_cost",
)


def read_pricing_json(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per model that has at least an input or an output price.

    Entries are kept as JSON text first, so an entry of another shape only drops itself.
    """
    entries = bodies.select(F.explode(F.from_json(body_col, "map<string,string>")).alias("model", "entry"))
    rates = entries.select(
        "model",
        *[F.get_json_object("entry", f"$.{c}").try_cast("double").alias(c) for c in RATE_COLUMNS],
    )
    kept = rates.where(F.col("input_cost_per_token").isNotNull() | F.col("output_cost_per_token").isNotNull())
    return kept.dropDuplicates(["model"])
