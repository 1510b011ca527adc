"""Provider routing by model prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import lookup_join

# The well-known providers with their models, in routing order.
DEFAULT_PROVIDERS = (
    ("openai-default", "OpenAI", "https://api.openai.com/v1",
     ("gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo", "o1", "o1-mini", "o3-mini")),
    ("anthropic-default", "Anthropic", "https://api.anthropic.com/v1",
     ("claude-sonnet-4-20250514", "claude-sonnet-4", "claude-opus-4-20250514", "claude-opus-4",
      "claude-3.5-sonnet", "claude-3.5-haiku", "claude-3-opus")),
)


def provider_dim(spark: SparkSession, providers=DEFAULT_PROVIDERS) -> DataFrame:
    """One row per provider and model, with the position of both."""
    rows = [(i, pid, name, url, list(models)) for i, (pid, name, url, models) in enumerate(providers)]
    df = spark.createDataFrame(
        rows, "position int, provider_id string, provider string, base_url string, models array<string>")
    return df.select("position", "provider_id", "provider", "base_url",
                     F.posexplode("models").alias("model_position", "model_prefix"))


def _first_match(models: DataFrame, providers: DataFrame, id_col: str, not_name: str | None = None) -> DataFrame:
    """Per distinct model the first provider with a model that is a prefix of it.

    Models are expanded to their own prefixes, so this is an equi-join of distinct ids.
    """
    entries = providers.select("position", "provider", F.col("model_prefix").alias("__entry"))
    keep = [id_col] + ([not_name] if not_name else [])
    ids = models.select(*keep).where(F.length(id_col) > 0).distinct()
    prefixes = ids.withColumn("__n", F.explode(F.sequence(F.lit(1), F.length(id_col)))).withColumn(
        "__entry", F.substring(F.col(id_col), F.lit(1), F.col("__n")))
    hits = prefixes.join(entries, "__entry")
    if not_name:
        hits = hits.where(F.col("provider") != F.col(not_name))
    return hits.groupBy(*keep).agg(F.min_by("provider", "position").alias("__provider"))


def resolve_provider(df: DataFrame, providers: DataFrame, model_col: str = "model_id") -> DataFrame:
    """Add provider and, where none matches, an error text."""
    found = _first_match(df, providers, model_col)
    joined = lookup_join(df, found, [model_col])
    return joined.withColumns({
        "provider": F.col("__provider"),
        "route_error": F.when(F.col("__provider").isNull(), F.concat(F.lit("No provider configured for model: "), F.col(model_col))),
    }).drop("__provider")


def failover_provider(df: DataFrame, providers: DataFrame, model_col: str = "model_id",
                      failed_col: str = "provider", out: str = "failover") -> DataFrame:
    """First provider for the model other than the failed one, else null."""
    found = _first_match(df.where(F.col(failed_col).isNotNull()), providers, model_col, failed_col) if failed_col != "provider" else (
        _first_match(df.withColumnRenamed("provider", "__failed").where(F.col("__failed").isNotNull()), providers, model_col, "__failed")
        .withColumnRenamed("__failed", "provider"))
    return lookup_join(df, found, [model_col, failed_col]).withColumnRenamed("__provider", out)


def passthrough_provider(df: DataFrame, providers: DataFrame, model_col: str = "model_id") -> DataFrame:
    """Provider of the model, or the first provider where none matches."""
    first = providers.agg(F.min_by("provider", "position")).scalar()
    routed = resolve_provider(df, providers, model_col)
    return routed.withColumn("provider", F.coalesce(F.col("provider"), first)).drop("route_error")
