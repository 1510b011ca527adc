"""Allow and deny lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.recognizers import pattern_error

PATTERN_MAX, LABEL_MAX = 500, 200
_RULE = "struct<id:string,pattern:string,label:string,created_at:string,enabled:boolean>"
LISTS_SCHEMA = f"allowlist array<{_RULE}>, denylist array<{_RULE}>"


def read_rule_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rules of both lists as rows with a ``list`` column; one JSON document per line and owner."""
    docs = spark.read.schema(f"owner string, {LISTS_SCHEMA}").json(path)
    return explode_lists(docs, "owner")


def explode_lists(docs: DataFrame, *keys: str) -> DataFrame:
    parts = [
        docs.select(*keys, F.lit(name).alias("list"), F.explode(f"{name}list").alias("r")).select(*keys, "list", "r.*")
        for name in ("allow", "deny")
    ]
    return parts[0].unionByName(parts[1])


def write_rule_lists(rules: DataFrame, path: str) -> None:
    """One JSON document with both lists per owner; an owner's hand-written rules are one row."""
    pick = lambda name: F.collect_list(F.when(F.col("list") == name, F.struct("id", "pattern", "label", "created_at", "enabled")))
    docs = rules.groupBy("owner").agg(pick("allow").alias("allowlist"), pick("deny").alias("denylist"))
    docs.write.mode("overwrite").json(path)


def _checked(rules: DataFrame) -> DataFrame:
    """Trimmed rules with the reason against them, null for usable ones. Lengths are bytes."""
    pattern = F.trim("pattern")
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), pattern)
    reason = (
        F.when(F.coalesce(F.col("pattern"), F.lit("")) == "", "blank pattern")
        .when(F.octet_length("pattern") > PATTERN_MAX, "pattern too long")
        .when(F.octet_length("label") > LABEL_MAX, "label too long")
    )
    return rules.withColumns({"pattern": pattern, "label": label}).withColumn("reason", reason)


def validate_rules(rules: DataFrame) -> DataFrame:
    """Trimmed rules with a usable pattern and label; the others are in ``rejected_rules``.

    Pattern syntax is checked when a list is loaded (``rule_patterns``).
    """
    return _checked(rules).where(F.col("reason").isNull()).drop("reason")


def rejected_rules(rules: DataFrame) -> DataFrame:
    """Rules that ``validate_rules`` leaves out, with the ``reason``."""
    return _checked(rules).where(F.col("reason").isNotNull())


def load_patterns(rules: DataFrame, name: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Enabled patterns of a list by age and id, and those with bad syntax with the message.

    They become part of the plan; for tables that grow there is ``detect_with_rule_table``.
    """
    order = [c for c in ("created_at", "id", "pattern") if c in rules.columns]
    rows = rules.where((F.col("list") == name) & F.col("enabled")).orderBy(*order).select("pattern").collect()
    errors = {r["pattern"]: pattern_error(rules.sparkSession, r["pattern"]) for r in rows}
    good = [r["pattern"] for r in rows if errors[r["pattern"]] is None]
    return good, [(p, e) for p, e in errors.items() if e is not None]


def rule_patterns(rules: DataFrame, name: str) -> list[str]:
    """Enabled patterns of a list in order, for ``detect(allow=..., deny=...)``."""
    return load_patterns(rules, name)[0]
