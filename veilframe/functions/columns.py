"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sub-groups per key in two-step ranking: a key holding a third of all rows is ranked by this
# many tasks first.
RANK_SALTS = 64


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that are computed exactly once.

    A filter on a plain projected column is pushed below the projection with its whole
    expression, which would run a detection again for every such filter (and blow up the plan
    where columns build on each other). A one-row generator keeps filters above it.
    """
    one_row = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, one_row)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole as double, ``empty`` when whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def fixed(value: Column, digits: int) -> Column:
    """Number text with fixed digits, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                   salt_by: Column, rank_col: str = "newest_rank") -> DataFrame:
    """Newest ``n`` rows per key, in two ranking steps.

    Rows are first ranked inside salted sub-groups; only the newest ``n`` of each can be among
    the newest ``n`` of the key. The second step ranks at most ``n * RANK_SALTS`` rows per key.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(RANK_SALTS)))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("__rank", F.row_number().over(inner))
        .where(F.col("__rank") <= n)
        .drop("__rank", "__salt")
        .withColumn(rank_col, F.row_number().over(outer))
        .where(F.col(rank_col) <= n)
    )


def previous_value(df: DataFrame, key: str, ts: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Add the value of the row before within a key, in two steps.

    Rows are ordered inside one day of a key; the first row of a day takes the last value of the
    key's day before, from a table with one row per key and day.
    """
    rows = df.withColumns({"__value": value, "__day": F.to_date(ts)})
    inside = Window.partitionBy(key, "__day").orderBy(*order)
    days = rows.groupBy(key, "__day").agg(F.max_by(F.struct("__value"), F.struct(*order)).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(key).orderBy("__day"))
    days = days.select(key, "__day", before["__value"].alias("__before"))
    rows = rows.withColumns({"__prev": F.lag("__value").over(inside), "__n": F.row_number().over(inside)})
    joined = rows.join(days, [key, "__day"])
    return joined.withColumn(
        out, F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__prev"))
    ).drop("__value", "__day", "__prev", "__n", "__before")


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per key the mean of a column and its exact values at given ranks, over all rows.

    ``ranks`` maps result names to the zero-based rank as a function of the number of values; nulls
    do not count. Rows are counted per (key, value) before the shuffle and ranked by running sums of
    the counts, so a hot key costs as much as it has distinct values, and nothing is collected.
    """
    counts = df.groupBy(*keys, F.col(value).alias("__value")).agg(F.count(value).alias("__n"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"__upto": F.sum("__n").over(running), "__all": F.sum("__n").over(group)})
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("__value") * F.col("__n")), F.sum("__n")).alias("mean"),
        *[F.min(F.when(F.col("__upto") > rank(F.col("__all")), F.col("__value"))).alias(name) for name, rank in ranks.items()],
    )


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """Rank round((n-1)*p)."""
    return lambda n: F.round((n - 1) * F.lit(p))


def ceiling_rank(p: float) -> Callable[[Column], Column]:
    """Rank ceil(p*(n-1))."""
    return lambda n: F.ceil(F.lit(p) * (n - 1))


def longest_prefix_match(ids: DataFrame, id_col: str, entries: DataFrame, prefix_col: str) -> DataFrame:
    """Per distinct id the entry whose prefix is the longest one the id starts with.

    Ids are reduced to distinct values and expanded to their own prefixes, so the match is an
    equi-join on the prefix. Ids without a match are left out.
    """
    lengths = F.sequence(F.lit(1), F.greatest(F.length(id_col), F.lit(1)))
    prefixes = (
        ids.select(id_col).where(F.length(id_col) > 0).distinct()
        .withColumn("__len", F.explode(lengths))
        .withColumn("__prefix", F.substring(F.col(id_col), F.lit(1), F.col("__len")))
    )
    payload = [c for c in entries.columns]
    matched = prefixes.join(entries, F.col("__prefix") == F.col(prefix_col))
    return (
        matched.groupBy(id_col)
        .agg(F.max_by(F.struct(*payload), F.col("__len")).alias("m"))
        .select(id_col, *[F.col(f"m.{c}").alias(c) for c in payload])
    )
