"""Mixing sources to target weights by hierarchical budgeting.

A token budget is divided down a tree (domain, language, source). Each node's budget goes to its
children by weight, but no child gets more than it can give: its tokens times the most epochs. What
a child cannot take goes to its siblings first, by weight, until they are full too; only what a
whole node cannot take goes to the node's own siblings. The division of one node is exact, in one
pass: children sorted by capacity over weight, the full ones are a prefix, and the rest share what
is left. Nodes are rows and the division is a window over siblings, so the number of sources is
not limited by the driver.

Each leaf then takes whole epochs and a prefix of one more. An epoch's order is a hash of the seed,
the epoch and the row. A leaf may hold a large part of all rows, so the prefix is found by
pre-aggregated sums over ranges of the hash (their number follows the largest leaf): ranges before
the border are taken, and only rows in the border range are put in order.

Defined results: rows whose level columns are null form a node of their own (weight: that of
``None``, else the default); empty and null texts have no tokens and are taken with every whole
epoch only; repeated rows are separate rows, told apart by their place in a written table; a
budget beyond all capacity gives every row the most epochs; weights of zero or less give nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import sized_join, written

ROWS_PER_RANGE = 4096


def word_count(text: str | Column) -> Column:
    """Words between white space: the token measure without a tokenizer."""
    column = F.col(text) if isinstance(text, str) else text
    flat = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def _weight(column: Column, weights: Mapping | None) -> Column:
    out = F.lit(float((weights or {}).get("*", 1.0)))
    for name, weight in (weights or {}).items():
        if name != "*":
            out = F.when(column.eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(out)
    return out


def divide(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Give each child (columns ``parents``, ``name``, capacity, weight, pool) its part of the pool of its parent."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    rows = children.withColumn("ratio", ratio).withColumn("open", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    group = Window.partitionBy(*parents)
    order = group.orderBy(F.col("ratio").asc_nulls_last(), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "spent": F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(before), F.lit(0)),
        "left": F.sum("open").over(group) - F.coalesce(F.sum("open").over(before), F.lit(0.0)),
    })
    # What one unit of weight gets if all before this child are full; the first that is not full sets it.
    level = F.try_divide((F.col("pool") - F.col("spent")).cast("double"), F.col("left"))
    full = (F.col("weight") > 0) & (F.col("ratio") <= level)
    rows = rows.withColumn("level", F.when(F.col("weight") > 0, level)).withColumn("full", F.coalesce(full, F.lit(False)))
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(group)
    part = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.least(F.col("weight") * share, F.col("capacity").cast("double")))
    return rows.withColumn("budget", F.floor(F.greatest(part, F.lit(0.0)) + F.lit(1e-6)).cast("long"))


def _with_pool(nodes: DataFrame, pools: DataFrame, names: Sequence[str]) -> DataFrame:
    """Nodes with the pool of their parent; null names meet null names."""
    up = pools.select(*[F.col(c).alias(f"up_{c}") for c in names], "pool")
    return nodes.join(up, [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in names]).drop(*[f"up_{c}" for c in names])


def budgets(totals: DataFrame, levels: Sequence[str], budget: int, weights: Mapping[str, Mapping] | None, epochs: int) -> DataFrame:
    """Leaf budgets for totals (levels, tokens, rows) of every leaf."""
    weights = weights or {}
    leaves = totals.withColumn("capacity", F.col("tokens") * epochs)
    pool = None
    for depth, name in enumerate(levels):
        upper, path = list(levels[:depth]), list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.col(name), weights.get(name)))
        if pool is None:
            nodes = nodes.withColumn("pool", F.lit(budget).cast("long"))
        else:
            nodes = _with_pool(nodes, pool, upper)
        pool = divide(nodes, upper, name).select(*path, F.col("budget").alias("pool"))
    return _with_pool(leaves, pool, levels).select(*levels, "tokens", "n_rows", F.col("pool").alias("budget"))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    budget_share: float,
    weights: Mapping[str, Mapping] | None = None,
    epochs: int = 2,
    seed: int = 42,
    tokens: Column | None = None,
    text_col: str = "text",
    id_cols: Sequence[str] = ("doc_id",),
    key_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Decisions for written rows: levels, n_tokens, n_copies (how often the row is taken) and the leaf's budget.

    ``levels`` maps level names, root first, to columns; ``weights`` maps level names to weights by
    value ("*" for all others). The budget is a share of all tokens. The draw depends on ``key_cols`` (the id columns,
    if not given) and the text.
    """
    order_key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols or id_cols]
    rows = written(docs.select(
        *[F.col(c).alias(f"id_{i}") for i, c in enumerate(id_cols)],
        *[c.alias(n) for n, c in levels.items()],
        (tokens if tokens is not None else word_count(text_col)).cast("long").alias("n_tokens"),
        F.xxhash64(*order_key, F.col(text_col)).alias("row_key"),
        F.monotonically_increasing_id().alias("place"),
    ), "mix-rows")
    return decide(rows, list(levels), budget_share, weights, epochs, seed)


def decide(rows: DataFrame, names: list[str], budget_share: float, weights, epochs: int, seed: int) -> DataFrame:
    """``mix`` for a written table with the level columns, n_tokens, row_key and place."""
    totals = written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")), "leaves")
    everything, largest = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("n_rows"), F.lit(0))).first()
    leaves = budgets(totals, names, int(everything * budget_share), weights, epochs)
    leaves = written(leaves.select(
        *[F.col(n).alias(f"leaf_{n}") for n in names], "budget",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.when(F.col("budget") > 0, F.lit(1)).otherwise(0)).cast("long").alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).cast("long").alias("rest"),
    ), "leaf-budgets")
    ranges = 2 ** max(0, math.ceil(math.log2(max(1, largest / ROWS_PER_RANGE))))
    on = [F.col(n).eqNullSafe(F.col(f"leaf_{n}")) for n in names]
    joined = sized_join(rows, leaves, on, "inner").drop(*[f"leaf_{n}" for n in names])
    draw = F.xxhash64(F.lit(seed), F.col("whole"), F.col("row_key"))
    drawn = written(joined.withColumn("draw", draw).withColumn("range", F.pmod(F.shiftrightunsigned("draw", 11), F.lit(ranges))), "drawn")
    sums = drawn.where("rest > 0").groupBy(*names, "range").agg(F.sum("n_tokens").alias("in_range"), F.first("rest").alias("rest"))
    running = F.sum("in_range").over(Window.partitionBy(*names).orderBy("range"))
    sums = sums.withColumn("until", running).withColumn("from", F.col("until") - F.col("in_range"))
    edges = written(sums.where("from <= rest").select(
        *[F.col(n).alias(f"leaf_{n}") for n in names], F.col("range").alias("at_range"), F.col("from"), (F.col("until") <= F.col("rest")).alias("inside")
    ), "edges")
    on = [*on, F.col("range") == F.col("at_range")]
    near = sized_join(drawn, edges, on, "left").drop(*[f"leaf_{n}" for n in names], "at_range")
    border = near.where("rest > 0 and not inside")
    order = Window.partitionBy(*names).orderBy("draw", "place")
    border = border.withColumn("taken", F.col("from") + F.sum("n_tokens").over(order) <= F.col("rest"))
    sure = near.where("rest <= 0 or inside or inside is null").withColumn("taken", F.coalesce(F.col("inside"), F.lit(False)) & (F.col("rest") > 0))
    return sure.unionByName(border).withColumn("n_copies", F.col("whole") + F.col("taken").cast("long")).drop("from", "inside", "taken", "draw", "range", "whole", "rest", "row_key", "place")
