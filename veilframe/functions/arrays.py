"""Linear-time steps over the arrays of one row: bound values, running values, ranks, cutting a long text.

The engine's array functions copy or search: a fold copies its accumulator at every step with all that is in it, a
search reads the array from the front, a substring counts characters from the start of the text. Used once per element
they cost the square of the array. The steps here cost its length (sorts: n log n): running values are taken in
blocks of ``BLOCK``, then over the blocks' last values in the same way, so no fold carries more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of a block of a running value, as a power of two. Texts are cut into blocks of so many characters.
BLOCK_BITS = 5
BLOCK = 1 << BLOCK_BITS
TEXT_BITS = 10
TEXT_BLOCK = 1 << TEXT_BITS


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), 0)


def _folded(values: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    """Running values by a plain fold, for a block."""

    def step(acc: Column, x: Column) -> Column:
        value = F.when(F.size(acc) == 0, x).otherwise(join(F.get(acc, F.size(acc) - 1), x))
        return F.concat(acc, F.array(value).cast(f"array<{kind}>"))

    return F.aggregate(values, F.array().cast(f"array<{kind}>"), step)


def running(values: Column, join: Callable[[Column, Column], Column], kind: str = "int", levels: int = 3) -> Column:
    """Running sums, maxima, ... of an array: ``join`` is associative and joins what came before with a value."""

    def whole(v: Column) -> Column:
        small = _folded(v, join, kind)
        if levels == 0:
            return small
        count = F.shiftright(F.size(v) - 1, BLOCK_BITS)
        blocks = F.transform(F.sequence(F.lit(0), count), lambda b: _folded(F.slice(v, F.shiftleft(b, BLOCK_BITS) + 1, F.lit(BLOCK)), join, kind))
        return F.when(F.size(v) <= BLOCK, small).otherwise(bound(blocks, shifted))

    def shifted(blocks: Column) -> Column:
        ends = running(F.transform(blocks, lambda x: F.get(x, F.size(x) - 1)), join, kind, levels - 1)
        return bound(ends, lambda before: F.flatten(F.transform(
            blocks, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: join(F.get(before, i - 1), y))))))

    return bound(values.cast(f"array<{kind}>"), whole)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def group_starts(items: Column, differs: Callable[[Column, Column], Column]) -> Column:
    """For each item the index of the first item of its stretch; ``differs(previous, item)`` begins a new one."""
    marks = F.transform(items, lambda x, i: F.when((i == 0) | differs(F.get(items, i - 1), x), i).otherwise(F.lit(0)))
    return running_max(marks)


def counts_until(points: Column, values: Column, inclusive: bool) -> Column:
    """For each of the points (in their order), how many of the values are less (or equal). Both are integer arrays.

    Points and values are sorted together and counted through.
    """
    marks = F.concat(
        F.transform(values, lambda v: F.struct(v.cast("int").alias("at"), F.lit(0 if inclusive else 2).alias("kind"), F.lit(-1).alias("i"))),
        F.transform(points, lambda p, i: F.struct(p.cast("int").alias("at"), F.lit(1).alias("kind"), i.cast("int").alias("i"))),
    )

    def counted(m: Column) -> Column:
        seen = running_sum(F.transform(m, lambda x: F.when(x["kind"] == 1, 0).otherwise(1)))
        pairs = F.zip_with(m, seen, lambda x, n: F.struct(x["i"].alias("i"), n.alias("n")))
        return F.transform(F.sort_array(F.filter(pairs, lambda x: x["i"] >= 0)), lambda x: x["n"])

    return bound(F.sort_array(marks), counted)


def text_blocks(text: Column) -> Column:
    """A text in blocks of ``TEXT_BLOCK`` characters, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in blocks; costs the length of the piece and one block."""
    start, end = start.cast("int"), end.cast("int")
    i, j = F.shiftright(start, TEXT_BITS), F.shiftright(end, TEXT_BITS)
    offset = start.bitwiseAND(F.lit(TEXT_BLOCK - 1)) + 1
    within = F.substring(F.get(blocks, i), offset, end - start)
    across = F.concat(
        F.substring(F.get(blocks, i), offset, F.lit(TEXT_BLOCK)),
        F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(blocks, j), F.lit(1), end.bitwiseAND(F.lit(TEXT_BLOCK - 1))), F.lit("")),
    )
    return F.coalesce(F.when(i == j, within).otherwise(across), F.lit(""))
