"""Places of pattern matches in a text as column expressions, in time linear in the text.

Matches and the gaps between them alternate, so running sums of their lengths give the places.
Sums are taken in blocks of ``BLOCK`` and over blocks, which keeps a text of many thousand matches
cheap without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times but compute it once."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of integers."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))
        return let(before, lambda offset: F.transform(
            values,
            lambda _, i: F.element_at(offset, F.floor(i / BLOCK).cast("int") + 1) + total(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
        ))

    return let(numbers, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(of(v)))


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """Array of struct(first, last, text[, before, after]) of all matches; ``last`` is exclusive, in code points.

    The pattern must not match the empty string. ``before`` and ``after`` are up to ``context``
    characters of the gaps around a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def around(m: Column, g: Column) -> Column:
        lengths = F.transform(m, lambda x, i: F.length(x) + F.length(g[i]))
        fields = lambda x, i, last: [
            (last - F.length(x)).alias("first"), last.alias("last"), x.alias("text"),
            *([F.right(g[i], F.lit(context)).alias("before"), F.left(g[i + 1], F.lit(context)).alias("after")] if context else []),
        ]
        return let(running_sums(lengths), lambda ends: F.transform(m, lambda x, i: F.struct(*fields(x, i, ends[i]))))

    return let(found, lambda m: let(gaps, lambda g: around(m, g)))
