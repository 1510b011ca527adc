"""Checksum validators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "[^0-9]"
_ALNUM = "[^0-9A-Za-z]"
# Fixed value: the largest number an IBAN may expand to (128-bit unsigned).
_MAX_NUMERIC = "340282366920938463463374607431768211455"


def luhn_ok(text: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(text, _DIGITS, "")
    weighted = F.transform(
        F.split(F.reverse(digits), ""),
        lambda ch, i: F.when(
            i % 2 == 1,
            ch.try_cast("int") * 2 - F.when(ch.try_cast("int") > 4, 9).otherwise(0),
        ).otherwise(ch.try_cast("int")),
    )
    total = F.aggregate(weighted, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def iban_ok(text: Column) -> Column:
    """ISO 7064 mod-97 check on the rearranged, digit-expanded account number."""
    cleaned = F.regexp_replace(text, _ALNUM, "")
    rotated = F.concat(F.substring(cleaned, 5, 1 << 20), F.substring(cleaned, 1, 4))
    numbers = F.transform(
        F.split(rotated, ""),
        lambda ch: F.when(ch.rlike("^[0-9]$"), ch).otherwise((F.ascii(ch) - 55).cast("string")),
    )
    numeric = F.array_join(numbers, "")
    remainder = F.aggregate(
        F.split(numeric, ""),
        F.lit(0),
        lambda acc, d: (acc * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97,
    )
    significant = F.ltrim(numeric, F.lit("0"))
    fits = (F.length(significant) < len(_MAX_NUMERIC)) | (
        (F.length(significant) == len(_MAX_NUMERIC)) & (significant <= _MAX_NUMERIC)
    )
    return F.when((F.length(cleaned) >= 5) & fits, remainder == 1).otherwise(False)
