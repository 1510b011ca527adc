"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its place in that order
as a share of the source, (rank + phase) / rows, with a phase from 0 to 1 of the source's own (seeded as well, so that
sources of a few rows do not all stand in the same places). Sorted by fractional rank, every stretch of rows holds the
sources in their proportions, so cutting the order into equal stretches gives shards that match the mixture: row
counts are at most one apart, a source's rows are evenly spaced over the shards, and a share is off by what the
phases of the sources add up to, about the root of their number in rows.

Both orders are made by range-dealt sorting (``common.ranked``): no task sees more than one range of rows, however
many a source has. Rows move twice, as id, size, checksum and source; texts are read once and never move.

Defined results: null texts count as empty in size and checksum; rows without a source are a source of their own;
repeated rows are separate rows (equal in all that is returned, so their order does not matter); with fewer rows than
shards some shards are empty; an empty table gives no rows; other columns are ignored, whatever they are called.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ranked, sized_join, written

SHARDS, SEED, OVERHEAD = 40, 42, 16


def shuffle_key(seed: int, value: Column) -> Column:
    """60 bits of a hash of seed and value, as a whole number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, source, size, crc, shard and slot (its place in the shard)."""
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = written(docs.select(
        ident.alias("id"), F.col(f"`{source_col}`").alias("source"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("crc"), shuffle_key(seed, ident).alias("draw"), F.monotonically_increasing_id().alias("row"),
    ), "sizes")
    # Ranks through all sources: a source's rows follow each other, its first rank is their least.
    drawn = ranked(rows, ["source", "draw", "id", "size", "crc", "row"], "at", "drawn")
    drawn = written(drawn, "drawn-ranks")
    sources = written(drawn.groupBy(F.col("source").alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("rows")), "sources")
    placed = sized_join(drawn, sources, F.col("source").eqNullSafe(F.col("of")), "inner")
    phase = shuffle_key(seed, F.col("source")).cast("double") / F.lit(float(1 << 60))
    fraction = ((F.col("at") - F.col("first")).cast("double") + phase) / F.col("rows").cast("double")
    mixed = ranked(placed.select("id", "source", "size", "crc", "at", fraction.alias("fraction")), ["fraction", "at"], "place", "interleaved")
    total = rows.count()
    shard = F.expr(f"place * {shards}L div {max(total, 1)}L")
    # The first place of a shard: the least whose multiple reaches it.
    begin = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return mixed.withColumn("shard", shard).select("id", "source", "size", "crc", F.col("shard").cast("int").alias("shard"), (F.col("place") - begin).alias("slot"))
