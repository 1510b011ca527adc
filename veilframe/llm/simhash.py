"""Near-duplicates by 64-bit SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at
most two bits, then (pigeonhole) some segment is equal and the segment after it, in a circle,
differs in at most one bit. A segment, padded to 23 bits, is decoded to the nearest codeword of
the perfect Golay code; decoding also what one flipped bit makes of it gives one to six codeword
indices, and segments that differ in one bit have an index in common. So the keys of a fingerprint
are, for each segment, its exact bits with each index of the next segment. Fingerprints that share
a key are joined and verified by counting differing bits.

Only distinct fingerprints take part; copies are grouped before. Keys shared by more than
``CROWDED`` fingerprints are not paired: their fingerprints are linked through midpoints (the
fingerprint itself and its 64 neighbours at one bit), because two fingerprints differ in at most
two bits exactly if they share a midpoint, and at most 65 fingerprints can share one. Work and
memory per group are bounded that way, and no link is lost.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and
are linked like any other; with fewer words than a shingle the whole word sequence is the
shingle; repeated rows fall into one component; with null ids a component's id is the smallest
id that is not null (null if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bytearrays import words
from veilframe.llm.common import chunks, fresh_name, limit_batches, sized_join, text_buffer, written
from veilframe.llm.components import components
from veilframe.llm.golay import BITS, nearest

SHINGLE_WORDS, SEED = 3, 42
WIDTHS = (22, 21, 21)
CROWDED = 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint of each run of hashes: the bits set in over half of them; zero for an empty run."""
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little")
        out[full] = packed.view("<u8")[:, 0]
    return out


def _fingerprints(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    w = words(_LOWER[raw], at)
    n = w.counts
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    total = int(shingles.sum())
    if not total:
        return np.zeros(len(n), np.uint64)
    begin = np.cumsum(shingles) - shingles
    head = np.repeat(w.first[:-1] - begin, shingles) + np.arange(total)
    tail = head + np.repeat(np.minimum(size, np.maximum(n, 1)), shingles) - 1
    data = w.norm.tobytes()
    hashes = np.fromiter(
        (xxh64_intdigest(data[a:b], SEED) for a, b in zip(w.starts[head].tolist(), w.ends[tail].tolist(), strict=True)),
        np.uint64,
        total,
    )
    return majority(hashes, shingles)


def simhash(text: str | Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """64-bit fingerprint (as a long) of the whole text, ASCII letters lower-cased."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        raw, at = text_buffer(texts)
        parts = [_fingerprints(raw[at[b] : at[e]], at[b : e + 1] - at[b], shingle_words) for b, e in chunks(at)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())

    return fingerprint(F.col(text) if isinstance(text, str) else text)


def fuzzy_keys(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For unsigned fingerprints: (row, key, whether the key is of the unchanged fingerprint) per segment."""
    shifts = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
    segments = [(values >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(shifts, WIDTHS, strict=True)]
    out = []
    for k in range(3):
        exact, fuzzy, width = segments[k], segments[(k + 1) % 3], WIDTHS[(k + 1) % 3]
        assert width <= BITS
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint64)
        index = nearest(fuzzy[:, None] ^ flips[None, :]).astype(np.int64)
        home = index[:, 0].copy()
        index.sort(axis=1)
        fresh = np.ones(index.shape, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(fresh)
        index = index[row, column]
        key = (np.int64(k) << np.int64(36)) | (exact[row].astype(np.int64) << np.int64(12)) | index
        out.append((row, key, index == home[row]))
    return out


def _key_rows(batches):
    for batch in batches:
        prints = np.asarray(batch.column(0)).astype(np.int64)
        for row, key, home in fuzzy_keys(prints.view(np.uint64)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(prints[row]), pa.array(home)], names=["key", "fp", "home"]
            )


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) of at most two differing bits.

    Complete up to connection: fingerprints that share a crowded key are linked through midpoints.
    """
    keys = written(prints.select("fp").mapInArrow(_key_rows, "key long, fp long, home boolean"), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    shared = written(sizes.where("n >= 2 and homes >= 1").select("key", "n"), "shared-keys")
    near = written(sized_join(keys, shared, "key", "inner"), "candidates")
    few, many = near.where(F.col("n") <= CROWDED), near.where(F.col("n") > CROWDED)
    left = few.where("home").select("key", F.col("fp").alias("a"))
    right = few.select("key", F.col("fp").alias("b"))
    paired = left.join(right.hint("shuffle_merge"), "key").where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    # The other order of each pair: its home key is on the other side.
    paired = paired.unionByName(
        left.join(right.hint("shuffle_merge"), "key").where("a > b and bit_count(a ^ b) <= 2").select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    spots = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = many.select("fp").distinct().select("fp", F.explode(spots).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
    met = around.groupBy("spot").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65
    through = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return paired.unionByName(through)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row (id, fp, component) per row of ``docs``; component is the smallest id that links lead to."""
    limit_batches(docs.sparkSession)
    prints = written(docs.select(F.col(id_col).alias("id"), simhash(text_col, shingle_words).alias("fp")), "fingerprints")
    return with_components(prints)


def with_components(prints: DataFrame) -> DataFrame:
    """Add ``component`` to a written table of (id, fp)."""
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    rooted = components(fingerprint_links(classes))
    linked = written(rooted.join(classes, rooted["node"] == classes["fp"]).select("fp", "root", "least"), "linked")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    every = classes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    # One copy group may hold a large part of all rows: both sides are plain exchanges, which the
    # adaptive skew join splits.
    return prints.join(written(every, "components"), "fp")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without near-duplicates of a row with a smaller id (ties: one row stays)."""
    limit_batches(docs.sparkSession)
    row = fresh_name(docs, "row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    prints = written(docs.select(F.col(row).alias("id"), F.col(id_col).alias("name"), simhash(text_col).alias("fp")), "fingerprints")
    grouped = with_components(prints)
    # One row of each component stays, the one with the smallest id.
    best = grouped.groupBy("component").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "name", "id")).alias("best"), F.count("*").alias("n"))
    stays = best.where("n > 1").select("component", F.col("best.id").alias("keep"))
    dropped = written(grouped.join(stays, "component").where(F.col("id") != F.col("keep")).select(F.col("id").alias(row)), "dropped")
    return sized_join(docs, dropped, row, "left_anti").drop(row)
