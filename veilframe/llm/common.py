"""Shared helpers: written intermediates, joins behind a size check, Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.session import work_path

#: A joined side is broadcast only when it is known to have at most so many (narrow) rows.
BROADCAST_ROWS = 200_000
#: Bytes of text that one vectorised step handles at a time.
CHUNK_BYTES = 1 << 19


def limit_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches to Python workers have at most so many bytes, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@lru_cache(maxsize=1)
def _trim():
    """The C library's function that returns free pages, where it has one (glibc)."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed memory back to the system.

    Python workers are reused by later stages; without this each keeps the peak of all it ever ran.
    Call it after a batch, when its arrays are gone.
    """
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: evaluated once, lineage cut, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables. Only for tables that nothing unfinished reads: what was made of them is written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with what tells each apart, and the names of those columns.

    Rows of a Parquet table are told apart by their file and their number in it, so nothing is copied; rows that
    come from a computation are numbered and written once.
    """
    file, number = fresh_name(docs, "of_file"), fresh_name(docs, "in_file")
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and docs.inputFiles():
        found = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")
        return docs.withColumns({file: found[0], number: found[1]}), [file, number]
    numbered = docs.withColumns({file: F.lit(0).cast("long"), number: F.monotonically_increasing_id()})
    return written(numbered, "numbered"), [file, number]


def sized_join(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored right side; broadcast it if its row count is small, else shuffle both.

    ``right`` must be cheap to count (a written table of narrow rows).
    """
    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def ranked(df: DataFrame, order: list[str], name: str, label: str = "ranked") -> DataFrame:
    """Add a gapless rank from 0 by some columns (ascending, nulls first); no task sees more than one range of rows.

    Rows are dealt into ranges, sorted there and written with their place; a range's first rank is the number of
    rows before it, and only those sums (one row per range) are ordered in one task. Columns that can tie over
    many rows must be followed by one that tells rows apart, so that a range can end between them.
    """
    place, part, begin, size = (fresh_name(df, f"{name}_{c}") for c in ("place", "part", "begin", "size"))
    keys = [F.col(f"`{c}`") for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Partition number in the upper bits, row number in the lower 33.
    stored = written(dealt.withColumn(place, F.monotonically_increasing_id()), label)
    sizes = stored.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count("*").alias(size))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    begins = written(sizes.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(begin)), f"{label}-begins")
    met = sized_join(stored.withColumn(part, F.shiftright(place, 33)), begins, part, "inner")
    return met.withColumn(name, F.col(begin) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop(place, part, begin)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own.

    Memory that the ranges took is given back after the last one.
    """
    begin, rows = 0, len(at) - 1
    while begin < rows:
        end = int(np.searchsorted(at, at[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end
        begin = end
    release_memory()
