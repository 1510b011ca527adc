"""Packing token sequences of fixed capacity by cutting-stock column generation.

Texts are encoded once. Full blocks of a document are sequences of their own; what remains of each
document is an item, shorter than the capacity. The histogram of item lengths (at most one entry
per length, whatever the number of documents) is the demand of a cutting-stock problem: a linear
program over patterns (multisets of lengths that fit one sequence) is solved by column generation,
where a knapsack dynamic program over the capacity prices the next pattern. It starts from a
triangular basis of patterns that use up one length after the other, so it is near the volume
bound at once, and ends when no pattern prices out, the bound is reached, or after ``ROUNDS``
(the packing is valid after any number). Pattern counts are rounded down. Documents of each length
are ranked (ranks are counted where texts are encoded and shifted by prefix sums, no global sort),
and pattern p takes ranks lo to hi of each of its lengths.

Documents left over by rounding, and those of patterns that would leave more than ``MOST_WASTE``
tokens of padding, are laid end to end and cut where a sequence is full; the last sequence is cut
into powers of two, which need no padding.

Defined results: null and empty texts are the end id alone; repeated rows are packed as rows of
their own; a document that fills its blocks exactly has no remainder; an empty table gives no
pieces. Ids are kept as unsigned 16-bit numbers if the vocabulary allows, else 32-bit.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import chunks, limit_batches, sized_join, text_buffer, written
from veilframe.llm.pieces import piece_table

TOKENIZER, CAPACITY, END_ID = "byte_bpe_50k.json", 2048, 1
#: Padding (tokens) that a pattern may leave.
MOST_WASTE = 2
#: Rounds of pricing at most, and the gap to the lower bound at which pricing ends.
ROUNDS, GAP = 150, 1e-4
#: Sequences of full blocks are numbered from here, by task; others from 0.
_TASK_SHIFT = 40


# ---- encoding ------------------------------------------------------------------------------


def _encode(tokenizer: str, capacity: int, end_id: int, id_type: pa.DataType, narrow: bool):
    kind = "<u2" if narrow else "<u4"

    def run(batches):
        table = piece_table(tokenizer, True)
        task = TaskContext.get().partitionId()
        ranks = np.zeros(capacity, np.int64)
        block = row = 0
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            for b, e in chunks(at):
                _, offsets, flat = table.texts(raw[at[b] : at[e]], at[b : e + 1] - at[b])
                columns: list[list] = [[] for _ in range(8)]
                for i in range(e - b):
                    ids = np.append(flat[offsets[i] : offsets[i + 1]], end_id).astype("<u4")
                    blocks, rest = divmod(len(ids), capacity)
                    edges = [*range(0, len(ids), capacity), len(ids)]
                    sums = [zlib.crc32(ids[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                    values = (task, row, len(ids), rest, int(ranks[rest]), block, sums, ids.astype(kind).tobytes())
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    ranks[rest] += 1
                    block += blocks
                    row += 1
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b, e - b).cast(id_type), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                    names=["id", "task", "row", "doc_tokens", "rest", "rank", "block", "sums", "ids"],
                )

    return run


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> tuple[DataFrame, bool]:
    """Written token table, one row per document, and whether ids have 16 bits."""
    from pyspark.sql.pandas.types import to_arrow_type

    from veilframe.llm.pieces import load_tokenizer

    narrow = load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16
    field = docs.schema[id_col]
    schema = f"id {field.dataType.simpleString()}, task int, row long, doc_tokens long, rest int, rank long, block long, sums array<long>, ids binary"
    run = _encode(tokenizer, capacity, end_id, to_arrow_type(field.dataType), narrow)
    return written(docs.select(id_col, text_col).mapInArrow(run, schema), "tokens"), narrow


# ---- the plan ------------------------------------------------------------------------------


@dataclass
class Plan:
    """Who goes where. ``slots``: (length, lo, hi, sequence, copies, offset); ``stream``: (length, first rank, begin)."""

    slots: list[tuple[int, int, int, int, int, int]]
    stream: list[tuple[int, int, int]]
    first_stream_sequence: int
    stream_full: int
    tail: list[tuple[int, int, int]]  # (begin, end, sequence) of the powers of two


def first_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A triangular basis: patterns (columns) that use up one length after the other, and their amounts."""
    n = len(lengths)
    left = counts.astype(float)
    place = {int(x): i for i, x in enumerate(lengths)}
    basis, amount, closed = np.zeros((n, n)), np.zeros(n), np.zeros(n, bool)
    column = 0
    while not closed.all():
        pattern = np.zeros(n)
        room = capacity
        while True:
            fits = np.flatnonzero(~closed & (lengths <= room))
            if not len(fits):
                break
            exact = place.get(room)
            if exact is not None and not closed[exact]:
                pattern[exact] += 1
                break
            partner = np.array([place.get(int(room - x), -1) for x in lengths[fits]]) if room < capacity else np.full(len(fits), -1)
            good = np.flatnonzero((partner >= 0) & ~closed[partner])
            if len(good):
                pattern[fits[good[0]]] += 1
                pattern[partner[good[0]]] += 1
                break
            pattern[fits[0]] += 1
            room -= int(lengths[fits[0]])
        used = np.flatnonzero(pattern)
        times = (left[used] / pattern[used]).min()
        left[used] -= times * pattern[used]
        basis[:, column], amount[column] = pattern, times
        column += 1
        done = used[left[used] <= 1e-9 * counts[used]]
        left[done] = 0
        closed[done] = True
        for extra in done[1:]:  # lengths used up at the same time: a pattern of their own, used 0 times
            basis[extra, column] = capacity // int(lengths[extra])
            column += 1
    return basis, amount


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern, by dynamic programming over the capacity."""
    ascending = lengths[::-1].astype(np.int64)
    worth = values[::-1]
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(ascending, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = upto[room]
        best[room] = max(best[room - 1], (worth[:k] + best[room - ascending[:k]]).max()) if k else 0.0
    pattern = np.zeros(len(lengths))
    room = capacity
    while room and best[room] > 0:
        if best[room] == best[room - 1]:
            room -= 1
            continue
        k = upto[room]
        pick = int((worth[:k] + best[room - ascending[:k]]).argmax())
        pattern[len(lengths) - 1 - pick] += 1
        room -= int(ascending[pick])
    return float(best[capacity]), pattern


def column_generation(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns over lengths, descending) and their amounts; every length is used up exactly."""
    basis, amount = first_patterns(lengths, counts, capacity)
    inverse = np.linalg.inv(basis)
    volume = float((lengths * counts).sum()) / capacity
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = price(duals, lengths, capacity)
        total = amount.sum()
        if value <= 1 + 1e-9 or total - max(volume, total / value) <= GAP * total:
            break
        direction = inverse @ pattern
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.full(len(amount), np.inf)
        ratio[up] = amount[up] / direction[up]
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        basis[:, out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    return basis, amount


def make_plan(histogram: dict[int, int], capacity: int, most_waste: int = MOST_WASTE) -> Plan:
    """Round the patterns, and lay out what is left as a stream."""
    lengths = np.array(sorted((x for x in histogram if x > 0), reverse=True), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    slots, used, sequence = [], np.zeros(len(lengths), np.int64), 0
    if len(lengths):
        basis, amount = column_generation(lengths, counts, capacity)
        for j in np.argsort(-amount, kind="stable"):
            pattern = np.rint(basis[:, j]).astype(np.int64)
            items = np.flatnonzero(pattern)
            times = int(amount[j] + 1e-6)
            if not len(items) or times < 1:
                continue
            times = min(times, int(((counts - used)[items] // pattern[items]).min()))
            fill = int((pattern * lengths).sum())
            if times < 1 or (capacity - fill > most_waste and fill & (fill - 1)):
                continue
            offset = 0
            for i in items:
                copies = int(pattern[i])
                slots.append((int(lengths[i]), int(used[i]), int(used[i]) + copies * times, sequence, copies, offset))
                used[i] += copies * times
                offset += copies * int(lengths[i])
            sequence += times
    stream, begin = [], 0
    for i, length in enumerate(lengths):
        if counts[i] > used[i]:
            stream.append((int(length), int(used[i]), begin))
            begin += int(length) * int(counts[i] - used[i])
    full, rest = divmod(begin, capacity)
    tail, at = [], full * capacity
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            tail.append((at, at + (1 << bit), sequence + full + len(tail)))
            at += 1 << bit
    return Plan(slots, stream, sequence, full, tail)


# ---- assignment ----------------------------------------------------------------------------


def _cut_sums(narrow: bool):
    @F.arrow_udf("long")
    def sums(ids: pa.Array, start: pa.Array, length: pa.Array) -> pa.Array:
        out = []
        for body, s, n in zip(ids, start.to_pylist(), length.to_pylist(), strict=True):
            all_ids = np.frombuffer(body.as_buffer(), "<u2" if narrow else "<u4")
            out.append(zlib.crc32(all_ids[s : s + n].astype("<u4")))
        return pa.array(out, pa.int64())

    return sums


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> tuple[DataFrame, DataFrame]:
    """Pieces (id, task, row, start, length, ids_crc32, doc_tokens, sequence_id, offset) and the token table.

    (task, row) names a row of the token table; ``piece_ids`` cuts the ids of pieces from it.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    tokens, narrow = encoded(docs, id_col, text_col, tokenizer, capacity, end_id)
    where = ["id", "task", "row", "doc_tokens"]
    blocks = tokens.where(F.col("doc_tokens") >= capacity).select(
        *where, "block", F.posexplode(F.expr(f"slice(sums, 1, cast(doc_tokens div {capacity} as int))")).alias("k", "ids_crc32")
    )
    whole = blocks.select(
        *where, (F.col("k").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32",
        ((F.col("task").cast("long") + 1) * F.lit(1 << _TASK_SHIFT) + F.col("block") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    per_task = tokens.where("rest > 0").groupBy("task", "rest").agg(F.count("*").alias("n"))
    per_task = written(per_task, "ranks")
    histogram = {r["rest"]: r["n"] for r in per_task.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = make_plan(histogram, capacity)
    shift = per_task.select(
        "task", "rest",
        F.expr("sum(n) over (partition by rest order by task) - n").alias("shift"),
    )
    shift = written(shift, "rank-shifts")
    items = tokens.where("rest > 0").select(*where, "rest", "rank", F.element_at("sums", -1).alias("ids_crc32"), (F.col("doc_tokens") - F.col("rest")).alias("head"))
    ranked = sized_join(items, shift, ["task", "rest"], "inner").withColumn("rank", F.col("rank") + F.col("shift"))
    # The plan has at most (lengths per pattern) x (patterns) rows, both bounded by the capacity.
    slots = spark.createDataFrame(plan.slots or [(0, 0, 0, 0, 1, 0)], "rest int, lo long, hi long, sequence long, copies int, at long")
    stream = spark.createDataFrame(plan.stream or [(0, 0, 0)], "rest int, first long, begin long")
    placed = ranked.join(F.broadcast(slots), "rest").where("rank >= lo and rank < hi").select(
        *where, F.col("head").alias("start"), F.col("rest").cast("long").alias("length"), "ids_crc32",
        F.expr("sequence + (rank - lo) div copies").alias("sequence_id"),
        (F.col("at") + F.expr("(rank - lo) % copies") * F.col("rest")).alias("offset"),
    )
    laid = ranked.join(F.broadcast(stream), "rest").where("rank >= first").withColumn("begin", F.expr("begin + (rank - first) * rest"))
    laid = laid.withColumn("end", F.col("begin") + F.col("rest"))
    seat = "struct<a:bigint,b:bigint,s:bigint>"
    full = F.expr(
        f"transform(filter(sequence(begin div {capacity}, (end - 1) div {capacity}), k -> k < {plan.stream_full}), "
        f"k -> named_struct('a', k * {capacity}, 'b', (k + 1) * {capacity}, 's', k + {plan.first_stream_sequence}))"
    ).cast(f"array<{seat}>")
    tail = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abs", t, strict=True)]) for t in plan.tail]).cast(f"array<{seat}>")
    seats = F.concat(full, F.filter(tail, lambda t: (t["a"] < F.col("end")) & (t["b"] > F.col("begin"))))
    cut = laid.withColumn("seat", F.explode(seats)).select(
        *where, "rest", "head", "ids_crc32", F.col("seat.s").alias("sequence_id"),
        F.greatest("begin", "seat.a").alias("x"), F.least("end", "seat.b").alias("y"), "begin", F.col("seat.a").alias("edge"),
    )
    cut = cut.select(*where, "rest", "ids_crc32", (F.col("head") + F.col("x") - F.col("begin")).alias("start"), (F.col("y") - F.col("x")).alias("length"), "sequence_id", (F.col("x") - F.col("edge")).alias("offset"))
    cut = written(cut, "cut")
    columns = [*where, "start", "length", "ids_crc32", "sequence_id", "offset"]
    intact = cut.where("length = rest").select(*columns)
    parts = cut.where("length < rest").drop("ids_crc32", "rest")
    parts = sized_join(tokens.select("task", "row", "ids"), written(parts, "parts"), ["task", "row"], "inner")
    parts = parts.withColumn("ids_crc32", _cut_sums(narrow)("ids", "start", "length")).select(*columns)
    return whole.select(*columns).unionByName(placed.select(*columns)).unionByName(intact).unionByName(parts), tokens


def piece_ids(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pieces with ``ids``: the bytes of their ids, as the token table keeps them."""
    width = F.expr("octet_length(ids) div doc_tokens")
    joined = pieces.join(tokens.select("task", "row", "ids"), ["task", "row"])
    return joined.withColumn("ids", F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int")))
