"""Exact removal of word sequences that repeat across a corpus, by super-k-mer partitioning.

A window is a fixed number of consecutive words of one text. Its minimiser is the smallest hash of
the shorter word sequences in it, so equal windows have equal minimisers. Consecutive windows with
one minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket, where all
windows are cut out again and sorted, and a window is repeated if it is not alone. The answer goes
back to the text as intervals of window starts.

Skew. Equal packed strings of one task are repeated for certain: one of them travels, the others
are answered at once. Minimisers that hold more than a thousandth of all super-k-mers are found
first (mergeable heavy-hitter summaries of bounded size; at most ``2 / HOT_SHARE`` of them exist);
their windows travel one by one, as 128-bit digests dealt by the window itself. The number of
buckets follows the size of the input, so a bucket stays a few megabytes.

Exactness. Windows are compared by a hash over their bytes and an independent one over their
words, 128 bits together.

Defined results: null and empty texts, and texts shorter than a window, have nothing to remove;
windows never cross texts; repeated rows count as occurrences of each other, so everything in
windows of theirs goes, in all of them; other columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.bytearrays import Words, byte_prefix, mix, prefix_hash, span_hash, words
from veilframe.llm.common import chunks, fresh_name, limit_batches, release_memory, sized_join, text_buffer, written

WINDOW = 35
#: Words of the sequences among which a window's minimiser is chosen.
SEED_WORDS = 12
#: Minimisers with more than this share of all super-k-mers (and ``HOT_LEAST`` of them) are hot.
HOT_SHARE, HOT_LEAST = 1 / 1000, 1000
#: Text per bucket, and text that a task packs before it hands its strings on.
BUCKET_BYTES, PACK_BYTES = 4 << 20, 4 << 20


def _moving_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: len(values) - (width - span)], values[width - span :])


def super_kmers(w: Words, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: first word, number of windows, minimiser."""
    n = len(w.starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.view(np.uint64)
    prefix = prefix_hash(w.hashes())
    at = np.arange(n - seed_words + 1)
    least = _moving_min(span_hash(prefix, at, at + seed_words), window - seed_words + 1)
    text = w.text_of()
    begins = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(begins):
        return none, none, none.view(np.uint64)
    least = least[begins]
    new = np.ones(len(begins), bool)
    new[1:] = (begins[1:] != begins[:-1] + 1) | (least[1:] != least[:-1]) | (text[begins[1:]] != text[begins[:-1]])
    first = np.flatnonzero(new)
    return begins[first], np.diff(np.append(first, len(begins))), least[first]


def _window_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, window: int):
    """Two hashes of the windows that begin at the given words."""
    prefix = byte_prefix(raw)
    over_bytes = span_hash(prefix, starts[begins], ends[begins + window - 1])
    over_words = span_hash(prefix_hash(mix(span_hash(prefix, starts, ends) ^ np.uint64(0x5851F42D4C957F2D))), begins, begins + window)
    return over_bytes, over_words


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of runs, and the run of each."""
    run = np.repeat(np.arange(len(first)), count)
    return first[run] + np.arange(len(run)) - (np.cumsum(count) - count)[run], run


def _repeated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the digests (a, b) occur more than once."""
    out = np.zeros(len(a), bool)
    if len(a) < 2:
        return out
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    tie = x[1:] == x[:-1]
    if (tie & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        tie = x[1:] == x[:-1]
    tie &= y[1:] == y[:-1]
    hit = np.zeros(len(a), bool)
    hit[1:] = tie
    hit[:-1] |= tie
    out[order] = hit
    return out


def _heavy(window: int, seed_words: int):
    def run(batches):
        found, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            raw, at = text_buffer(batch.column(0))
            size += len(raw)
            for b, e in chunks(at):
                found.append(super_kmers(words(raw[at[b] : at[e]], at[b : e + 1] - at[b]), window, seed_words)[2])
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        total = int(counts.sum())
        top = np.argsort(-counts, kind="stable")[: int(2 / HOT_SHARE)]
        top = top[counts[top] > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys[top].view(np.int64), 0)), pa.array(np.append(counts[top], 0).astype(np.int64)),
             pa.array(np.append(np.zeros(len(top), np.int64), total)), pa.array(np.append(np.zeros(len(top), np.int64), size))],
            names=["key", "n", "total", "size"],
        )

    return run


_Nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_TRAVEL = "bucket long, body binary, digests binary, keys binary, starts binary, counts binary, known binary"
_TRAVEL_TYPES = [pa.int64(), *[pa.binary()] * 6]
_FOUND = "k1 long, k2 long, start int, n int"


class _Packer:
    """Collects super-k-mers and hands them on by bucket."""

    def __init__(self, window: int, seed_words: int, buckets: int, hot: np.ndarray):
        self.window, self.seed_words, self.buckets, self.hot = window, seed_words, buckets, hot
        self._reset()

    def _reset(self) -> None:
        self.size = 0
        self.packed: list[bytes] = []
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.loose: list[tuple[np.ndarray, ...]] = []

    def add(self, raw: np.ndarray, at: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> None:
        w = words(raw, at)
        self.size += len(raw)
        first, count, key = super_kmers(w, self.window, self.seed_words)
        if not len(first):
            return
        text = w.text_of()
        hot = np.isin(key, self.hot) if len(self.hot) else np.zeros(len(key), bool)
        if hot.any():
            begins, _ = _expand(first[hot], count[hot])
            a, b = _window_digests(w.norm, w.starts, w.ends, begins, self.window)
            doc = text[begins]
            self.loose.append((a, b, k1[doc], k2[doc], (begins - w.first[doc]).astype(np.int32)))
            first, count, key = first[~hot], count[~hot], key[~hot]
        if not len(first):
            return
        doc = text[first]
        begin, end = w.starts[first], w.ends[first + count + self.window - 2]
        data = w.norm.tobytes()
        self.packed += [data[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
        whole = span_hash(byte_prefix(w.norm), begin, end)
        self.runs.append((whole, key, k1[doc], k2[doc], (first - w.first[doc]).astype(np.int32), count.astype(np.int32)))

    def flush(self):
        rows: list[list] = [[] for _ in _TRAVEL_TYPES]

        def put(bucket, body, digests, keys, starts, counts, known):
            for column, value in zip(rows, (bucket, body, digests, keys, starts, counts, known), strict=True):
                column.append(value)

        if self.runs:
            whole, key, k1, k2, start, count = map(np.concatenate, zip(*self.runs, strict=True))
            _, sample, group, copies = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            copied = copies[group] > 1
            for i in np.flatnonzero(copied).tolist():  # the same bytes, not only the same hash
                if self.packed[i] != self.packed[sample[group[i]]]:
                    copied[i] = False
            travels = ~copied
            travels[sample[group[copied]]] = True
            self._answer(put, k1[copied], k2[copied], start[copied], count[copied])
            bucket = (mix(key) % np.uint64(self.buckets)).astype(np.int64)
            chosen = np.flatnonzero(travels)
            chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
            for part in np.split(chosen, np.flatnonzero(np.diff(bucket[chosen])) + 1) if len(chosen) else []:
                body = pa.compress(b"\n".join([self.packed[i] for i in part.tolist()]), "zstd", asbytes=True)
                size = sum(len(self.packed[i]) for i in part.tolist()) + len(part) - 1
                put(int(bucket[part[0]]), size.to_bytes(8, "little") + body, None, np.stack([k1[part], k2[part]]).tobytes(),
                    start[part].tobytes(), count[part].tobytes(), copied[part].tobytes())
        if self.loose:
            a, b, k1, k2, start = map(np.concatenate, zip(*self.loose, strict=True))
            many = _repeated(a, b)
            self._answer(put, k1[many], k2[many], start[many], np.ones(int(many.sum()), np.int32))
            travels = ~many
            order = np.lexsort((b, a))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            travels[order[fresh]] = True  # one of each
            bucket = (mix(a) % np.uint64(self.buckets)).astype(np.int64)
            chosen = np.flatnonzero(travels)
            chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
            for part in np.split(chosen, np.flatnonzero(np.diff(bucket[chosen])) + 1) if len(chosen) else []:
                put(int(bucket[part[0]]), None, np.stack([a[part], b[part]]).tobytes(), np.stack([k1[part], k2[part]]).tobytes(),
                    start[part].tobytes(), None, many[part].tobytes())
        self._reset()
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _TRAVEL_TYPES, strict=True)], names=[f.split()[0] for f in _TRAVEL.split(", ")])

    def _answer(self, put, k1, k2, start, count) -> None:
        """Occurrences that are known to be repeated, spread over the buckets."""
        for i in range(0, len(k1), 20_000):
            s = slice(i, i + 20_000)
            put(int(abs(int(k1[i])) % self.buckets), None, None, np.stack([k1[s], k2[s]]).tobytes(), start[s].tobytes(), count[s].tobytes(), None)


def _pack(window: int, seed_words: int, buckets: int, hot: np.ndarray):
    def run(batches):
        packer = _Packer(window, seed_words, buckets, hot)
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            raw, at = text_buffer(batch.column(2))
            for b, e in chunks(at):
                packer.add(raw[at[b] : at[e]], at[b : e + 1] - at[b], k1[b:e], k2[b:e])
                if packer.size >= PACK_BYTES:
                    yield from packer.flush()
        yield from packer.flush()

    return run


def _count(window: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: sort all windows, answer those that are not alone."""
        release_memory()  # of the bucket before
        column = {n: table.column(n).to_pylist() for n in ("body", "digests", "keys", "starts", "counts", "known")}
        k1s, k2s, begins, lengths = [], [], [], []
        packed, loose = [], []

        def array(value, kind):
            return np.frombuffer(value, kind)

        for i in range(table.num_rows):
            keys = array(column["keys"][i], np.int64).reshape(2, -1)
            start = array(column["starts"][i], np.int32)
            if column["body"][i] is not None:
                body = column["body"][i]
                raw = np.frombuffer(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd"), np.uint8)
                count = array(column["counts"][i], np.int32).astype(np.int64)
                ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
                starts = np.append(0, ends[:-1] + 1)
                size = count + window - 1
                at, run_of = _expand(np.cumsum(size) - size, count)
                a, b = _window_digests(raw, starts, ends, at, window)
                packed.append((a, b, keys[0], keys[1], start, count, array(column["known"][i], bool)))
            elif column["digests"][i] is not None:
                a, b = array(column["digests"][i], np.uint64).reshape(2, -1)
                loose.append((a, b, keys[0], keys[1], start, array(column["known"][i], bool)))
            else:
                k1s.append(keys[0]), k2s.append(keys[1]), begins.append(start), lengths.append(array(column["counts"][i], np.int32))
        if packed:
            a, b, k1, k2, start, count, known = map(np.concatenate, zip(*packed, strict=True))
            hit = _repeated(a, b)
            place, run_of = _expand(start.astype(np.int64), count)
            hit &= ~known[run_of]  # those were answered where they were packed
            picked = np.flatnonzero(hit)
            if len(picked):
                new = np.ones(len(picked), bool)
                new[1:] = (picked[1:] != picked[:-1] + 1) | (run_of[picked[1:]] != run_of[picked[:-1]])
                head = np.flatnonzero(new)
                owner = run_of[picked[head]]
                k1s.append(k1[owner]), k2s.append(k2[owner])
                begins.append(place[picked[head]].astype(np.int32))
                lengths.append(np.diff(np.append(head, len(picked))).astype(np.int32))
        if loose:
            a, b, k1, k2, start, known = map(np.concatenate, zip(*loose, strict=True))
            hit = _repeated(a, b) & ~known
            k1s.append(k1[hit]), k2s.append(k2[hit]), begins.append(start[hit]), lengths.append(np.ones(int(hit.sum()), np.int32))
        fields = [(k1s, np.int64), (k2s, np.int64), (begins, np.int32), (lengths, np.int32)]
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in fields], names=["k1", "k2", "start", "n"])

    return run


def _cut(window: int):
    kind = "struct<n_words:long,n_removed:long,kept_text:string>"

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        raw, at = text_buffer(texts)
        total, removed, kept = [], [], []
        begin, length, spans = (np.asarray(x) for x in (starts.flatten(), counts.flatten(), starts.value_lengths().fill_null(0)))
        first_span = np.concatenate([[0], np.cumsum(spans)])
        for b, e in chunks(at):
            w = words(raw[at[b] : at[e]], at[b : e + 1] - at[b])
            edge = np.zeros(len(w.starts) + 1, np.int64)
            s = slice(first_span[b], first_span[e])
            where = np.repeat(w.first[:-1], spans[b:e]) + begin[s]
            np.add.at(edge, where, 1)
            np.add.at(edge, where + length[s] + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            stays = w.norm[np.repeat(~gone, w.ends - w.starts + 1)].tobytes()
            size = np.zeros(len(w.starts) + 1, np.int64)
            np.cumsum(np.where(gone, 0, w.ends - w.starts + 1), out=size[1:])
            lost = np.zeros(len(w.starts) + 1, np.int64)
            np.cumsum(gone, out=lost[1:])
            total.append(w.counts)
            removed.append(np.diff(lost[w.first]))
            cuts = size[w.first].tolist()
            kept += [stays[x : max(x, y - 1)].decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        numbers = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (total, removed)]
        return pa.StructArray.from_arrays([*numbers, pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept_text"])

    return cut


def repeated_windows(keyed: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """Runs (k1, k2, start, n) of repeated windows for rows (k1, k2, text)."""
    summary = written(keyed.select("text").mapInArrow(_heavy(window, seed_words), "key long, n long, total long, size long"), "heavy")
    total, size = summary.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = max(HOT_LEAST, total * HOT_SHARE / 2)
    hot = summary.where("n > 0").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()  # at most 2 / HOT_SHARE
    buckets = max(32, math.ceil(size / BUCKET_BYTES))
    hot_keys = np.array([r["key"] for r in hot], np.int64).view(np.uint64)
    travel = keyed.select("k1", "k2", "text").mapInArrow(_pack(window, seed_words, buckets, hot_keys), _TRAVEL)
    return travel.groupBy("bucket").applyInArrow(_count(window), _FOUND)


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """The rows with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space)."""
    limit_batches(docs.sparkSession)
    a, b, at, ln = (fresh_name(docs, x) for x in ("k1", "k2", "starts", "counts"))
    others = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns if c != text_col and not isinstance(docs.schema[c].dataType, _Nested)]
    keyed = docs.withColumns({a: F.xxhash64(*others, F.col(text_col)), b: F.xxhash64(F.lit(b), F.col(text_col), *others)})
    found = repeated_windows(keyed.select(F.col(a).alias("k1"), F.col(b).alias("k2"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), window, seed_words)
    spans = found.groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    spans = written(spans.select(a, b, F.col("spans.start").alias(at), F.col("spans.n").alias(ln)), "spans")
    joined = sized_join(keyed, spans, [a, b], "left")
    none = F.array().cast("array<int>")
    mark = fresh_name(docs, "cut")
    cut = joined.withColumn(mark, _cut(window)(F.col(text_col), F.coalesce(at, none), F.coalesce(ln, none)))
    keep = [f"`{c}`" for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    return cut.select(*keep, f"{mark}.n_words", f"{mark}.n_removed", f"{mark}.kept_text")
