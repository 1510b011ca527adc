"""Periodic runs of words, found as maximal pairs on the tree of LCP intervals.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST_EXPONENT`` periods
and ``LEAST_LENGTH`` words long, which no neighbouring word extends. If it starts at s and has L words,
the suffixes at s and s + q share exactly L - q words and have different left words: a maximal pair.

Other way round, take the places where a word sequence of l words stands (an LCP interval) and two of
them next to each other, d apart, with 2 d <= l, different left words and different right words. Then d is
a period of the stretch from the first place to the end of the second; a smaller one would divide d and
put a further place between the two; and the stretch cannot be extended. So the neighbouring maximal pairs
with (exponent - 1) * d <= l and d + l >= least length are exactly the runs, each found once, with start,
length and period read off the pair. Nothing is extended or compared word by word.

Suffixes are sorted by prefix doubling over exact word numbers, many texts in one set of arrays. Only
suffixes with a near enough neighbour can belong to a pair; the others leave before the tree is built. The
tree is walked bottom-up: an interval carries the list of its places in text order, every place with the class
of its left word (a text's first word has a class of its own), and the shorter list is put into the longer.
Time is n log n in the words of a text, memory is linear in one text or one chunk of short texts.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; a text of any
length is judged whole; repeated rows get equal results; all columns are kept, and the new ones get their
names from the caller. Work is per row, so no key or group can be hot.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import chunks, limit_batches, release_memory

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Lists shorter than this are inserted one by one, longer ones by a merge.
_FEW = 32

RUN = "struct<start:bigint,length:bigint,period:bigint>"
FIELDS = f"struct<n_words:bigint,runs:array<{RUN}>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one after another, and where each text's begin; null counts as empty."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(trimmed)
    counts = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), 0, pc.list_value_length(split)).to_numpy(zero_copy_only=False)
    flat = split.flatten()
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Rank of each item among sorted keys: the place of the first item with its key."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return rank


def _levels(codes: np.ndarray, text: np.ndarray, stop: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of suffixes by their first 1, 2, 4, ... words, and the suffixes that shared a word with another."""
    n = len(codes)
    rank = _grouped(text * (int(codes.max()) + 1) + codes)
    live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    tied, levels, span = live, [rank.astype(np.int32)], 1
    while len(live):
        inside = live + span < stop[live]
        tail = np.where(inside, rank[np.minimum(live + span, n - 1)] + 1, 0)
        fine = _grouped(rank[live] * (n + 1) + tail)
        # Places among the live suffixes become places among all: first of the old rank, plus the shift inside it.
        first = np.full(n, n, np.int64)
        np.minimum.at(first, rank[live], fine)
        rank = rank.copy()
        rank[live] = rank[live] + fine - first[rank[live]]
        levels.append(rank.astype(np.int32))
        span *= 2
        live = live[np.bincount(rank[live], minlength=n)[rank[live]] > 1]
    return levels, tied


def _common(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Number of words that pairs of suffixes of one text share."""
    n = len(stop)
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        room = (a < stop[left]) & (b < stop[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        common += np.where(room & (levels[level][a] == levels[level][b]), 1 << level, 0)
    return common


def _near(places: np.ndarray, key: np.ndarray, reach: np.ndarray, share: int) -> np.ndarray:
    """Which places have a next or previous one of equal key at most a ``share``-th of their reach away."""
    order = np.lexsort((places, key))
    at, same = places[order], np.zeros(len(places), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    gap = np.full(len(places), np.iinfo(np.int64).max // (share + 1))
    gap[1:][same[1:]] = np.diff(at)[same[1:]]
    far = reach[order]
    keep = share * gap <= far
    keep[:-1] |= same[1:] & (share * gap[1:] <= far[:-1])
    out = np.empty(len(places), bool)
    out[order] = keep
    return out


def find_runs(codes: np.ndarray, first: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period), sorted, for word numbers of texts that begin at ``first``."""
    none = np.zeros((0, 4), np.int64)
    n, share = len(codes), least_exponent - 1
    if share < 2:
        raise ValueError("runs need an exponent of at least 3")
    if n == 0:
        return none
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    stop = first[1:][text]
    levels, tied = _levels(codes.astype(np.int64), text, stop)
    # A pair shares at least the words of the shortest run without its period, of whatever period.
    shortest = min(max(share * q, least_length - q) for q in range(1, least_length + 1))
    at_least = max(0, min(len(levels), shortest.bit_length()) - 1)
    key = levels[at_least]
    tied = tied[np.bincount(key[tied], minlength=n)[key[tied]] > 1]
    if not len(tied):
        return none
    array = tied[np.argsort(levels[-1][tied])]
    common = np.zeros(len(array), np.int64)
    common[:-1] = _common(levels, array[:-1], array[1:], stop) * (text[array[:-1]] == text[array[1:]])
    reach = common.copy()
    reach[1:] = np.maximum(reach[1:], common[:-1])
    kept = np.flatnonzero(_near(array, key[array], reach, share))
    if not len(kept):
        return none
    # What two suffixes share is the least of what those between them share.
    between = np.minimum.reduceat(common, kept)
    between[-1] = 0
    array, between = array[kept], np.where(between >= shortest, between, 0)
    # The class of a left word; a text's first word has none and differs from all.
    left = np.where(array == first[text[array]], -1, codes[np.maximum(array - 1, 0)])
    pairs = _maximal_pairs(array.tolist(), between.tolist(), dict(zip(array.tolist(), left.tolist(), strict=True)), share, least_length)
    if not pairs:
        return none
    start, distance, shared = np.array(pairs, np.int64).T
    found = np.stack([text[start], start - first[text[start]], distance + shared, distance], axis=1)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _maximal_pairs(array: list[int], common: list[int], left: dict[int, int], share: int, least_length: int) -> list[tuple[int, int, int]]:
    """(place, distance, shared words) of neighbouring maximal pairs, intervals closed bottom-up.

    ``common[i]`` is what the suffixes at ``array[i]`` and ``array[i + 1]`` share, 0 after a tree's last.
    """
    out: list[tuple[int, int, int]] = []

    def report(a: int, b: int, shared: int) -> None:
        if share * (b - a) <= shared and b - a + shared >= least_length and left[a] != left[b]:
            out.append((a, b - a, shared))

    def join(many: list[int], few: list[int], shared: int) -> list[int]:
        """One list of the places of two children of an interval; pairs across them that make a run are reported."""
        if len(many) < len(few):
            many, few = few, many
        for k, place in enumerate(few):
            i = bisect_left(many, place)
            # Neighbours in the joined list only: no other place of ``few`` may stand between.
            if i and (k == 0 or few[k - 1] < many[i - 1]):
                report(many[i - 1], place, shared)
            if i < len(many) and (k + 1 == len(few) or few[k + 1] > many[i]):
                report(place, many[i], shared)
        if len(few) < _FEW:
            for place in few:
                insort(many, place)
        else:
            many += few
            many.sort()
        return many

    open_intervals: list[tuple[int, list[int]]] = []
    for place, follow in zip(array, common, strict=True):
        places = [place]
        while open_intervals and open_intervals[-1][0] > follow:
            shared, before = open_intervals.pop()
            places = join(before, places, shared)
        if follow:
            if open_intervals and open_intervals[-1][0] == follow:
                open_intervals[-1] = (follow, join(open_intervals[-1][1], places, follow))
            else:
                open_intervals.append((follow, places))
    return out


def repeated_words(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words stand in a run after its first period."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    begin = first[found[:, 0]] + found[:, 1]
    np.add.at(edge, begin + found[:, 3], 1)
    np.add.at(edge, begin + found[:, 2], -1)
    return np.cumsum(edge[:-1]) > 0


def _judged(texts: pa.Array, least_length: int, least_exponent: int) -> pa.StructArray:
    flat, first = word_lists(texts)
    rows = len(first) - 1
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    found = find_runs(codes, first, least_length, least_exponent)
    kept = ~repeated_words(found, first)
    at = np.concatenate([[0], np.cumsum(kept)])[first]
    words = pa.LargeListArray.from_arrays(pa.array(at), flat.filter(pa.array(kept)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(found[:, 0], minlength=rows))]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=list(_RUN)))
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(first)), runs, pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=["n_words", "runs", "collapsed"]
    )


def run_columns(text: str | Column, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> Column:
    """Struct (n_words, runs by start and period, collapsed) of each text of a string column.

    ``collapsed`` has the text's words joined by one space, without those that stand in a run after its first period.
    """

    @F.arrow_udf(FIELDS)
    def judge(texts: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        parts = [_judged(texts.slice(b, e - b), least_length, least_exponent) for b, e in chunks(at)]
        out = pa.concat_arrays(parts) if parts else _judged(texts, least_length, least_exponent)
        del parts
        release_memory()
        return out

    return judge.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def with_runs(docs: DataFrame, out: str, text_col: str = "text", **limits) -> DataFrame:
    """The rows with one more column, the struct of ``run_columns``."""
    limit_batches(docs.sparkSession)
    return docs.withColumn(out, run_columns(F.col(f"`{text_col}`"), **limits))


def longest_run(runs: Column) -> Column:
    """The run with most words; ties: smallest start, then period. Null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def run_list(runs: Column) -> Column:
    """One line ``start,length,period`` per run."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
