"""Quality rules on repetition inside a text, by suffix arrays over its words.

A suffix array of word sequences is built by prefix doubling: suffixes are ranked by their first
1, 2, 4, ... words, and only those that are still tied are ranked further. The ranks of each step
give the longest common prefix of neighbours in the array. An interval of the array with a common
prefix of n words is a substring of n words that occurs several times; the longest common prefix
of a suffix with either neighbour is the longest repeated substring that starts there. The union
of those spans is the repeated part of the text. Many texts are handled in one set of arrays.

Defined results: null and empty texts have no words and fail the base rule; a text of any length
is judged whole; repeated rows get equal results; nothing is compared between texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bytearrays import (
    SPACE,
    Words,
    byte_prefix,
    mix,
    separated,
    span_hash,
    sums_by_text,
    words,
)
from veilframe.llm.common import chunks, fresh_name, limit_batches, text_buffer

#: Base rule: fewest words, and most percent of words in repeated windows of ``WINDOW`` words.
LEAST_WORDS, MOST_PERCENT, WINDOW = 50, 50, 3
#: The method's verdict: repeats of so many words or more count, as a share of the text's words.
REPEAT_WORDS, MOST_COVERED, MOST_LONGEST = 8, 0.3, 0.2

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, covered_fraction double, base_failed boolean, kept boolean"
)
_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_STRUCT = pa.struct([(f.split()[0], _TYPES[f.split()[1]]) for f in FIELDS.split(", ")])


def longest_repeats(w: Words) -> np.ndarray:
    """For each word, the length of the longest repeated substring of its text that starts there."""
    n = len(w.starts)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    text = w.text_of()
    stop = w.first[1:][text]
    key = mix(w.hashes() + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    rank = _ranks(order, key[order])
    size = np.bincount(rank, minlength=n)
    live = np.flatnonzero(size[rank] > 1)
    if not len(live):
        return out
    tied, levels, span = live, [rank], 1
    while len(live):
        follow = np.minimum(live + span, n - 1)
        inside = live + span < stop[live]
        tail = np.where(inside, rank[follow] + 1, 0)
        order = np.lexsort((tail, rank[live]))
        live = live[order]
        base = rank[live]
        rank = rank.copy()
        rank[live] = _subranks(base, tail[order])
        span *= 2
        levels.append(rank)
        size = np.bincount(rank[live], minlength=n)
        live = live[size[rank[live]] > 1]
    # Neighbours in the suffix array that share at least their first word.
    array = tied[np.argsort(levels[-1][tied], kind="stable")]
    left, right = array[:-1], array[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        room = (a < stop[left]) & (b < stop[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        common += np.where(room & (levels[level][a] == levels[level][b]), 1 << level, 0)
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def _ranks(order: np.ndarray, ordered_keys: np.ndarray) -> np.ndarray:
    """Rank of each item: the place of the first item with its key."""
    new = np.empty(len(order), bool)
    new[0] = True
    new[1:] = ordered_keys[1:] != ordered_keys[:-1]
    place = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = place
    return rank


def _subranks(base: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Finer ranks of items sorted by (base, tail): the old rank plus the place of the first equal item."""
    index = np.arange(len(base))
    group = np.empty(len(base), bool)
    group[0] = True
    group[1:] = base[1:] != base[:-1]
    new = group.copy()
    new[1:] |= tail[1:] != tail[:-1]
    begin = np.maximum.accumulate(np.where(group, index, 0))
    place = np.maximum.accumulate(np.where(new, index, 0))
    return base + place - begin


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which words lie in the union of the spans that start at each word with the given length."""
    reach = np.maximum.accumulate(np.arange(len(lengths)) + lengths)
    return reach > np.arange(len(lengths))


def _line_repeats(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    text, begins = separated(raw, at, mark=10)
    ends = np.flatnonzero(text == 10)
    starts = np.empty_like(ends)
    starts[0:1] = 0
    starts[1:] = ends[:-1] + 1
    inked = np.zeros(len(text) + 1, np.int64)
    np.cumsum(~SPACE[text], out=inked[1:])
    has_word = inked[ends] > inked[starts]
    starts, ends = starts[has_word], ends[has_word]
    owner = np.searchsorted(begins, starts, side="right") - 1
    key = span_hash(byte_prefix(text), starts, ends)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    again = np.zeros(len(order), bool)
    again[1:] = (owner[1:] == owner[:-1]) & (key[1:] == key[:-1])
    return np.bincount(owner[again], minlength=len(at) - 1)


def measure(raw: np.ndarray, at: np.ndarray, repeat_words: int) -> dict[str, np.ndarray]:
    """All counts of some texts."""
    w = words(raw, at)
    n = w.counts
    bytes_at = at - at[0]
    part = raw[at[0] : at[-1]]
    lengths = longest_repeats(w)
    in_window = covered(np.where(lengths >= WINDOW, lengths, 0))
    in_repeat = covered(np.where(lengths >= repeat_words, lengths, 0))
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, w.text_of(), lengths)
    return {
        "n_words": n,
        "word_chars": sums_by_text((~SPACE[part]) & ((part & 0xC0) != 0x80), bytes_at),
        "n_symbols": sums_by_text(_SYMBOLS[part], bytes_at),
        "n_dup_lines": _line_repeats(raw, at),
        "n_repeat_words": sums_by_text(in_window, w.first),
        "n_covered_words": sums_by_text(in_repeat, w.first),
        "longest_repeat": longest,
    }


def repetition_rules(
    text: str | Column,
    repeat_words: int = REPEAT_WORDS,
    most_covered: float = MOST_COVERED,
    most_longest: float = MOST_LONGEST,
) -> Column:
    """Struct of counts and verdict (``FIELDS``) for each text of a string column.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated 3-word windows.
    ``kept``: not ``base_failed``, repeats of at least ``repeat_words`` words cover at most
    ``most_covered`` of the words, and the longest repeat, if that long, has at most
    ``most_longest`` of the words.
    """

    @F.arrow_udf(f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def rules(texts: pa.Array) -> pa.Array:
        raw, at = text_buffer(texts)
        parts = [measure(raw, at[b : e + 1], repeat_words) for b, e in chunks(at)]
        if not parts:
            return pa.array([], _STRUCT)
        got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        n = got["n_words"]
        share = np.maximum(n, 1)
        got["covered_fraction"] = got["n_covered_words"] / share
        got["base_failed"] = (n < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_PERCENT * n)
        long_repeat = np.where(got["longest_repeat"] >= repeat_words, got["longest_repeat"], 0)
        got["kept"] = ~got["base_failed"] & (got["covered_fraction"] <= most_covered) & (long_repeat <= most_longest * n)
        return pa.StructArray.from_arrays(
            [pa.array(got[f.name], f.type) for f in _STRUCT], fields=list(_STRUCT)
        )

    return rules.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def keep_varied(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows whose text passes the rules, with their own columns only."""
    limit_batches(docs.sparkSession)
    mark = fresh_name(docs, "verdict")
    judged = docs.withColumn(mark, repetition_rules(text_col, **limits))
    return judged.where(F.col(mark)["kept"]).select([docs_col(c) for c in docs.columns])


def docs_col(name: str) -> Column:
    return F.col(f"`{name}`")
