"""Finding many phrases at once in batches of texts: places of all phrases of a list, overlapping ones too.

Every phrase has an anchor, a part of 8, 4, 2 or 1 characters, the one that fewest phrases have. All places of a batch are
hashed by their next characters in one pass per length, whatever the number of phrases; where a hash is that of an
anchor, its phrases are compared character by character. Texts are taken in pieces of about ``PIECE`` bytes, so memory does
not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LENGTHS = (8, 4, 2, 1)
PIECE = 1 << 20
_TABLE_BITS = 20
_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def hashes(chars: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """Of every place the hash of the next n characters, for n of ``LENGTHS``."""
    out, h, n = {}, (chars.astype(np.uint64) + np.uint64(1)) * _FIRST, 1
    for k in range(4):
        if n in lengths:
            mixed = h ^ (h >> np.uint64(29))
            out[n] = mixed * _FIRST
        if n >= max(lengths) or len(h) <= n:
            break
        h = (h[:-n] ^ (h[:-n] >> np.uint64(31))) * _NEXT[k] + h[n:]
        n *= 2
    return out


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, characters, places where rows begin and the last ends) of rows together; nulls are empty."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
        part, at = raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        begins = part & 0xC0 != 0x80
        if len(part) and part.max() >= 128:
            chars = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.dtype("<u4"))
            at = np.concatenate([[0], np.cumsum(begins)])[at]
        else:
            chars = part
        yield first, chars, at
        first = last


class Phrases:
    """Phrases (not empty) to be searched together."""

    def __init__(self, phrases: Sequence[str]):
        self.sizes = np.array([len(p) for p in phrases], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.chars = np.frombuffer("".join(phrases).encode("utf-32-le"), np.dtype("<u4"))
        kind = np.array([next((n for n in LENGTHS if n <= s), 0) for s in self.sizes.tolist()], np.int64)
        owner = np.repeat(np.arange(len(phrases)), self.sizes)
        self.lengths = [n for n in LENGTHS if (kind == n).any()]
        self.index = {}
        for n, h in (hashes(self.chars, self.lengths) if self.lengths else {}).items():
            at = np.flatnonzero((kind[owner[: len(h)]] == n) & (np.arange(len(h)) + n <= self.starts[owner[: len(h)] + 1]))
            _, group, count = np.unique(h[at], return_inverse=True, return_counts=True)
            order = np.lexsort((at, count[group], owner[at]))
            one = at[order][np.unique(owner[at][order], return_index=True)[1]]
            one = one[np.argsort(h[one], kind="stable")]
            keys, begin = np.unique(h[one], return_index=True)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[keys >> np.uint64(64 - _TABLE_BITS)] = True
            self.index[n] = (table, keys, np.append(begin, len(one)), owner[one], one - self.starts[owner[one]])

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, place) of all places, in this order."""
        found = [self._piece(*p) for p in pieces(texts)] if self.lengths else []
        row, phrase, place = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(3))
        order = np.lexsort((place, phrase, row))
        return row[order], phrase[order], place[order]

    def _piece(self, first: int, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.zeros(0, np.int64),) * 3]
        for n, h in (hashes(chars, self.lengths) if len(chars) else {}).items():
            table, keys, begin, phrases, offset = self.index[n]
            at = np.flatnonzero(table[h >> np.uint64(64 - _TABLE_BITS)])
            key = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            same = keys[key] == h[at]
            at, key = at[same], key[same]
            many = begin[key + 1] - begin[key]
            # As many comparisons at a time as the piece has characters.
            turn = np.cumsum(many) // max(PIECE, 1)
            for t in np.unique(turn):
                now = turn == t
                some = many[now]
                which = np.repeat(begin[key[now]], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
                out.append(self._compared(chars, ends, phrases[which], np.repeat(at[now], some) - offset[which]))
        phrase, row, place = (np.concatenate(x) for x in zip(*out))
        return row + first, phrase, place

    def _compared(self, chars, ends, phrase, start):
        row = np.searchsorted(ends, np.maximum(start, 0), "right") - 1
        inside = (start >= ends[row]) & (start + self.sizes[phrase] <= ends[np.minimum(row + 1, len(ends) - 1)])
        phrase, row, start = phrase[inside], row[inside], start[inside]
        step, j = np.arange(8), 0
        done = [(phrase[:0], row[:0], start[:0])]
        while len(start):
            # Eight characters more of each; beyond the end of a phrase its last one is compared again.
            on = np.minimum(j + step, self.sizes[phrase][:, None] - 1)
            same = (chars[start[:, None] + on] == self.chars[self.starts[phrase][:, None] + on]).all(axis=1)
            phrase, row, start = phrase[same], row[same], start[same]
            j += 8
            over = self.sizes[phrase] <= j
            done.append((phrase[over], row[over], start[over]))
            phrase, row, start = phrase[~over], row[~over], start[~over]
        phrase, row, start = (np.concatenate(x) for x in zip(*done))
        return phrase, row, start - ends[row]


def apart(row: np.ndarray, phrase: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the places in order are left if a phrase's next one begins where the last has ended, from the front."""
    keep = np.ones(len(place), bool)
    near = np.flatnonzero((row[1:] == row[:-1]) & (phrase[1:] == phrase[:-1]) & (place[1:] < place[:-1] + sizes[phrase[:-1]])) + 1
    last = -1
    for i in near.tolist():
        # ``last``: the last kept place before i of the same row and phrase.
        if not keep[i - 1] and row[last] == row[i] and phrase[last] == phrase[i]:
            before = last
        else:
            before = i - 1
        keep[i] = place[i] >= place[before] + sizes[phrase[i]]
        last = i if keep[i] else before
    return keep
