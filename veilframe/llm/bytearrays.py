"""Text as arrays of bytes: words, lines and rolling hashes without a Python step per word."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Code points 9 to 13 and 32 separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(_BASE_INVERSE)


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``count`` of each."""
    size = 1 << 20
    while size < count:
        size *= 2
    return _powers(size)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of xor-shifts and multiplications)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial hash of 64-bit codes; see ``span_hash``."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of a running hash, the same wherever the span stands."""
    _, down = powers(len(prefix) + 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_prefix(raw: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_CODES[raw])


@dataclass
class Words:
    """Words of several texts, each text's words joined by single spaces in ``norm``."""

    norm: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(byte_prefix(self.norm), self.starts, self.ends)


def separated(raw: np.ndarray, at: np.ndarray, mark: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one byte after each, and where each begins then."""
    out = np.full(int(at[-1] - at[0]) + len(at) - 1, mark, np.uint8)
    begins = at - at[0] + np.arange(len(at))
    for i in range(len(at) - 1):
        out[begins[i] : begins[i + 1] - 1] = raw[at[i] : at[i + 1]]
    return out, begins


def words(raw: np.ndarray, at: np.ndarray) -> Words:
    """Split texts (bytes and offsets) at white space."""
    text, begins = separated(raw, at)
    blank = SPACE[text]
    before = np.empty_like(blank)
    before[0:1] = True
    before[1:] = blank[:-1]
    begins = begins[:-1]
    before[begins] = True  # no separator stands before a text's first byte
    keep = ~(blank & before)
    norm = text[keep]
    norm[blank[keep]] = 32
    kept = np.zeros(len(text) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    ends = np.flatnonzero(norm == 32)
    starts = np.empty_like(ends)
    starts[0:1] = 0
    starts[1:] = ends[:-1] + 1
    first = np.empty(len(at), np.int64)
    first[:-1] = np.searchsorted(starts, kept[begins])
    first[-1] = len(starts)
    return Words(norm, starts, ends, first)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of per-item values for each text, with ``first`` as in ``Words``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
