"""Decoding with the perfect binary Golay code of 23 bits, which corrects three errors."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial (fixed value): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS, CHECK_BITS = 23, 11


def _remainder(value: int) -> int:
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - CHECK_BITS)
    return value


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the high bits alone, and the error pattern (at most 3 bits) of each remainder."""
    high = np.array([_remainder(v << CHECK_BITS) for v in range(1 << (BITS - CHECK_BITS))], np.uint32)
    errors = np.zeros(1 << CHECK_BITS, np.uint32)
    for weight in range(1, 4):
        for places in combinations(range(BITS), weight):
            pattern = sum(1 << p for p in places)
            errors[_remainder(pattern)] = pattern
    return high, errors


def nearest(values: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within distance 3 of each 23-bit value; there is exactly one."""
    high, errors = _tables()
    values = values.astype(np.uint32)
    syndrome = high[values >> CHECK_BITS] ^ (values & ((1 << CHECK_BITS) - 1))
    return (values ^ errors[syndrome]) >> CHECK_BITS
