"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of words of up to 23 bits.

Every word lies within 3 bits of exactly one codeword. Two words one bit apart have the same nearest
codeword, or each lies 3 bits from its own and 4 from the other's. So a word has one home index (of
its nearest codeword) and up to six near indices (of all codewords within 4 bits), and of two words at
most one bit apart, the home index of each is among the near indices of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
POLY = 0b101011100011
BITS = 23


def syndrome(word: int) -> int:
    for k in range(BITS - 1, 10, -1):
        if word >> k & 1:
            word ^= POLY << (k - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: error patterns to all codewords within 4 bits (the nearest first), how many; syndromes of 2048-word parts."""
    one = [syndrome(1 << k) for k in range(BITS)]
    found: dict[int, list[int]] = {0: [0]}
    for w in range(1, 5):
        for places in combinations(range(BITS), w):
            s = e = 0
            for p in places:
                s ^= one[p]
                e |= 1 << p
            if w < 4 or len(f := found[s]) and f[0].bit_count() == 3:
                found.setdefault(s, []).append(e)
    count = np.array([len(found[s]) for s in range(2048)], np.int64)
    errors = np.zeros((2048, 6), np.int64)
    for s, e in found.items():
        errors[s, : len(e)] = e
    high = np.array([syndrome(x << 11) for x in range(4096)], np.int64)
    return errors, count, high


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word six 12-bit codeword indices, the home index first, and how many of them count."""
    errors, count, high = tables()
    s = (words & 2047) ^ high[words >> 11]
    return (words[:, None] ^ errors[s]) >> 11, count[s]
