"""Keys of 23-bit words from the perfect binary Golay code.

Every 23-bit word is at distance 3 or less from just one codeword. A word's keys are that codeword's index (12 bits)
and, where the distance is 3, the indices of the five codewords at distance 4. Two words that differ in two bits or
fewer always have a key in common; ``shares_within_two`` tries all cases. The code is linear, so what must be added to
a word to reach its codewords depends on its syndrome alone, and a table over the 2,048 syndromes is all that is needed.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each word after division by the generator."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECK_BITS)), rest)
    return rest


@cache
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: how many codewords count as near (1 or 6), and what to add to reach each of them."""
    errors = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(LENGTH), w)])
    of = syndromes(errors)
    order = np.argsort(of, kind="stable")  # light patterns come first within a syndrome
    starts = np.searchsorted(of[order], np.arange(1 << CHECK_BITS))
    counts = np.diff(np.append(starts, len(order)))
    table = np.zeros((1 << CHECK_BITS, 6), np.int64)
    for k in range(6):
        has = counts > k
        table[has, k] = errors[order[starts[has] + k]]
    return counts, table


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of each word, and how many of the six count."""
    counts, table = patterns()
    s = syndromes(words)
    return (words.astype(np.int64)[:, None] ^ table[s]) >> CHECK_BITS, counts[s]


def shares_within_two() -> bool:
    """Whether words at distance 0, 1 and 2 have a key in common, tried for every syndrome and difference."""
    counts, table = patterns()
    all_s = np.arange(1 << CHECK_BITS)
    for weight in range(3):
        for c in combinations(range(LENGTH), weight):
            d = sum(1 << i for i in c)
            other = all_s ^ int(syndromes(np.array([d]))[0])
            met = (table[:, :, None] == (table[other] ^ d)[:, None, :]) & (np.arange(6)[:, None] < counts[:, None, None]) & (np.arange(6) < counts[other][:, None, None])
            if not met.any(axis=(1, 2)).all():
                return False
    return True
