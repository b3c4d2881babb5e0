"""The perfect binary (23, 12) Golay code: decoding of 23-bit words to codeword indices.

Every word lies within distance 3 of exactly one codeword. The codewords of a word and of its 23
neighbours at distance 1 are the word's keys, 6 at most as a rule. Two words at distance 2 or less have a
common neighbour and so always share a key; at distance 3 and 4 more than half of the pairs do.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DIMENSION = 23, 12
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
FLIPS = np.array([0, *(1 << k for k in range(LENGTH))], np.int64)


def _remainder(words: np.ndarray) -> np.ndarray:
    for k in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        words = np.where(words >> k & 1, words ^ (GENERATOR << (k - LENGTH + DIMENSION)), words)
    return words


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = _remainder(np.arange(1 << 12, dtype=np.int64))
    high = _remainder(np.arange(1 << 11, dtype=np.int64) << 12)
    patterns = np.array([sum(1 << k for k in at) for w in range(4) for at in combinations(range(LENGTH), w)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    errors[low[patterns & 4095] ^ high[patterns >> 12]] = patterns
    return low, high, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & 4095] ^ high[words >> 12]]) >> (LENGTH - DIMENSION)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each word and its neighbours at distance 1."""
    got = np.sort(nearest(words[:, None] ^ FLIPS), axis=1)
    new = np.ones(got.shape, bool)
    new[:, 1:] = got[:, 1:] != got[:, :-1]
    row = np.nonzero(new)[0]
    return row, got[new]
