"""The binary Golay code of length 23, as a fuzzy hash of 16 bits.

The code is perfect: each 23-bit word has exactly one codeword within 3 bits. So if
two words differ in at most one bit, the codeword nearest to the one lies within 4
bits of the other. Sixteen bits are taken as a 23-bit word with seven zero bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 16
#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def codewords() -> np.ndarray:
    """All 4096 codewords; a codeword's index is the polynomial that gives it."""
    index = np.arange(4096, dtype=np.int64)
    words = np.zeros_like(index)
    for bit in range(12):
        words ^= np.where(index >> bit & 1, GENERATOR << bit, 0)
    return words


def patterns(weight: int, bits: int = BITS) -> np.ndarray:
    """All words with at most ``weight`` of ``bits`` bits set."""
    return np.array(
        [sum(1 << b for b in chosen) for w in range(weight + 1) for chosen in combinations(range(bits), w)],
        dtype=np.int64,
    )


@cache
def near() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16-bit value, the indices of the codewords within 4 bits.

    Returns (starts, indices, nearest): value v has ``indices[starts[v]:starts[v + 1]]``,
    and ``nearest`` marks the one within 3 bits.
    """
    words = codewords()
    weight = np.bitwise_count(words >> BITS).astype(int)
    values, owners, far = [], [], []
    for w in range(5):
        own = np.flatnonzero(weight == w)
        flips = patterns(4 - w)
        values.append(((words[own] & 0xFFFF)[:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(own, len(flips)))
        far.append((w + np.bitwise_count(flips).astype(int))[None, :].repeat(len(own), 0).ravel())
    value, owner, distance = (np.concatenate(x) for x in (values, owners, far))
    order = np.lexsort((owner, value))
    starts = np.searchsorted(value[order], np.arange((1 << BITS) + 1))
    return starts, owner[order], distance[order] <= 3
