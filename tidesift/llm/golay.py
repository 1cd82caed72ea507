"""The binary Golay code of length 23: nearby codewords of any 23-bit word.

The code is perfect: every word is within distance 3 of exactly one codeword.
A word at distance 3 from its codeword has five more at distance 4. Two words
that differ in at most one bit share a codeword among those: if their nearest
codewords differ, both lie at distance 3, and each one's nearest is among the
other's five.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from tidesift.llm.common import per_process

LENGTH, CHECK = 23, 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
NEAR = 6  # codewords listed per word


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 12-bit head, and per syndrome the error patterns to the nearby codewords."""
    heads = np.array([_remainder(head << CHECK) for head in range(1 << (LENGTH - CHECK))], dtype=np.int64)
    patterns = np.full((1 << CHECK, NEAR), -1, dtype=np.int64)
    used = np.zeros(1 << CHECK, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            syndrome = _remainder(pattern)
            # weight 4 only beside a nearest codeword at distance 3
            if weight < 4 or bin(int(patterns[syndrome, 0])).count("1") == 3:
                patterns[syndrome, used[syndrome]] = pattern
                used[syndrome] += 1
    return heads, patterns


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) 12-bit indices of the codewords near each word; -1 where there are fewer."""
    heads, patterns = per_process("golay", _tables)
    words = words.astype(np.int64)
    errors = patterns[heads[words >> CHECK] ^ (words & ((1 << CHECK) - 1))]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK)
