"""Re-Pair grammar compression of a shard of ids, in numpy.

Each round counts all adjacent pairs, gives the most frequent ones a
nonterminal each and replaces their occurrences from left to right, until no
pair occurs ``LEAST_PAIRS`` times. The grammar is (rules, symbols, sizes); the
sizes are the ids each rule expands to, so any range of the shard is decoded
without the rest.

Defined results
    ties        pairs of equal count are taken in ascending order
    no ids      a grammar without rules and symbols
    repeats     a run of one id halves with every round
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RULES_PER_ROUND = 16_384
LEAST_PAIRS = 4
_BUCKET_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * _MIX) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)


def _frequent(pairs: np.ndarray, bucket: np.ndarray, most: int, least: int) -> tuple[np.ndarray, bool]:
    """The most frequent pairs, ascending, and whether these are all that are frequent.

    Pairs whose hash bucket holds fewer than ``least`` are rare for certain;
    only the others are sorted and counted.
    """
    crowded = np.bincount(bucket, minlength=1 << _BUCKET_BITS) >= least
    ordered = np.sort(pairs[crowded[bucket]])
    if not len(ordered):
        return ordered, True
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[heads, len(ordered)])
    good = np.flatnonzero(counts >= least)
    whole = len(good) <= most
    if not whole:
        # ties by the pair itself, so that equal shards give equal files
        good = good[np.lexsort((heads[good], -counts[good]))[:most]]
    return np.sort(ordered[heads[good]]), whole


def _found(pairs: np.ndarray, bucket: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs that are in ``top``, and where there.

    A bucket names one pair of ``top``; only where that is another one, the
    sorted pairs are searched.
    """
    named = np.full(1 << _BUCKET_BITS, -1, dtype=np.int32)
    named[_buckets(top)] = np.arange(len(top), dtype=np.int32)
    rule = named[bucket]
    at = np.flatnonzero(rule >= 0)
    rule, pairs = rule[at], pairs[at]
    other = np.flatnonzero(top[rule] != pairs)
    rule[other] = np.minimum(np.searchsorted(top, pairs[other]), len(top) - 1)
    hit = np.ones(len(at), dtype=bool)
    hit[other] = top[rule[other]] == pairs[other]
    return at[hit], rule[hit]


def _replace(seq: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The sequence with the pairs that begin at ``at`` replaced by ``symbols``."""
    # in a run of overlapping hits every other one is replaced, from the left
    heads = np.r_[True, np.diff(at) != 1]
    index = np.arange(len(at))
    even = (index - np.maximum.accumulate(np.where(heads, index, 0))) % 2 == 0
    at, symbols = at[even], symbols[even]
    out = seq.copy()
    out[at] = symbols
    stay = np.ones(len(seq), dtype=bool)
    stay[at + 1] = False
    return out[stay]


@dataclass
class Grammar:
    base: int  # symbols below are ids
    rules: np.ndarray  # (n, 2): what nonterminal base + i stands for
    sizes: np.ndarray  # ids that each rule expands to
    symbols: np.ndarray

    def _widths(self, symbols: np.ndarray) -> np.ndarray:
        width = np.ones(len(symbols), dtype=np.int64)
        inner = symbols >= self.base
        width[inner] = self.sizes[symbols[inner] - self.base]
        return width

    def ends(self) -> np.ndarray:
        """Position in the shard at which each symbol's expansion ends."""
        return np.cumsum(self._widths(self.symbols))

    def decode(self, start: int = 0, stop: int | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """The ids of the shard, or of a range of it.

        Every symbol's place in the output is known from the sizes, so a step
        touches only nonterminals that are still to be expanded.
        """
        ends = self.ends() if ends is None else ends
        stop = (int(ends[-1]) if len(ends) else 0) if stop is None else stop
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        symbols = self.symbols[a:b].astype(np.int64)
        origin = int(ends[a - 1]) if a else 0
        places = np.r_[origin, ends[a : b - 1]] - origin
        out = np.empty(int(ends[b - 1]) - origin, dtype=np.uint32)
        while len(symbols):
            inner = symbols >= self.base
            out[places[~inner]] = symbols[~inner]
            places, pair = places[inner], self.rules[symbols[inner] - self.base]
            places = np.concatenate([places, places + self._widths(pair[:, 0])])
            symbols = np.concatenate([pair[:, 0], pair[:, 1]])
        return out[start - origin : stop - origin]


def compress(ids: np.ndarray, base: int, most: int = RULES_PER_ROUND, least: int = LEAST_PAIRS) -> Grammar:
    """The grammar of a shard; ids must be below ``base``, ``least`` at least 2.

    A round replaces or breaks up every occurrence of the pairs it takes. Once
    it takes all frequent ones, a frequent pair of the next round holds a symbol
    that this one made, so only the pairs around those are counted.
    """
    seq = ids.astype(np.uint32)
    rules, sizes, n = [np.zeros((0, 2), dtype=np.int64)], np.ones(base, dtype=np.int64), base
    fresh = 0  # symbols from here on may be in frequent pairs
    while len(seq) > 1:
        if fresh:
            new = seq >= fresh
            places = np.flatnonzero(new[:-1] | new[1:])
            pairs = (seq[places].astype(np.uint64) << np.uint64(32)) | seq[places + 1]
        else:
            pairs = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        bucket = _buckets(pairs)
        top, whole = _frequent(pairs, bucket, most, least)
        if not len(top):
            break
        at, rule = _found(pairs, bucket, top)
        seq = _replace(seq, places[at] if fresh else at, (n + rule).astype(np.uint32))
        halves = np.stack([top >> np.uint64(32), top & np.uint64(2**32 - 1)], axis=1).astype(np.int64)
        rules.append(halves)
        sizes = np.concatenate([sizes, sizes[halves].sum(axis=1)])
        # pairs left over keep their places among the fresh symbols
        fresh = n if whole else fresh
        n += len(halves)
    return Grammar(base, np.concatenate(rules), sizes[base:], seq)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Numbers below ``2 ** width`` as ``width`` bit planes."""
    return b"".join(np.packbits((values >> bit) & 1 == 1).tobytes() for bit in range(width))


def unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    """The inverse of ``pack_bits``."""
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1) if n else np.zeros((0, 0), np.uint8)
    out = np.zeros(n, dtype=np.uint32)
    for bit, plane in enumerate(planes):
        out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(bit)
    return out
