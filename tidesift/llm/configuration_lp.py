"""Bin packing over a length histogram: configuration LP, multiplicative weights, rounding.

A configuration is a multiset of lengths that fits into one bin. The covering
LP asks for the fewest configurations that hold every length as often as the
histogram has it. Multiplicative weights solve it: each length has a weight
that falls as it gets covered, and an unbounded knapsack prices configurations.
One knapsack table prices, beside the heaviest configuration, the heaviest one
with each length in it; a turn takes those within ``SLACK`` of the heaviest, the
least covered length first, each by its width: until its scarcest length is
covered once. Weights over the heaviest price bound the LP from below; turns end
when the cover is within ``GAP`` of that bound.

The cover is scaled to hold each length once, and configurations are taken by
their amounts, rounded down but at least one copy, as far as lengths are left.
What rounding leaves is a smaller histogram that is solved anew, until a pass
places less than ``WORTH`` of its pieces; the last ones are packed best-fit. All
of it works on counts: work and plan grow with the capacity, not with the items.

Defined results
    ties            the least covered length first, then the shorter one
    no lengths      no bins
    full lengths    bins of their own
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

Group = tuple[int, tuple[tuple[int, int], ...]]  # copies, ((length, times), …)
Config = tuple[tuple[int, int], ...]  # ((index of length, times), …)

RATE = 0.5
SLACK = 0.05
GAP = 0.03
TURNS = 60
WORTH = 0.2


class Prices:
    """Heaviest configurations for every room up to the capacity, by dynamic programming."""

    def __init__(self, weights: np.ndarray, lengths: np.ndarray, capacity: int):
        best = np.zeros(capacity + 1)
        taken = [-1] * (capacity + 1)
        filled = [0] * (capacity + 1)  # the smallest room of the same value
        upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
        for room in range(1, capacity + 1):
            best[room], filled[room] = best[room - 1], filled[room - 1]
            k = upto[room]
            if k:
                value = best[room - lengths[:k]] + weights[:k]
                i = int(value.argmax())
                if value[i] > best[room]:
                    best[room], taken[room], filled[room] = value[i], i, room
        self.best, self.taken, self.filled, self.sizes = best, taken, filled, lengths.tolist()

    def config(self, room: int, first: int | None = None) -> dict[int, int]:
        """The heaviest configuration of a room: {index of length: times}, ``first`` surely in it."""
        found: dict[int, int] = {}
        if first is not None:
            found[first] = 1
            room -= self.sizes[first]
        room = self.filled[room]
        while room:
            i = self.taken[room]
            found[i] = found.get(i, 0) + 1
            room = self.filled[room - self.sizes[i]]
        return found


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The heaviest configuration: {index of length: times}."""
    return Prices(weights, lengths, capacity).config(capacity)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, turns: int = TURNS) -> tuple[dict[Config, float], np.ndarray, float]:
    """The fractional cover: amounts of configurations, how often each length is covered, and the lower bound."""
    weights = lengths / capacity
    covered = np.zeros(len(lengths))
    chosen: dict[Config, float] = {}
    total = bound = 0.0
    for _ in range(turns):
        prices = Prices(weights, lengths, capacity)
        least = (1 - SLACK) * prices.best[capacity]
        bound = max(bound, float(counts @ weights) / prices.best[capacity])
        if 0 < total <= (1 + GAP) * bound * covered.min():
            break
        holding = weights + prices.best[capacity - lengths]
        for i in np.argsort(covered, kind="stable").tolist():
            if holding[i] < least:
                continue
            config = prices.config(capacity, i)
            at = np.fromiter(config, dtype=np.int64, count=len(config))
            times = np.fromiter(config.values(), dtype=np.int64, count=len(config))
            if float(weights[at] @ times) < least:
                continue  # covered by others of this turn
            share = times / counts[at]
            amount = float(1 / share.max())
            key = tuple(sorted(config.items()))
            chosen[key] = chosen.get(key, 0.0) + amount
            total += amount
            covered[at] += amount * share
            weights[at] *= np.exp(-RATE * amount * share)
    return chosen, covered, bound


def best_fit(left: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing on counts; bins that look alike are one group."""
    rooms: list[int] = []  # sorted rooms that have open groups
    open_: dict[int, list[list]] = {}

    def put(room: int, group: list) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(group)

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                full, rest = divmod(n, fit)
                if full:
                    put(capacity - fit * length, [full, ((length, fit),)])
                if rest:
                    put(capacity - rest * length, [1, ((length, rest),)])
                break
            room = rooms[at]
            bins, items = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            fit = room // length
            full = min(bins, n // fit)
            if full:
                put(room - fit * length, [full, (*items, (length, fit))])
                n -= full * fit
            if full < bins:
                if n:  # fewer than one bin takes
                    put(room - n * length, [1, (*items, (length, n))])
                    full, n = full + 1, 0
                if full < bins:
                    put(room, [bins - full, items])
    return [(bins, items) for groups in open_.values() for bins, items in groups]


def _round(chosen: dict[Config, float], scale: float, left: np.ndarray) -> list[tuple[int, Config]]:
    """Whole copies of configurations, large amounts first; ``left`` is reduced by what they hold."""
    taken = []
    for config, amount in sorted(chosen.items(), key=lambda c: (-c[1], c[0])):
        copies = min(max(1, int(amount / scale)), *(int(left[i]) // times for i, times in config))
        if copies:
            for i, times in config:
                left[i] -= copies * times
            taken.append((copies, config))
    return taken


def cover_histogram(histogram: dict[int, int], capacity: int, turns: int = TURNS) -> tuple[list[Group], dict[int, int]]:
    """Bins that the linear program places, and the few lengths it leaves."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n), dtype=np.int64)
    if len(lengths) and (lengths[0] < 1 or lengths[-1] > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    groups: list[Group] = []
    while left.any():
        lengths, left = lengths[left > 0], left[left > 0]
        before = int(left.sum())
        chosen, covered, _ = solve(lengths, left.copy(), capacity, turns)
        scale = float(covered.min() or covered.mean())
        for copies, config in _round(chosen, scale, left):
            groups.append((copies, tuple((int(lengths[i]), times) for i, times in config)))
        if before - int(left.sum()) < WORTH * before:
            break
    return groups, {int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}


def pack_histogram(histogram: dict[int, int], capacity: int, turns: int = TURNS) -> list[Group]:
    """Groups of equal bins that hold every length of the histogram exactly as often as it occurs."""
    groups, rest = cover_histogram(histogram, capacity, turns)
    return groups + best_fit(rest, capacity)
