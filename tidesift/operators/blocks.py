"""Pairs inside buckets as products of bounded blocks.

Both sides of a bucket are cut into slices of bounded size; every slice pair is
one group of a cogrouped Arrow function. A hot bucket becomes many tasks, and
only matching pairs leave a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD_BYTES_PER_CORE = 128 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small input one partition per core before CPU-heavy row work.

    A single small file is one task however long each row takes. Large inputs
    already come in enough partitions and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPREAD_BYTES_PER_CORE else df


def cogroup_slices(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    slice_rows: int,
    weight: Column | None = None,
    slice_weight: int = 1 << 31,
    triangle: bool = False,
) -> DataFrame:
    """Apply ``kernel`` to all slice pairs of equal bucket.

    Slices per bucket follow its counted rows, or its summed ``weight`` if that
    needs more. A row goes to one slice of its own side and to every slice of
    the other side. With ``triangle`` both sides are one table, and only slice pairs
    ``ls`` <= ``rs`` are formed.
    """
    weight = F.lit(0).cast("long") if weight is None else weight.cast("long")

    def counted(df: DataFrame, name: str) -> DataFrame:
        rows, load = F.count(F.lit(1)) / slice_rows, F.sum(weight) / slice_weight
        return df.groupBy("bucket").agg(F.ceil(F.greatest(rows, load)).alias(name))

    slices = counted(left, "_left").join(counted(right, "_right"), "bucket")

    def sliced(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        cut = df.join(slices, "bucket").withColumn(own_name, F.pmod(F.xxhash64("uid"), F.col(own)))
        least = F.col("ls") if triangle and own_name == "ls" else F.lit(0).cast("long")
        most = F.col("rs") if triangle and own_name == "rs" else F.col(other) - 1
        copies = F.explode(F.sequence(least, most)).alias(other_name)
        # fresh aliases: both sides may come from the same table
        return cut.select(own_name, copies, *[F.col(c).alias(c) for c in df.columns])

    keys = ["bucket", "ls", "rs"]
    a = sliced(left, "_left", "_right", "ls", "rs").groupBy(*keys)
    b = sliced(right, "_right", "_left", "rs", "ls").groupBy(*keys)
    return a.cogroup(b).applyInArrow(kernel, schema)


def list_lengths(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, list length per row)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(array.offsets))
    return np.asarray(array.flatten()), lengths


class CountBlock:
    """Sparse rows of (gram, repeats) built from sorted gram lists."""

    def __init__(self, table: pa.Table):
        self.uid = table.column("uid").to_numpy()
        flat, lengths = list_lengths(table.column("grams"))
        row = np.repeat(np.arange(len(lengths)), lengths)
        first = np.ones(len(flat), dtype=bool)
        first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(first)
        self.gram, self.row = flat[starts], row[starts]
        self.count = np.diff(np.append(starts, len(flat))).astype(np.float64)
        n = len(self.uid)
        self.squares = np.bincount(self.row, self.count * self.count, n)
        self.kinds = np.bincount(self.row, minlength=n).astype(np.float64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats hashing on these arrays."""
    ordered = np.sort(values)
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return ordered[first]


def count_products(
    a: CountBlock, b: CountBlock, binary: bool, possible: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Products of all row pairs of two blocks, and for which pairs they are exact.

    Frequent grams go through one dense matrix product, the others through
    their short lists of rows. ``possible`` tells from an upper bound of the
    products which pairs matter; the rare grams of rows without such a pair are
    left out. The bound adds what the rare grams of both rows can give at most:
    the product of their lengths, or the smaller number of them.
    """
    na, nb = len(a.uid), len(b.uid)
    small, large = sorted((_distinct(a.gram), _distinct(b.gram)), key=len)
    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
    vocabulary = small[large[at] == small] if len(large) else small

    def indexed(block: CountBlock):
        at = np.searchsorted(vocabulary, block.gram)
        inside = at < len(vocabulary)
        inside[inside] = vocabulary[at[inside]] == block.gram[inside]
        order = np.argsort(at[inside], kind="stable")
        values = np.ones(len(order)) if binary else block.count[inside][order]
        return at[inside][order], block.row[inside][order], values

    ga, ra, va = indexed(a)
    gb, rb, vb = indexed(b)
    fa, fb = np.bincount(ga, minlength=len(vocabulary)), np.bincount(gb, minlength=len(vocabulary))
    frequent = fa * fb > max(na * nb // 100, 64)
    out = np.zeros((na, nb))

    hot = np.flatnonzero(frequent)
    for start in range(0, len(hot), 4096):
        place = np.full(len(vocabulary), -1)
        chosen = hot[start : start + 4096]
        place[chosen] = np.arange(len(chosen))
        dense = []
        for n, g, r, v in ((na, ga, ra, va), (nb, gb, rb, vb)):
            matrix = np.zeros((n, len(chosen)))
            hit = place[g] >= 0
            matrix[r[hit], place[g[hit]]] = v[hit]
            dense.append(matrix)
        out += dense[0] @ dense[1].T

    rare = ~frequent[ga]
    ga, ra, va = ga[rare], ra[rare], va[rare]
    exact = np.ones((na, nb), dtype=bool)
    if possible is not None:
        rare = ~frequent[gb]
        gb, rb, vb = gb[rare], rb[rare], vb[rare]
        left, right = np.bincount(ra, va * va, na), np.bincount(rb, vb * vb, nb)
        rest = np.minimum(left[:, None], right[None, :]) if binary else np.sqrt(left[:, None] * right[None, :])
        exact = possible(out + rest * (1 + 1e-12) + 1e-9)
        wanted = exact.any(axis=1)[ra]
        ga, ra, va = ga[wanted], ra[wanted], va[wanted]
        wanted = exact.any(axis=0)[rb]
        gb, rb, vb = gb[wanted], rb[wanted], vb[wanted]
        fb = np.bincount(gb, minlength=len(vocabulary))
    first_b = np.concatenate([[0], np.cumsum(fb)])
    times = fb[ga]
    ends = np.cumsum(times)
    step, begin = 4_000_000, 0
    while begin < len(ga):
        done = ends[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(ends, done + step, side="right")), begin + 1)
        reps = times[begin:stop]
        which = np.repeat(np.arange(begin, stop), reps)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
        other = first_b[ga[which]] + inner
        flat = ra[which] * nb + rb[other]
        out += np.bincount(flat, va[which] * vb[other], na * nb).reshape(na, nb)
        begin = stop
    return out, exact
