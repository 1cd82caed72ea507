"""Deterministic order by hash, without a one-task sort.

Rows are ordered by ``md5(seed | key), key``. The first hex digits of the hash
split the table into equal ranges, so the position of a row is the number of
rows in the earlier ranges plus its position inside its own range. No sampled
bounds are involved: a recomputed task gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidesift.session import Workspace

RANGE_DIGITS = 3  # 4,096 ranges

_HASH, _RANGE = "_order_hash", "_order_range"


def order_hash(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _keyed(df: DataFrame, key: str, seed, digits: int) -> DataFrame:
    hashed = df.withColumn(_HASH, order_hash(seed, key))
    return hashed.withColumn(_RANGE, F.substring(_HASH, 1, digits))


def with_rank(
    df: DataFrame,
    key: str,
    seed: int | str,
    by: Sequence[str] = (),
    name: str = "rank",
    digits: int = RANGE_DIGITS,
) -> DataFrame:
    """Add the dense position 1..n of every row, per class if ``by`` is given.

    Join and window share one exchange on (class, range). The running total
    reads one row per (class, range), at most 16**digits per class.
    """
    by = list(by)
    keyed = _keyed(df, key, seed, digits)
    sizes = keyed.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"_start_{c}") for c in by],
        F.col(_RANGE).alias("_start_range"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    match = F.col(_RANGE) == F.col("_start_range")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_start_{c}"))
    inside = Window.partitionBy(*by, _RANGE).orderBy(_HASH, key)
    ranked = keyed.join(starts, match).withColumn(
        name, F.col("_start") + F.row_number().over(inside).cast("long")
    )
    return ranked.select(*df.columns, name)


def _range_sizes(df: DataFrame, key: str, seed, by: str | None, digits: int) -> dict:
    """{class: {range: rows}}; at most 16**digits numbers per class reach the driver."""
    cols = [by] if by else []
    counted = _keyed(df, key, seed, digits).groupBy(*cols, _RANGE).count().collect()
    sizes: dict = {}
    for row in counted:
        sizes.setdefault(row[by] if by else None, {})[row[_RANGE]] = row["count"]
    return sizes


def _is_class(by: str | None, value) -> Column:
    return F.lit(True) if by is None else F.col(by).eqNullSafe(F.lit(value))


def assign_parts(
    df: DataFrame,
    key: str,
    seed: int | str,
    plan: Callable[[dict], dict],
    names: Sequence[str],
    by: str | None = None,
    digits: int = RANGE_DIGITS,
) -> Column:
    """A CASE expression putting each row into the part its rank falls in.

    ``plan`` maps {class: rows} to {class: [size of part 1, size of part 2, …]}.
    Only the boundary rows are looked up, so the returned expression is a plain
    row-local filter on (hash, key): no wide shuffle, no join, and "all other
    rows" is just another branch of the same expression. For classes known to
    be few; many classes are ranked with ``with_rank``.
    """
    sizes = _range_sizes(df, key, seed, by, digits)
    totals = {value: sum(ranges.values()) for value, ranges in sizes.items()}
    parts = plan(totals)

    wanted = []  # (class, range, position inside the range, part index)
    for value, ranges in sizes.items():
        cut = 0
        for index, size in enumerate(parts[value]):
            if size < 0:
                raise ValueError(f"part {names[index]!r} has a negative size: {size}")
            cut += size
            if cut > totals[value]:
                raise ValueError(f"{cut} rows asked for, {totals[value]} there (class {value!r})")
            if size == 0:
                continue
            seen = 0
            for range_ in sorted(ranges):
                if seen + ranges[range_] >= cut:
                    wanted.append((value, range_, cut - seen, index))
                    break
                seen += ranges[range_]

    bounds = {}
    if wanted:
        hit = F.lit(False)
        for value, range_, place, _ in wanted:
            hit = hit | (_is_class(by, value) & (F.col(_RANGE) == range_) & (F.col("_place") == place))
        near = F.lit(False)
        for value, range_, _, _ in wanted:
            near = near | (_is_class(by, value) & (F.col(_RANGE) == range_))
        cols = [by] if by else []
        inside = Window.partitionBy(*cols, _RANGE).orderBy(_HASH, key)
        found = (
            _keyed(df.select(key, *cols), key, seed, digits)
            .filter(near)
            .withColumn("_place", F.row_number().over(inside))
            .filter(hit)
            .collect()
        )
        at = {(r[by] if by else None, r[_RANGE], r["_place"]): (r[_HASH], r[key]) for r in found}
        for value, range_, place, index in wanted:
            bounds[(value, index)] = at[(value, range_, place)]

    hash_ = order_hash(seed, key)
    last = F.lit(names[len(names) - 1])
    result = None
    for value in sizes:
        part = None
        for index in range(len(parts[value])):
            if (value, index) not in bounds:
                continue
            h, k = bounds[(value, index)]
            inside_cut = (hash_ < h) | ((hash_ == h) & (F.col(key) <= F.lit(k)))
            label = F.lit(names[index])
            part = F.when(inside_cut, label) if part is None else part.when(inside_cut, label)
        part = last if part is None else part.otherwise(last)
        cond = _is_class(by, value)
        result = F.when(cond, part) if result is None else result.when(cond, part)
    return F.lit(None).cast("string") if result is None else result


def with_place(df: DataFrame, key: str, work: Workspace, name: str = "place") -> DataFrame:
    """Add the position 0..n-1 in the order of a unique key, from range partitions and their sizes."""
    parts = work.keep(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(key)
    placed = parts.join(starts, "_part").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
    return placed.select(*df.columns, name)
