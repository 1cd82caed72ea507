"""Train/validation/test splits, stage sets and experiment mixes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.operators.rank import assign_parts, with_rank
from tidesift.operators.sampling import (
    SEED,
    draw_frac,
    draw_n,
    exact,
    half_even,
    noise_quota,
    sample_frac,
    sample_n,
)

PARTS = ("train", "validation", "test")


def allocate(counts: dict, n: int) -> dict:
    """Share n draws over classes by largest remainder; ties go to the lower class."""
    total = sum(counts.values())
    if total == 0:
        return {c: 0 for c in counts}
    shares = {c: counts[c] * n // total for c in counts}
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * n % total), str(c)))
    for c in by_remainder[: n - sum(shares.values())]:
        shares[c] += 1
    return shares


def plan_parts(counts: dict, validation, test) -> dict:
    """{class: [train, validation, test]}: the held-out part is rounded up, the rest trains."""
    total = sum(counts.values())
    held_out = exact(validation) + exact(test)
    n_held = math.ceil(held_out * total)
    train = allocate(counts, total - n_held)
    left = {c: counts[c] - train[c] for c in counts}
    n_test = math.ceil(exact(test) / held_out * n_held) if held_out else 0
    val = allocate(left, n_held - n_test)
    return {c: [train[c], val[c], left[c] - val[c]] for c in counts}


def stratified_split(
    df: DataFrame,
    by: str,
    validation="0.1",
    test="0.1",
    key: str = "uid",
    seed: int = SEED,
    name: str = "split",
) -> DataFrame:
    """Add ``split`` with exact sizes and the class mix of the whole in every part.

    Rows are ranked in their class and joined with the table of class sizes, so
    any number of classes takes the same way. Null is a class of its own; ties
    of remainders go to the lower class, null last.
    """
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    held_out = exact(validation) + exact(test)
    n_held = math.ceil(held_out * total)
    n_test = math.ceil(exact(test) / held_out * n_held) if held_out else 0
    sizes = _allocate_column(sizes, "_n", total, total - n_held, by, "_train")
    sizes = sizes.withColumn("_left", F.col("_n") - F.col("_train"))
    sizes = _allocate_column(sizes, "_left", n_held, n_held - n_test, by, "_val")
    ranked = with_rank(df, key, seed, by=[by], name="_rank")
    sizes = sizes.withColumnRenamed(by, "_class")
    joined = ranked.join(sizes, F.col(by).eqNullSafe(F.col("_class")))
    part = (
        F.when(F.col("_rank") <= F.col("_train"), PARTS[0])
        .when(F.col("_rank") <= F.col("_train") + F.col("_val"), PARTS[1])
        .otherwise(PARTS[2])
    )
    return joined.withColumn(name, part).select(*df.columns, name)


def _allocate_column(sizes, count: str, total: int, n: int, by: str, out: str) -> DataFrame:
    """``allocate`` on a table of class sizes; the leftover goes by rank of the remainder."""
    total = max(total, 1)
    shared = sizes.withColumn("_whole", F.expr(f"({count} * {n}L) div {total}L")).withColumn(
        "_rest", F.expr(f"({count} * {n}L) % {total}L")
    )
    left = n - (shared.agg(F.sum("_whole")).first()[0] or 0)
    # top-n by remainder as a bounded sort-and-limit, not a global window
    extra = (
        shared.orderBy(F.desc("_rest"), F.col(by).cast("string").asc_nulls_last())
        .limit(left)
        .select(F.col(by).alias("_extra"), F.lit(True).alias("_more"))
    )
    return (
        shared.join(extra, F.col(by).eqNullSafe(F.col("_extra")), "left")
        .withColumn(out, F.col("_whole") + F.coalesce(F.col("_more"), F.lit(False)).cast("long"))
        .drop("_whole", "_rest", "_extra", "_more")
    )


def random_split(
    df: DataFrame, validation="0.1", test="0.1", key: str = "uid", seed: int = SEED, name: str = "split"
) -> DataFrame:
    """Unstratified split with exact sizes."""
    part = assign_parts(df, key, seed, lambda counts: plan_parts(counts, validation, test), PARTS)
    return df.withColumn(name, part)


@dataclass
class Pools:
    disaster: DataFrame
    weather: DataFrame
    out_topic: DataFrame

    def union(self) -> DataFrame:
        return self.disaster.unionByName(self.weather, allowMissingColumns=True).unionByName(
            self.out_topic, allowMissingColumns=True
        )

    @classmethod
    def of(cls, df: DataFrame, subset: str = "subset") -> "Pools":
        return cls(*[df.filter(F.col(subset) == name) for name in ("disaster", "weather", "out_topic")])


def split_fraction(
    pools: Pools, fraction="0.1", times=20, quota: str = "net", key: str = "uid", seed: int = SEED
) -> tuple[DataFrame, Pools]:
    """(drawn set, remaining pools): a fraction of disaster and weather plus the noise quota."""
    disaster, disaster_left = draw_frac(pools.disaster, fraction, key, seed)
    weather, weather_left = draw_frac(pools.weather, fraction, key, seed)
    n = noise_quota(disaster, weather, times, quota)
    noise, noise_left = draw_n(pools.out_topic, n, key, seed)
    return Pools(disaster, weather, noise).union(), Pools(disaster_left, weather_left, noise_left)


def crossed_strategy(
    pools: Pools, fraction="0.1", times=20, key: str = "uid", seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(stage 1, stage 2): stage 1 by fraction, everything left for stage 2."""
    stage_1, left = split_fraction(pools, fraction, times, "net", key, seed)
    return stage_1, left.union()


def isolated_strategy(
    pools: Pools, times=20, weather_fraction="0.5", key: str = "uid", seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(stage 1, stage 2): stage 1 takes rows without a humanitarian label, half the
    weather pool and the quota; stage 2 the rest."""
    disaster = pools.disaster.filter(F.col("humanitarian_label").isNull())
    disaster_left = pools.disaster.filter(F.col("humanitarian_label").isNotNull())
    weather, weather_left = draw_frac(pools.weather, weather_fraction, key, seed)
    noise, noise_left = draw_n(pools.out_topic, noise_quota(disaster, weather, times), key, seed)
    return (
        Pools(disaster, weather, noise).union(),
        Pools(disaster_left, weather_left, noise_left).union(),
    )


def stage3_sets(disaster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a humanitarian label, non-informative rows)."""
    return disaster.filter(F.col("humanitarian_label").isNotNull()), disaster.filter(~F.col("informative"))


def experiment_mix(
    pools: Pools, n_weather: int, n_out_topic: int, fraction="1.0", key: str = "uid", seed: int = SEED
) -> DataFrame:
    """Base rows plus exact counts of both noise pools."""
    mixed = Pools(
        pools.disaster,
        sample_n(pools.weather, n_weather, key, seed),
        sample_n(pools.out_topic, n_out_topic, key, seed),
    ).union()
    return mixed if exact(fraction) == 1 else sample_frac(mixed, fraction, key, seed)


def experiment_grid(pools: Pools, grid: Sequence[tuple[int, int]], key: str = "uid", seed: int = SEED) -> DataFrame:
    """One mix per (n_weather, n_out_topic), told apart by two columns."""
    mixes = [
        experiment_mix(pools, w, o, key=key, seed=seed).select(
            F.lit(w).alias("n_weather"), F.lit(o).alias("n_out_topic"), "*"
        )
        for w, o in grid
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mixes)


def event_holdout_split(
    df: DataFrame,
    validation_events: Sequence[str],
    test_events: Sequence[str],
    train_types: Sequence[str],
    train_events: Sequence[str] = (),
    undefined_types: Sequence[str] = (),
    undefined_events: Sequence[str] = (),
    by: str = "informative",
    validation="0.15",
    test="0.15",
    key: str = "uid",
    seed: int = SEED,
) -> DataFrame:
    """Whole events to one side; rows without a usable event are split at random.

    ``train_types`` are event types whose other events all train, ``train_events``
    single events that train. Rows matching none of the rules are left out.
    """
    event, kind = F.col("event_name"), F.col("event_type")
    undefined = F.coalesce(
        kind.isin(list(undefined_types)) | event.isNull() | event.isin(list(undefined_events)), F.lit(False)
    )
    fixed = (
        F.when(event.isin(list(validation_events)), "validation")
        .when(event.isin(list(test_events)), "test")
        .when(event.isin(list(train_events)) | kind.isin(list(train_types)), "train")
    )
    held = df.filter(~undefined).withColumn("split", fixed).filter(F.col("split").isNotNull())
    drawn = stratified_split(df.filter(undefined), by, validation, test, key, seed)
    return held.unionByName(drawn)


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and share of each part; the few part counts meet in one row."""
    sizes = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    gathered = sizes.agg(F.collect_list(F.struct(split, "n_rows")).alias("_parts"), F.sum("n_rows").alias("_total"))
    return gathered.select("_total", F.inline("_parts")).select(
        split, "n_rows", F.round(F.col("n_rows") / F.col("_total"), 6).alias("share")
    )
