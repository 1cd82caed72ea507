"""Exact-size samples, quotas and balanced draws.

The contract is exact sizes, disjoint parts and the same rows on every run.
A draw is a filter on the hash order (see ``rank``), so its complement is the
negated filter and needs no anti-join.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.operators.rank import assign_parts, order_hash, with_place, with_rank
from tidesift.session import Workspace

SEED = 42
_IN, _OUT = "in", "out"


def exact(number) -> Fraction:
    """The decimal a user wrote, free of binary rounding."""
    return Fraction(Decimal(str(number)))


def half_even(number: Fraction) -> int:
    return round(number)


def _draw(df: DataFrame, size, key: str, seed) -> Column:
    part = assign_parts(df, key, seed, lambda totals: {c: [size(n)] for c, n in totals.items()}, [_IN, _OUT])
    return part == _IN


def draw_n(df: DataFrame, n: int, key: str = "uid", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(exactly n rows, the others). Fails if n is negative or above the row count."""
    if n < 0:
        raise ValueError(f"cannot draw {n} rows")
    if n == 0:
        return df.filter(F.lit(False)), df
    chosen = F.coalesce(_draw(df, lambda _: n, key, seed), F.lit(False))
    rest = df.filter(~chosen)
    drawn = df.filter(chosen)
    return drawn, rest


def draw_frac(df: DataFrame, frac, key: str = "uid", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(round(frac * n) rows, the others); halves round to even."""
    chosen = F.coalesce(_draw(df, lambda n: half_even(exact(frac) * n), key, seed), F.lit(False))
    return df.filter(chosen), df.filter(~chosen)


def sample_n(df: DataFrame, n: int, key: str = "uid", seed: int = SEED) -> DataFrame:
    drawn, _ = draw_n(df, n, key, seed)
    if n and drawn.isEmpty():
        raise ValueError(f"cannot draw {n} rows from an empty table")
    return drawn


def sample_frac(df: DataFrame, frac, key: str = "uid", seed: int = SEED) -> DataFrame:
    return draw_frac(df, frac, key, seed)[0]


def shuffle(df: DataFrame, key: str = "uid", seed: int = SEED) -> DataFrame:
    """Whole table in hash order: ranges of the hash, each sorted on its own."""
    ordered = df.withColumn("_order_hash", order_hash(seed, key))
    return (
        ordered.repartitionByRange("_order_hash", key).sortWithinPartitions("_order_hash", key).drop("_order_hash")
    )


def noise_quota(disaster: DataFrame, weather: DataFrame, times, mode: str = "net") -> int:
    """Out-topic rows needed to reach ``times`` negatives per informative row.

    ``net`` counts the negatives already there; ``simple`` does not.
    """
    true, false = _informative_counts(disaster)
    if mode == "simple":
        return int(true * exact(times))
    if mode == "net":
        return math.ceil(true * exact(times)) - false - weather.count()
    raise ValueError("mode must be 'net' or 'simple'")


def _informative_counts(df: DataFrame) -> tuple[int, int]:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("informative")).alias("t"),
    ).first()
    return row["t"], row["n"] - row["t"]


def balance_classes(
    df: DataFrame, by: str, n: int | None = None, key: str = "uid", seed: int = SEED
) -> DataFrame:
    """The same number of rows from every class, by default the smallest class's."""
    smallest = df.groupBy(by).count().agg(F.min("count")).first()[0]
    if smallest is None:
        return df
    size = smallest if n is None else n
    if size > smallest:
        raise ValueError(f"{size} rows asked for of every class, the smallest has {smallest}")
    return with_rank(df, key, seed, by=[by], name="_rank").filter(F.col("_rank") <= size).drop("_rank")


def failed_predictions(df: DataFrame, label: str = "informative", predicted: str = "predicted") -> DataFrame:
    """Rows whose prediction differs from the label, compared as numbers."""
    return df.filter(F.col(label).cast("int") != F.col(predicted).cast("int"))


def hard_negatives(
    df: DataFrame, times: int = 8, label: str = "informative", key: str = "uid", seed: int = SEED
) -> DataFrame:
    """All false negatives plus ``times`` as many false positives."""
    failed = failed_predictions(df, label)
    negatives = failed.filter(F.col(label).cast("boolean"))
    positives = failed.filter(~F.col(label).cast("boolean"))
    return negatives.unionByName(sample_n(positives, negatives.count() * times, key, seed))


def safety_net_mix(
    labeled: DataFrame, safety_net: DataFrame, cap="0.1", key: str = "uid", seed: int = SEED
) -> DataFrame:
    """Union with the safety net, cut to ``cap`` of the labeled rows if larger."""
    limit = int(exact(cap) * labeled.count())
    if safety_net.count() > limit:
        safety_net = sample_n(safety_net, limit, key, seed)
    return labeled.unionByName(safety_net, allowMissingColumns=True)


def shrink_proportional(parts: dict[str, DataFrame], train_n: int, key: str = "uid", seed: int = SEED):
    """Cut train to ``train_n`` rows and every other part by the same ratio."""
    ratio = Fraction(train_n, parts["train"].count())
    return {
        name: sample_n(df, train_n if name == "train" else int(ratio * df.count()), key, seed)
        for name, df in parts.items()
    }


def _hash_number(text: Column) -> Column:
    """48 hash bits as a number, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def weighted_resample(
    df: DataFrame, by: str, n: int | None = None, key: str = "uid", seed: int = SEED
) -> DataFrame:
    """n draws with replacement, each row weighted by one over its class size.

    Under these weights every class is equally likely, so a draw is a uniform
    class and a uniform place inside it. Draw and row meet in an equi-join on
    (class, place), whose right side is unique.
    """
    spark = df.sparkSession
    work = Workspace(spark, "resample")
    rows = df.filter(F.col(by).isNotNull())
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    classes = work.keep(with_place(sizes, by, work, "_class"))
    n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.sum("_size")).first()
    if not n_classes:
        return rows.select(F.lit(0).cast("long").alias("draw"), *df.columns)
    slot = F.concat_ws("|", F.lit(str(seed)), F.lit("class"), F.col("draw"))
    place = F.concat_ws("|", F.lit(str(seed)), F.lit("place"), F.col("draw"))
    draws = spark.range(1, (n_rows if n is None else n) + 1).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_class", _hash_number(slot) % n_classes).join(classes, "_class")
    draws = draws.select("draw", by, (_hash_number(place) % F.col("_size") + 1).alias("_place"))
    ranked = with_rank(rows, key, seed, by=[by], name="_place")
    return draws.join(ranked, [by, "_place"]).select("draw", *df.columns)
