"""Joins and set operations on keys. All joins are equi-joins; sides are never
hinted, so the optimizer broadcasts by measured size and AQE splits hot keys.
Rows are dropped or kept by key tables without moving the rows that miss them
(``bloom``); a null key matches no other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.operators.bloom import SMALL_BYTES, drop_rows, keep_rows


def union_by_name(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _known(ids: DataFrame, key: str) -> DataFrame:
    return ids.filter(F.col(key).isNotNull()).select(key)


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "uid") -> DataFrame:
    return keep_rows(df, _known(ids, key), {key: F.col(key)}, small=SMALL_BYTES)


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "uid") -> DataFrame:
    return drop_rows(df, _known(ids, key), {key: F.col(key)}, small=SMALL_BYTES)


def merge_left(df: DataFrame, other: DataFrame, value: str, fallback: str, out: str, key: str = "uid") -> DataFrame:
    """Left join on the key; ``out`` is the joined value or, where absent, the fallback."""
    joined = df.join(other.select(key, value), key, "left")
    return joined.withColumn(out, F.coalesce(F.col(value), F.col(fallback)))


def attach_labels(df: DataFrame, other: DataFrame, label: str, key: str = "tweet_id", order: str | None = None) -> DataFrame:
    """Another task's label by key. The right side is reduced to one label per key
    first (the first by ``order``), so rows are not multiplied."""
    pick = F.min_by(label, order) if order else F.min(label)
    return df.join(other.groupBy(key).agg(pick.alias(label)), key, "left")


def key_difference(a: DataFrame, b: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    return drop_rows(a, _known(b, key), {key: F.col(key)}, small=SMALL_BYTES)


def append_missing(base: DataFrame, other: DataFrame, key: str = "tweet_id") -> DataFrame:
    """``base`` plus the rows of ``other`` it lacks."""
    return base.unionByName(key_difference(other, base, key), allowMissingColumns=True)


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row about the two key sets: sizes, intersection, subset, superset, equal."""
    sides = (
        a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(key)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    counts = sides.agg(
        F.count_if(F.col("_a") == 1).alias("n_a"),
        F.count_if(F.col("_b") == 1).alias("n_b"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_both"),
    )
    return counts.select(
        "*",
        (F.col("n_both") == F.col("n_a")).alias("is_subset"),
        (F.col("n_both") == F.col("n_b")).alias("is_superset"),
        ((F.col("n_both") == F.col("n_a")) & (F.col("n_both") == F.col("n_b"))).alias("is_equal"),
    )


def split_value_overlap(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Values found in more than one split, with the splits they are in."""
    return (
        df.groupBy(value)
        .agg(F.array_sort(F.collect_set(split)).alias("splits"))
        .filter(F.size("splits") > 1)
        .select(value, F.array_join("splits", ",").alias("splits"))
    )
