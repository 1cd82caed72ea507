"""Counts, distributions and column profiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidesift.functions import text as tx
from tidesift.operators.bloom import KeyTable
from tidesift.operators.sampling import SEED, sample_frac
from tidesift.session import Workspace


def group_size(df: DataFrame, keys: Sequence[str], where=None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def value_counts(df: DataFrame, columns: Sequence[str], dropna: bool = True) -> DataFrame:
    """Rows per value, most frequent first; ties in value order."""
    rows = df.dropna(subset=list(columns)) if dropna else df
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), *columns)


def value_counts_within(df: DataFrame, group: str, column: str) -> DataFrame:
    """Value counts inside each group, with the share of the group.

    The window runs over counted values, not over rows.
    """
    counted = df.dropna(subset=[group, column]).groupBy(group, column).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(group))
    return counted.withColumn("share", F.round(F.col("n_rows") / total, 6))


def bag_of_ngrams(df: DataFrame, text: str = "tweet_text", uid: str = "uid") -> DataFrame:
    """(uid, n_distinct, n_grams, most, lowest) of the word tokens and pairs of every uid that has any.

    A uid of one row is counted inside the row; only ids are shuffled. The grams of
    uids with several rows meet by (uid, gram). ``df`` is read three times.
    """
    rows = df.select(F.col(uid).alias("uid"), F.col(text).alias("text"))
    repeated = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("uid")
    parts = KeyTable(rows, repeated, {"uid": F.col("uid")})
    profile = tx.gram_profile(F.col("text"))
    # inline, so that the profile is built once for filter and columns
    single = parts.drop().select("uid", F.inline(F.filter(F.array(profile), lambda p: p["n_grams"] > 0)))
    grams = parts.keep().select("uid", F.explode(tx.one_two_grams(F.col("text"))).alias("gram"))
    counts = grams.groupBy("uid", "gram").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_grams"), F.max("n").alias("most"), F.min("gram").alias("lowest")
    )
    return single.unionByName(several).withColumnRenamed("uid", uid)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def split_distribution(df: DataFrame, keys: Sequence[str], split: str = "split", parts=("train", "validation", "test")):
    """Share of each key combination inside every split, one column per split."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(split) == p).alias(p) for p in parts])
    totals = df.agg(*[F.count_if(F.col(split) == p).alias(p) for p in parts]).first()
    return counts.select(
        *keys,
        *[F.round(F.col(p) / F.lit(float(totals[p])) if totals[p] else F.lit(0.0), 6).alias(p) for p in parts],
    )


def events_per_type(df: DataFrame, group: str = "event_type", value: str = "event_name") -> DataFrame:
    """Distinct events per type; two-level counting keeps a hot type spread out."""
    pairs = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value).distinct()
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n_events")).orderBy(F.desc("n_events"), group)


def count_per_event(df: DataFrame, group: str = "event_type", value: str = "event_name") -> DataFrame:
    """Rows per event with a subtotal per type and a grand total (nulls mark totals)."""
    known = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    return known.rollup(group, value).agg(F.count(F.lit(1)).alias("n_rows"))


def null_audit(df: DataFrame, column: str, by: str) -> DataFrame:
    missing = df.filter(F.col(column).isNull())
    return missing.groupBy(by).agg(F.count(F.lit(1)).alias("n_null")).orderBy(F.desc("n_null"), by)


def order_limit(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """Top n: every task keeps n rows, only those meet."""
    return df.orderBy(*order).limit(n)


def grouped_quantiles(cells: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(grp, q): exact quantiles of v per group for rows (grp, v), interpolated between neighbours.

    Values are counted first. The counts are range-partitioned by (grp, v), and
    totals of the ranges give every value its ranks, so neither a large group
    nor many groups meet in one task. One way for any number of rows.
    """
    work = Workspace(cells.sparkSession, "quantiles")
    counted = cells.select("grp", F.col("v").cast("double").alias("v")).filter("grp IS NOT NULL AND v IS NOT NULL")
    counted = counted.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("grp", "v")
    counted = work.keep(counted.withColumn("part", F.spark_partition_id()))

    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("grp", "part").agg(F.sum("n").alias("size"))
    starts = parts.select(
        "grp",
        "part",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
        F.sum("size").over(Window.partitionBy("grp")).alias("total"),
    )
    inside = Window.partitionBy("grp", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first")
    placed = counted.join(starts, ["grp", "part"]).select("grp", "v", "n", "total", first)

    place = F.col("p") * (F.col("total") - 1)
    low = F.floor(place)
    high = F.least(low + 1, F.col("total") - 1)
    at = placed.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("i", "p"))

    def value(rank: Column) -> Column:
        here = (rank >= F.col("first")) & (rank < F.col("first") + F.col("n"))
        return F.max(F.when(here, F.col("v")))

    ends = at.groupBy("grp", "i").agg(
        value(low).alias("lo"), value(high).alias("hi"), F.max(low + 1 - place).alias("a"), F.max(place - low).alias("b")
    )
    mixed = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * F.col("a") + F.col("hi") * F.col("b"))
    ordered = ends.select("grp", "i", mixed.alias("q")).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q"))
    return ordered.select("grp", F.transform("q", lambda x: x["q"]).alias("q"))


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours."""
    found = grouped_quantiles(df.select(F.lit(0).alias("grp"), F.col(column).alias("v")), probabilities).first()
    return [None for _ in probabilities] if found is None else list(found["q"])


FIVE = ("minimum", "q1", "median", "q3", "maximum")


def _five(cells: DataFrame, name: str) -> DataFrame:
    found = grouped_quantiles(cells, [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.select(F.col("grp").alias(name), *[F.col("q")[i].alias(n) for i, n in enumerate(FIVE)])


def five_numbers(df: DataFrame, column: str, by: str) -> DataFrame:
    """Minimum, quartiles and maximum per class, all classes in one pass."""
    return _five(df.select(F.col(by).alias("grp"), F.col(column).alias("v")), by)


def histogram(df: DataFrame, column: str, by: str, bins: int = 20) -> DataFrame:
    """Rows per equal-width bin of the whole value range and class; the last bin is closed."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if span["lo"] is None:
        return df.groupBy(by, F.lit(0).alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    lo, hi = float(span["lo"]), float(span["hi"])
    width = (hi - lo) or 1.0
    place = F.floor((F.col(column) - lo) / F.lit(width) * bins)
    rows = df.filter(F.col(column).isNotNull())
    return rows.groupBy(by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def token_length_profile(
    df: DataFrame,
    field: str = "tweet_text",
    frac="0.1",
    key: str = "uid",
    seed: int = SEED,
    tokenize: Callable[[Column], Column] = tx.social_tokenize,
) -> DataFrame:
    """p90, p95, p99 and maximum of the token count on an exact-size sample.

    The aggregate holds one entry per distinct length, not per row.
    """
    lengths = sample_frac(df, frac, key, seed).select(F.size(tokenize(F.col(field))).alias("n"))
    return lengths.agg(
        F.percentile("n", 0.90).alias("p90"),
        F.percentile("n", 0.95).alias("p95"),
        F.percentile("n", 0.99).alias("p99"),
        F.max("n").cast("long").alias("longest"),
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, non-null count, distinct values, top value and its
    frequency, and for numbers mean, deviation and quartiles.

    Distinct values are counted by grouping on (column, value) for all columns
    in one shuffle, not by holding a set per column.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
        ).alias("cell")
    ).select("cell.*")
    counted = cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    described = counted.groupBy("column").agg(
        F.sum("n").alias("non_null"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    base = df.sparkSession.range(1).select(F.explode(kinds).alias("column", "dtype"))
    if numeric:
        numbers = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("grp"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("cell")
        ).select("cell.*")
        moments = numbers.groupBy(F.col("grp").alias("column")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
        stats = moments.join(_five(numbers, "column"), "column", "left")
    else:
        none = [F.lit(None).cast("double").alias(n) for n in ("mean", "std", *FIVE)]
        stats = base.limit(0).select("column", *none)
    names = ["mean", "std", *FIVE]
    base = base.join(stats, "column", "left")
    joined = base.join(described, "column", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "column",
        "dtype",
        F.coalesce("non_null", zero).alias("non_null"),
        F.coalesce("n_unique", zero).alias("n_unique"),
        "top",
        "freq",
        *[F.round(n, 6).alias(n) for n in names],
    )


