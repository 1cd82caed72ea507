"""Stored tables: experiment sets, projected exports, embeddings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.schema import EMBEDDING

EXPERIMENT_KEYS = ["strategy", "n_weather", "n_out_topic", "fraction", "split"]


def write_experiment(
    df: DataFrame, root: str, strategy: str, n_weather: int, n_out_topic: int, fraction: str = "1.0"
) -> None:
    """Store the parts of one experiment (column ``split``); only its own partitions are replaced."""
    keyed = df.withColumns(
        {
            "strategy": F.lit(strategy),
            "n_weather": F.lit(n_weather),
            "n_out_topic": F.lit(n_out_topic),
            "fraction": F.lit(str(fraction)),
        }
    )
    (
        keyed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*EXPERIMENT_KEYS)
        .parquet(root)
    )


def read_experiment(
    spark: SparkSession,
    root: str,
    strategy: str,
    n_weather: int,
    n_out_topic: int,
    split: str | None = None,
    fraction: str = "1.0",
) -> DataFrame:
    """One experiment, or one of its parts; the filters prune partitions."""
    df = spark.read.option("mergeSchema", False).parquet(root)
    wanted = {"strategy": strategy, "n_weather": n_weather, "n_out_topic": n_out_topic}
    for name, value in wanted.items():
        df = df.filter(F.col(name) == value)
    df = df.filter(F.col("fraction").cast("string") == str(fraction))
    if split:
        df = df.filter(F.col("split") == split)
    return df


def export_views(
    df: DataFrame, views: Mapping[str, tuple[Sequence[str], Column | None]], mode: str = "errorifexists"
) -> None:
    """Several projections of one table, computed once: {path: (columns, filter)}."""
    parent = df.persist()
    try:
        for path, (columns, where) in views.items():
            rows = parent if where is None else parent.filter(where)
            rows.select(*columns).write.mode(mode).parquet(path)
    finally:
        parent.unpersist()


def write_embeddings(df: DataFrame, path: str, model_name: str, mode: str = "errorifexists") -> None:
    df.select("uid", F.col("embedding").cast("array<float>"), F.lit(model_name).alias("model_name")).write.mode(
        mode
    ).parquet(path)


def read_embeddings(spark: SparkSession, path: str, model_name: str | None = None) -> DataFrame:
    df = spark.read.schema(EMBEDDING).parquet(path)
    return df if model_name is None else df.filter(F.col("model_name") == model_name)
