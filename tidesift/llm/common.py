"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def id_of(column: str = "doc_id") -> Column:
    """The id as a number that is never null (null: the smallest long)."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def as_id(column: Column) -> Column:
    """The inverse of ``id_of``."""
    return F.nullif(column, F.lit(NO_ID))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(crc % folds, F.lit(0)).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def once(column: Column) -> Column:
    """Evaluate an expression once per row.

    A one-element generator is a barrier for the optimizer: without it an
    expensive column would be inlined into every lambda that uses it.
    """
    return F.explode(F.array(column))


def per_process(name: str, build: Callable[[], Any]) -> Any:
    """A read-only lookup built once per Python worker.

    Task functions travel by value, so globals of this package end with their
    task; the worker process and what it keeps here go on to the next one.
    """
    store = sys.modules.setdefault("_tidesift_worker", types.ModuleType("_tidesift_worker"))
    if not hasattr(store, name):
        setattr(store, name, build())
    return getattr(store, name)


def share(spark: SparkSession, value: Any):
    """A broadcast of any value; instances of this package's classes travel with their classes."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared) -> Any:
    """In a task: the value of a broadcast made by ``share``."""
    return pickle.loads(shared.value)


def int64(column) -> np.ndarray:
    """An Arrow integer column without nulls as numpy."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def one_of_each(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One row for each value of the key expressions, with the columns it has."""
    names = []
    for name in keys:
        while name in df.columns or name in names:
            name += "_"
        names.append(name)
    tagged = df.withColumns(dict(zip(names, keys.values(), strict=True)))
    return tagged.dropDuplicates(names).select(*[F.col(f"`{c}`") for c in df.columns])


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
