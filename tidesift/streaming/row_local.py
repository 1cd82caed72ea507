"""Row-local steps on streaming tables.

All inputs are finite files in practice; these steps need no state, so the same
expressions also run on a stream of arriving files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.functions import text as tx
from tidesift.operators import clean


def read_text_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepare(df: DataFrame, text: str = "tweet_text", words: int = 3, style: str = "plain") -> DataFrame:
    """Drop null and short texts, add the normalized text."""
    kept = clean.min_words(clean.drop_nulls(df, [text]), text, words)
    return kept.withColumn("normalized", tx.normalize_text(F.col(text), style))
