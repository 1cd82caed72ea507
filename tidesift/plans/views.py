"""Stand-in views: how the given tables play the roles of the curation tables.

Every view exists twice, as a DataFrame and as the SQL text that builds the
same rows for the side-by-side check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.operators.blocks import spread
from tidesift.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, tweet_text) of all documents, on all cores even if they are one small file."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(F.col("doc_id").alias("uid"), F.col("text").alias("tweet_text")), "uid")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files a query writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled texts with subset, event and a made-up score per row."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    number = F.substring("source", 4, 10).cast("int")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("uid"),
        F.col("text").alias("tweet_text"),
        F.coalesce(F.col("quality") == 1, F.col("n_chars") % 3 == 0).alias("informative"),
        F.col("toxic").cast("string").alias("humanitarian_label"),
        F.col("source").alias("event_name"),
        F.col("lang").alias("event_type"),
        F.when(number < 10, "disaster").when(number < 15, "weather").otherwise("out_topic").alias("subset"),
        "quality",
        "toxic",
        "n_chars",
        ((F.col("n_chars") % 101) / 100).alias("probability"),
        (((F.col("n_chars") * 7) % 101) / 100).alias("probability_2"),
    )


CORPUS_SQL = """
corpus AS (
  SELECT d.doc_id AS uid, d.text AS tweet_text,
         coalesce(l.quality = 1, d.n_chars % 3 = 0) AS informative,
         CAST(l.toxic AS VARCHAR) AS humanitarian_label,
         d.source AS event_name, d.lang AS event_type,
         CASE WHEN CAST(substr(d.source, 4) AS INTEGER) < 10 THEN 'disaster'
              WHEN CAST(substr(d.source, 4) AS INTEGER) < 15 THEN 'weather' ELSE 'out_topic' END AS subset,
         l.quality, l.toxic, d.n_chars,
         CAST(d.n_chars % 101 AS DOUBLE) / 100 AS probability,
         CAST((d.n_chars * 7) % 101 AS DOUBLE) / 100 AS probability_2
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumns(
        {
            "predicted": (F.col("probability") >= 0.5).cast("int"),
            "confidence": F.greatest(F.col("probability"), 1 - F.col("probability")),
            "logits": F.array((F.col("n_chars") % 7) / 3, (F.col("n_chars") % 11) / 5),
        }
    )


SCORED_SQL = (
    CORPUS_SQL
    + """,
scored AS (
  SELECT *, CAST(probability >= 0.5 AS INTEGER) AS predicted,
         greatest(probability, 1 - probability) AS confidence,
         CAST(n_chars % 7 AS DOUBLE) / 3 AS z0, CAST(n_chars % 11 AS DOUBLE) / 5 AS z1
  FROM corpus
)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "uid")
