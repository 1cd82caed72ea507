"""A training corpus from ``documents``: toxicity, quality rules, exact and near copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; the last one packs what is left into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidesift.llm.common import documents
from tidesift.llm.exact_dedup import drop_copies
from tidesift.llm.packing import pack
from tidesift.llm.quality_rules import keep_good
from tidesift.llm.simhash import drop_near_copies
from tidesift.llm.toxicity import fit_toxicity
from tidesift.plans.registry import query
from tidesift.session import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep_clean(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash of three-word shingles, two or fewer differing bits) the document with the least id."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with sequence and offset."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

# models, fingerprints and tokens are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    space = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    *stages, (_, last) = STAGES
    for _, stage in stages:
        docs = space.keep(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
