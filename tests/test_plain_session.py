"""Vector queries in a session that does not turn data frames into Arrow, against their SQL."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry

NAMES = [
    "G7_radius_pairs",
    "G8_knn_pairs",
    "G10_near_dedup_radius",
    "G10_near_dedup_knearest",
    "G11_threshold_sweep_survivors",
    "A8_resumable_dedup_radius",
]


@pytest.mark.parametrize("name", NAMES)
def test_vector_query_without_arrow(spark, sf_dir, name):
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")
    try:
        difference = oracle.compare(entry.queries()[name](spark, sf_dir), oracle.connect(sf_dir), entry.oracle_sql()[name])
    finally:
        spark.conf.set(arrow, before)
    assert difference is None, difference
