"""Dropping and keeping rows by key tables: exact, and without moving the rows that miss."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidesift.operators import bloom
from tidesift.operators.bloom import KeyTable, bloom_table, drop_rows, keep_rows


@pytest.fixture(scope="module")
def rows(spark):
    wide = spark.range(20_000).select(
        F.when(F.col("id") % 97 != 0, F.col("id")).alias("uid"),
        F.concat(F.lit("k"), F.col("id") % 5000).alias("name"),
        F.lit("t").alias("row"),
        F.col("id").cast("string").alias("_key0"),
        F.lit(1).alias("_bloom_row"),
    )
    return wide.repartition(5)


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("every", [3, 50, 10**6])
def test_equal_to_plain_joins(spark, rows, few, every):
    keys = rows.filter((F.col("uid") % every == 0) | F.col("uid").isNull()).select(F.col("uid").cast("int").alias("gone"), F.lit(None).cast("int").alias("x"))
    keys = keys.unionByName(keys)
    on = {"gone": F.col("uid")}
    table = [r["gone"] for r in keys.distinct().collect()]
    left = drop_rows(rows, keys, on, few)
    kept = keep_rows(rows, keys, on, few)
    assert left.columns == kept.columns == rows.columns
    all_rows = rows.collect()
    want = sorted((tuple(r) for r in all_rows if r["uid"] not in table), key=repr)
    assert sorted(map(tuple, left.collect()), key=repr) == want
    assert kept.count() == len(all_rows) - len(want)


@pytest.mark.parametrize("few", [0, 10**9])
def test_keys_of_several_columns(rows, few):
    keys = rows.filter("uid % 7 = 0").select(F.col("name").alias("n"), (F.col("uid") % 11).alias("r"))
    on = {"r": F.col("uid") % 11, "n": F.col("name")}
    table = {(r["r"], r["n"]) for r in keys.collect()}
    want = sorted(r["_key0"] for r in rows.collect() if (r["uid"] % 11 if r["uid"] is not None else None, r["name"]) not in table)
    assert sorted(r["_key0"] for r in drop_rows(rows, keys, on, few).collect()) == want


def test_nothing_to_drop(rows):
    none = rows.select("uid").limit(0)
    assert drop_rows(rows, none, {"uid": F.col("uid")}, -1).count() == 20_000
    assert keep_rows(rows, none, {"uid": F.col("uid")}, -1).count() == 0
    assert drop_rows(rows.limit(0), rows.select("uid"), {"uid": F.col("uid")}, 0).count() == 0


def test_only_hits_are_shuffled(spark, rows):
    keys = rows.filter("uid % 50 = 0").select("uid")
    split = KeyTable(rows, keys, {"uid": F.col("uid")}, 0)
    hits = split._tested(True).count()
    assert keys.count() <= hits < keys.count() + 0.08 * 20_000
    stay = split._tested(False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in stay and "hashpartitioning" not in stay and "SortMergeJoin" not in stay


def test_size_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_WORDS", 256)
    keys = spark.range(5_000).select("id")
    table, n = bloom_table(keys, 5_000)
    assert n == 4 and table.count() == 4
    assert all(len(r["words"]) == 64 for r in table.collect())
    rows = spark.range(10_000).select("id", F.lit("x").alias("t"))
    assert drop_rows(rows, keys, {"id": F.col("id")}, 0).agg(F.min("id"), F.count("id")).first()[:] == (5_000, 5_000)


def test_small_rows_take_the_plain_join(rows):
    keys = rows.filter("uid % 3 = 0").select("uid")
    split = KeyTable(rows, keys.unionByName(keys), {"uid": F.col("uid")}, 0, small=1 << 40)
    assert split.filter is None
    left = rows.filter("uid IS NULL OR uid % 3 <> 0").count()
    assert split.drop().count() == left and split.keep().count() == 20_000 - left


def test_dedup_of_rows_too_large_to_move(rows, monkeypatch):
    from tidesift.operators import dedup

    monkeypatch.setattr(dedup, "SMALL_BYTES", 0)
    for keep, want in (("first", range(5_000)), ("last", range(15_000, 20_000))):
        ids = dedup.dedup(rows.withColumn("n", F.col("_key0").cast("int")), ["name", "row"], "n", keep)
        assert sorted(r["n"] for r in ids.collect()) == list(want)
    tied = dedup.dedup(rows, ["name"], "row")  # equal order values: one row of each key
    assert tied.count() == tied.select("name").distinct().count() == 5_000
    assert dedup.dedup(rows, ["name"], "uid", "none").count() == 0
