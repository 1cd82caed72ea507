from __future__ import annotations

import math

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.operators import cascade, evaluate, profile, rank, sampling, splits
from tidesift.operators.clean import assign_uid
from tidesift.streaming.row_local import prepare, read_text_stream


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1000).select(
        F.col("id").alias("uid"),
        (F.col("id") % 7 == 0).alias("informative"),
        (F.col("id") % 90).alias("many"),
        F.when(F.col("id") % 10 < 5, "disaster").when(F.col("id") % 10 < 7, "weather").otherwise("out_topic").alias("subset"),
    )


def ids(df):
    return sorted(r["uid"] for r in df.select("uid").collect())


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_same_result_for_any_partitioning(spark, table, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        spread = table.repartition(partitions)
        drawn = ids(sampling.sample_n(spread, 123))
        parts = sorted(tuple(r) for r in splits.stratified_split(spread, "informative").select("uid", "split").collect())
        numbered = sorted(tuple(r) for r in rank.with_rank(spread, "uid", 1).select("uid", "rank").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert drawn == ids(sampling.sample_n(table, 123)) and len(drawn) == 123
    assert parts == sorted(tuple(r) for r in splits.stratified_split(table, "informative").select("uid", "split").collect())
    assert [r for _, r in sorted(numbered, key=lambda x: x[1])] == list(range(1, 1001))


def test_draw_is_a_filter(table):
    drawn, rest = sampling.draw_n(table, 200)
    assert len(ids(drawn)) == 200 and sorted(ids(drawn) + ids(rest)) == list(range(1000))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_sizes_and_errors(table):
    assert sampling.sample_frac(table, "0.0125").count() == 12  # 12.5 rounds to even
    assert sampling.sample_n(table, 0).count() == 0
    assert sampling.sample_n(table, 1000).count() == 1000
    for bad in (1001, -1):
        with pytest.raises(ValueError):
            sampling.sample_n(table, bad)


@pytest.mark.parametrize("classes", [3, 500])
def test_stratified_with_a_null_class(table, classes):
    by = F.when(F.col("uid") % 7 > 0, F.concat(F.lit("c"), F.col("uid") % classes))
    rows = table.select("uid", by.alias("by"))
    counts = {r["by"]: r["count"] for r in rows.groupBy("by").count().collect()}
    order = dict(sorted(counts.items(), key=lambda item: (item[0] is None, item[0] or "")))
    n_held = math.ceil(0.2 * 1000)
    got = {}
    for r in splits.stratified_split(rows, "by").groupBy("by", "split").count().collect():
        got.setdefault(r["by"], {})[r["split"]] = r["count"]

    def share(sizes, n):
        total = sum(sizes.values())
        out = {c: sizes[c] * n // total for c in sizes}
        for c in sorted(sizes, key=lambda c: (-(sizes[c] * n % total), c is None, c or ""))[: n - sum(out.values())]:
            out[c] += 1
        return out

    train = share(order, 1000 - n_held)
    left = {c: order[c] - train[c] for c in order}
    val = share(left, n_held - 100)
    want = {c: {"train": train[c], "validation": val[c], "test": left[c] - val[c]} for c in order}
    assert got == {c: {k: n for k, n in parts.items() if n} for c, parts in want.items()}


def test_balance_and_resample_many_classes(table):
    rows = table.select("uid", F.when(F.col("uid") < 990, F.col("uid") % 90).alias("by"))
    balanced = sampling.balance_classes(rows, "by").groupBy("by").count().collect()
    assert len(balanced) == 91 and {r["count"] for r in balanced} == {10}
    with pytest.raises(ValueError):
        sampling.balance_classes(rows, "by", 11)
    draws = sampling.weighted_resample(rows, "by")
    assert draws.count() == 990 and draws.filter("by is null").count() == 0
    assert sampling.weighted_resample(rows.limit(0), "by").count() == 0


def test_allocation():
    assert splits.allocate({"a": 5, "b": 3, "c": 2}, 5) == {"a": 3, "b": 1, "c": 1}
    plan = splits.plan_parts({True: 143, False: 857}, "0.15", "0.15")
    assert [sum(p[i] for p in plan.values()) for i in range(3)] == [700, 150, 150]


def test_quota_and_strategies(table):
    labeled = table.withColumn("humanitarian_label", F.when(F.col("uid") % 3 == 0, "x"))
    pools = splits.Pools.of(labeled)
    true = pools.disaster.filter("informative").count()
    false = pools.disaster.count() - true
    assert sampling.noise_quota(pools.disaster, pools.weather, 10) == math.ceil(true * 10) - false - pools.weather.count()
    assert sampling.noise_quota(pools.disaster, pools.weather, 10, "simple") == true * 10
    drawn, left = splits.split_fraction(pools, "0.1", 10)
    assert sorted(ids(drawn) + ids(left.union())) == list(range(1000))
    one, two = splits.isolated_strategy(pools, times=10)
    assert sorted(ids(one) + ids(two)) == list(range(1000))
    assert one.filter("subset = 'disaster' and humanitarian_label is not null").count() == 0


def test_resample_shares(table):
    draws = sampling.weighted_resample(table, "informative", 4000)
    counts = {r["informative"]: r["count"] for r in draws.groupBy("informative").count().collect()}
    assert sum(counts.values()) == 4000 and abs(counts[True] - 2000) < 200


def test_uid_offset(table):
    assert sorted(r["uid"] for r in assign_uid(table.withColumnRenamed("uid", "k"), "k", 50).collect()) == list(range(51, 1051))


@pytest.mark.parametrize(
    "counts, strategy",
    [((3, 2), "standard"), ((10, 2), "class_weights"), ((11, 2), "sampler"), ((30, 2), "focal_loss"), ((29, 2), "sampler")],
)
def test_imbalance_limits(spark, counts, strategy):
    df = spark.range(sum(counts)).select((F.col("id") < counts[0]).alias("informative"))
    assert evaluate.imbalance_strategy(df).first()["strategy"] == strategy


def test_threshold_ties_take_the_first(spark):
    df = spark.createDataFrame([(0.05, False), (0.95, True)], "probability double, informative boolean")
    best = evaluate.best_threshold(evaluate.threshold_sweep(df)).first()
    assert (best["threshold"], best["macro_f1"]) == (0.1, 1.0)


def test_report_zero_division(spark):
    df = spark.createDataFrame([(True, 0), (False, 0)], "informative boolean, predicted int")
    report = {r["name"]: r for r in evaluate.classification_report(df).collect()}
    assert report["1"]["precision"] == 0 and report["1"]["f1"] == 0 and report["accuracy"]["f1"] == 0.5
    assert evaluate.collapse_check(df).filter("collapsed").count() == 2


def test_cascade_falls_back_to_stage_1(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "uid long, x int")

    def first():
        return lambda batch: (batch["x"], pd.Series(0.9, index=batch.index))

    def second():
        def predict(batch):
            assert (batch["x"] == 1).all()
            return pd.Series(0, index=batch.index), pd.Series(0.6, index=batch.index)

        return predict

    got = {r["uid"]: tuple(r)[2:] for r in cascade.cascade(df, first, second).collect()}
    assert got == {1: (1, 0.9, 0, 0.6, 0), 2: (0, 0.9, None, None, 0)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 500)] + [("b", float(x)) for x in rng.normal(size=301)]
    rows += [("c", 4.0), ("d", None), (None, 1.0)]
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(5)
    got = {r["grp"]: list(r["q"]) for r in profile.grouped_quantiles(df, probabilities).collect()}
    assert set(got) == {"a", "b", "c"}
    for name in got:
        values = [v for g, v in rows if g == name]
        assert got[name] == pytest.approx(np.quantile(values, probabilities).tolist())
    assert profile.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_stream_of_files(spark, tmp_path):
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("tweet_text", T.StringType())])
    rows = [(1, "see www.x.com right now"), (2, "too short"), (3, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = prepare(read_text_stream(spark, str(tmp_path / "in"), schema))
    query = stream.writeStream.format("memory").queryName("prepared").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("prepared").select("uid", "normalized").collect()] == [
        (1, "see HTTPURL right now")
    ]
