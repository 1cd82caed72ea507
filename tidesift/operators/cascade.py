"""Model scoring and the two-stage cascade.

A model is a factory: ``make()`` is called once per task and returns a function
from a pandas batch to (predictions, confidences).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.functions import text as tx
from tidesift.operators.evaluate import binary_metrics
from tidesift.operators.labels import relabel_safety_net

BatchModel = Callable[[pd.DataFrame], tuple[Sequence, Sequence]]


def _extended(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, t) for n, t in fields])


def score(df: DataFrame, make: Callable[[], BatchModel], prefix: str = "", batch: int = 2048) -> DataFrame:
    """Append ``predicted`` and ``confidence``; the model is loaded once per task."""
    p, c = f"{prefix}predicted", f"{prefix}confidence"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                predictions, confidences = model(part)
                yield part.assign(**{p: predictions, c: confidences})

    return df.mapInPandas(run, _extended(df.schema, (p, T.IntegerType()), (c, T.DoubleType())))


def cascade(
    df: DataFrame, stage_1: Callable[[], BatchModel], stage_2: Callable[[], BatchModel], batch: int = 2048
) -> DataFrame:
    """Both stages in one pass: stage 2 sees only the rows stage 1 calls positive.

    One scan and no join; the final prediction is stage 2's where it ran.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = stage_1(), stage_2()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].reset_index(drop=True)
                p1, c1 = (pd.Series(x) for x in first(part))
                p2 = pd.Series(pd.NA, index=part.index, dtype="Int32")
                c2 = pd.Series(float("nan"), index=part.index, dtype="float64")
                positive = p1 == 1
                if positive.any():
                    predictions, confidences = second(part[positive].reset_index(drop=True))
                    p2[positive] = pd.array(list(predictions), dtype="Int32")
                    c2[positive] = list(confidences)
                yield part.assign(
                    stage_1_predicted=p1.astype("int32"),
                    stage_1_confidence=c1.astype("float64"),
                    stage_2_predicted=p2,
                    stage_2_confidence=c2.astype("Float64").where(positive, pd.NA),
                    final_prediction=p2.fillna(p1.astype("Int32")).astype("int32"),
                )

    fields = [
        ("stage_1_predicted", T.IntegerType()),
        ("stage_1_confidence", T.DoubleType()),
        ("stage_2_predicted", T.IntegerType()),
        ("stage_2_confidence", T.DoubleType()),
        ("final_prediction", T.IntegerType()),
    ]
    return df.mapInPandas(run, _extended(df.schema, *fields))


def merge_stages(stage_1: DataFrame, stage_2: DataFrame, key: str = "uid") -> DataFrame:
    """Final prediction from two stored score tables: stage 2 where present, else stage 1."""
    joined = stage_1.join(stage_2.select(key, "stage_2_predicted", "stage_2_confidence"), key, "left")
    return joined.withColumn("final_prediction", F.coalesce("stage_2_predicted", "stage_1_predicted"))


def safety_net(df: DataFrame, stage_1: Callable[[], BatchModel], stage_2: Callable[[], BatchModel]) -> DataFrame:
    """Non-informative rows both stages call positive, labeled not_humanitarian."""
    scored = cascade(df.filter(~F.col("informative")), stage_1, stage_2)
    fooled = relabel_safety_net(scored.filter(F.col("stage_1_predicted") == 1), predicted="final_prediction")
    return fooled.select(*df.columns) if "humanitarian_label" in df.columns else fooled.select(*df.columns, "humanitarian_label")


def _features(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_grams", tx.one_two_grams(F.col(text)))


def fit_binary(
    train: DataFrame,
    validation: DataFrame,
    candidates: Sequence[dict[str, Any]] = ({"regParam": 0.1}, {"regParam": 0.01}, {"regParam": 0.001}),
    text: str = "tweet_text",
    label: str = "informative",
    weight: str | None = None,
    num_features: int = 1 << 18,
    patience: int = 3,
) -> tuple[PipelineModel, list[dict]]:
    """Distributed linear model on hashed 1-2-grams.

    Candidates are tried in order; one with a strictly better validation macro
    recall is kept, and the search stops after ``patience`` candidates without.
    Returns the best model and the metric history.
    """
    numbered = F.col(label).cast("double")
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=num_features)
    # hashed once for all passes and candidates; counts of grams are smaller than the grams
    weights = [weight] if weight else []
    train = hashing.transform(_features(train.withColumn("_label", numbered).filter(F.col("_label").isNotNull()), text))
    train = train.select("_label", "_features", *weights).cache()
    validation = hashing.transform(_features(validation, text)).select(label, "_features").cache()
    best, best_recall, misses, history = None, 0.0, 0, []
    try:
        for params in candidates:
            settings = dict(params)
            if weight:
                settings["weightCol"] = weight
            classifier = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=20, **settings)
            model = classifier.fit(train)
            scored = model.transform(validation).withColumn("predicted", F.col("prediction").cast("int"))
            metrics = binary_metrics(scored, label).first().asDict()
            history.append({**params, **metrics})
            if metrics["macro_recall"] > best_recall:
                best, best_recall, misses = PipelineModel(stages=[hashing, model]), metrics["macro_recall"], 0
            else:
                misses += 1
                if misses >= patience:
                    break
    finally:
        train.unpersist()
        validation.unpersist()
    return best, history


def predict_binary(model: PipelineModel, df: DataFrame, text: str = "tweet_text") -> DataFrame:
    """Append ``predicted`` and ``confidence``, all in the JVM."""
    scored = model.transform(_features(df, text))
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("predicted"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
