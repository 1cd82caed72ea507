"""Metrics, thresholds, class weights and losses of scored tables.

The data is read once and reduced to counts per (label, prediction); every
metric is arithmetic on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.functions import vectors as vx

# Imbalance ratio limits.
STANDARD_UP_TO, WEIGHTS_UP_TO, SAMPLER_BELOW = 1.5, 5.0, 15.0


def softmax_argmax(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add probabilities, predicted class and confidence."""
    with_probs = df.withColumn("probabilities", vx.softmax(F.col(logits)))
    return with_probs.withColumns(
        {
            "predicted": vx.argmax(F.col("probabilities")),
            "confidence": F.array_max("probabilities"),
        }
    )


def ratio(top: Column, bottom: Column) -> Column:
    """Division with zero for an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def _class_counts(df: DataFrame, label: str, predicted: str, by: Sequence[str]) -> DataFrame:
    """Per class: true positives, rows labeled so, rows predicted so."""
    pairs = (
        df.select(*by, F.col(label).cast("int").alias("_y"), F.col(predicted).cast("int").alias("_p"))
        .filter(F.col("_y").isNotNull() & F.col("_p").isNotNull())
        .groupBy(*by, "_y", "_p")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("_y").alias("cls"), hit.alias("tp"), F.col("_n").alias("support"), zero.alias("guessed")),
        F.struct(F.col("_p").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("_n").alias("guessed")),
    )
    return (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
    )


def _with_scores(counts: DataFrame) -> DataFrame:
    scored = counts.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("guessed")),
            "recall": ratio(F.col("tp"), F.col("support")),
        }
    )
    return scored.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def classification_report(
    df: DataFrame, label: str = "informative", predicted: str = "predicted", by: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages; per group if asked."""
    by = list(by)
    classes = _with_scores(_class_counts(df, label, predicted, by))
    s = F.col("support")
    whole = classes.groupBy(*by).agg(
        F.collect_list(
            F.struct(F.col("cls").cast("string").alias("name"), "precision", "recall", "f1", "support")
        ).alias("_rows"),
        F.sum("tp").alias("_tp"),
        F.sum("support").alias("_n"),
        *[F.avg(m).alias(f"_macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * s) / F.sum(s)).alias(f"_weighted_{m}") for m in ("precision", "recall", "f1")],
    )
    nothing = F.lit(None).cast("double")

    def line(name, precision, recall, f1):
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
            F.col("_n").alias("support"),
        )

    extra = F.array(
        line("accuracy", nothing, nothing, F.col("_tp") / F.col("_n")),
        *[
            line(f"{kind} avg", *[F.col(f"_{kind}_{m}") for m in ("precision", "recall", "f1")])
            for kind in ("macro", "weighted")
        ],
    )
    rows = whole.select(*by, F.inline(F.concat("_rows", extra)))
    return rows.select(*by, "name", *[F.round(m, digits).alias(m) for m in ("precision", "recall", "f1")], "support")


def grouped_report(df: DataFrame, by: str, label: str = "informative", predicted: str = "predicted") -> DataFrame:
    return classification_report(df, label, predicted, [by])


def _macro_columns(tp, fp, fn, tn) -> dict[str, Column]:
    """Macro averages of a two-class table over the classes that occur."""
    pos, neg = tp + fp + fn > 0, tn + fp + fn > 0
    seen = pos.cast("int") + neg.cast("int")
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    zero = F.lit(0.0)

    def mean(a, b):
        return ratio(F.when(neg, b).otherwise(zero) + F.when(pos, a).otherwise(zero), seen)

    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "macro_precision": mean(p1, p0),
        "macro_recall": mean(r1, r0),
        "macro_f1": mean(f1_of(p1, r1), f1_of(p0, r0)),
        "precision": p1,
        "recall": r1,
        "f1": f1_of(p1, r1),
    }


def binary_metrics(df: DataFrame, label: str = "informative", predicted: str = "predicted", digits: int = 6) -> DataFrame:
    """One row: accuracy, macro scores and the scores of the positive class."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    counts = df.filter(y.isNotNull() & p.isNotNull()).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    scores = _macro_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counts.select(*[F.round(c, digits).alias(n) for n, c in scores.items()])


def thresholds(low: float = 0.1, high: float = 0.9, steps: int = 81) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    step = (high - low) / (steps - 1)
    return [low + i * step for i in range(steps - 1)] + [high]


def threshold_sweep(
    df: DataFrame, probability: str = "probability", label: str = "informative", digits: int = 6
) -> DataFrame:
    """Macro F1 at every threshold.

    Rows are counted by how many thresholds they reach; the sweep itself runs
    over that table of at most 82 x 2 rows.
    """
    cuts = thresholds()
    p = F.col(probability)
    last = len(cuts) - 1
    nearest = F.greatest(F.lit(0), F.least(F.lit(last), F.round((p - cuts[0]) / (cuts[1] - cuts[0])).cast("int")))
    reached = nearest + (p >= F.element_at(F.lit(cuts), nearest + 1)).cast("int")
    counted = (
        df.select(reached.alias("reached"), F.col(label).cast("int").alias("y"))
        .filter(F.col("reached").isNotNull() & F.col("y").isNotNull())
        .groupBy("reached", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spread = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("k"))
    positive, zero = F.col("k") < F.col("reached"), F.lit(0).cast("long")

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(zero))

    table = spread.groupBy("k").agg(
        total(positive & (F.col("y") == 1)).alias("tp"),
        total(positive & (F.col("y") == 0)).alias("fp"),
        total(~positive & (F.col("y") == 1)).alias("fn"),
        total(~positive & (F.col("y") == 0)).alias("tn"),
    )
    macro = _macro_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))["macro_f1"]
    return table.select(
        F.round(F.element_at(F.lit(cuts), F.col("k") + 1), digits).alias("threshold"),
        F.round(macro, digits).alias("macro_f1"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest macro F1; 0.5 if none is above zero."""
    best = sweep.filter(F.col("macro_f1") > 0).agg(
        F.min_by("threshold", F.struct(-F.col("macro_f1"), F.col("threshold"))).alias("threshold"),
        F.max("macro_f1").alias("macro_f1"),
    )
    return best.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def apply_threshold(df: DataFrame, threshold: float, probability: str = "probability") -> DataFrame:
    return df.withColumn("predicted", (F.col(probability) >= threshold).cast("int"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def imbalance_strategy(df: DataFrame, label: str = "informative") -> DataFrame:
    """One row: imbalance ratio, minority class and the way to treat it."""
    counts = class_counts(df, label)
    measured = counts.agg(
        (F.max("n_rows") / F.min("n_rows")).alias("imbalance_ratio"),
        F.min_by(label, F.struct("n_rows", label)).alias("minority_class"),
    )
    r = F.col("imbalance_ratio")
    strategy = (
        F.when(r <= STANDARD_UP_TO, "standard")
        .when(r <= WEIGHTS_UP_TO, "class_weights")
        .when(r < SAMPLER_BELOW, "sampler")
        .otherwise("focal_loss")
    )
    return measured.select(F.round(r, 6).alias("imbalance_ratio"), "minority_class", strategy.alias("strategy"))


def class_weights(df: DataFrame, label: str = "informative", kind: str = "balanced") -> DataFrame:
    """One weight per class: n/(k*count), or 1/count scaled to sum k."""
    gathered = class_counts(df, label).agg(
        F.collect_list(F.struct(label, "n_rows")).alias("_classes"),
        F.sum("n_rows").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(1 / F.col("n_rows")).alias("_inverse"),
    )
    rows = gathered.select("_n", "_k", "_inverse", F.inline("_classes"))
    if kind == "balanced":
        weight = F.col("_n") / (F.col("_k") * F.col("n_rows"))
    elif kind == "inverse":
        weight = (1 / F.col("n_rows")) / F.col("_inverse") * F.col("_k")
    else:
        raise ValueError("kind must be 'balanced' or 'inverse'")
    return rows.select(label, "n_rows", weight.alias("weight"))


def with_class_weight(df: DataFrame, label: str = "informative", kind: str = "balanced") -> DataFrame:
    """The weight of its class on every row, as a CASE over the few classes."""
    weights = {r[label]: r["weight"] for r in class_weights(df, label, kind).collect()}
    column = F.lit(None).cast("double")
    for value, weight in weights.items():
        column = F.when(F.col(label) == F.lit(value), F.lit(weight)).otherwise(column)
    return df.withColumn("weight", column)


def loss(
    df: DataFrame,
    logits: str = "logits",
    label: str = "informative",
    kind: str = "standard",
    weights: dict[int, float] | None = None,
    gamma: float = 2.0,
    digits: int = 6,
) -> DataFrame:
    """Mean loss of a scored table: cross-entropy, class-weighted, or focal."""
    z = F.col(logits)
    y = F.col(label).cast("int")
    top = F.array_max(z)
    log_sum = F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))) + top
    rows = df.select(z.alias("_z"), y.alias("_y"), (log_sum - F.element_at(z, y + 1)).alias("ce")).filter(
        F.col("ce").isNotNull()
    )
    weight = F.lit(1.0)
    for value, w in (weights or {}).items():
        weight = F.when(F.col("_y") == value, F.lit(float(w))).otherwise(weight)
    ce = F.col("ce")
    if kind == "standard":
        value = F.avg(ce)
    elif kind == "class_weights":
        value = F.sum(weight * ce) / F.sum(weight)
    elif kind == "focal_loss":
        value = F.avg(weight * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce)
    else:
        raise ValueError("kind must be 'standard', 'class_weights' or 'focal_loss'")
    return rows.agg(F.round(value, digits).alias("loss"))


def collapse_check(df: DataFrame, label: str = "informative", predicted: str = "predicted") -> DataFrame:
    """Class shares of labels and predictions; flagged if one class is predicted only."""
    counts = _class_counts(df, label, predicted, [])
    gathered = counts.agg(
        F.collect_list(F.struct("cls", "support", "guessed")).alias("_classes"),
        F.sum("support").alias("_n"),
        F.count_if(F.col("guessed") > 0).alias("_kinds"),
    )
    return gathered.select("_n", "_kinds", F.inline("_classes")).select(
        "cls",
        F.round(F.col("support") / F.col("_n"), 6).alias("label_share"),
        F.round(F.col("guessed") / F.col("_n"), 6).alias("predicted_share"),
        (F.col("_kinds") == 1).alias("collapsed"),
    )
