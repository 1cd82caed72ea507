"""Queries for profiles, scoring, the cascade and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidesift.operators import cascade, evaluate, profile, sampling, splits
from tidesift.plans.registry import query, split_sql
from tidesift.plans.views import CORPUS_SQL, SCORED_SQL, corpus, scored, table

WITH_CORPUS = f"WITH {CORPUS_SQL}"
WITH_SCORED = f"WITH {SCORED_SQL}"


@query(
    "I1_group_size",
    """SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL""",
)
def _(spark, sf):
    return profile.group_size(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity") >= 10)


@query("I2_value_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY ALL")
def _(spark, sf):
    return profile.value_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    "I2_value_counts_within",
    """WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL)
       SELECT *, round(n_rows / sum(n_rows) OVER (PARTITION BY l_returnflag), 6) AS share FROM c""",
)
def _(spark, sf):
    return profile.value_counts_within(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber")


@query("I2_distinct_values", "SELECT DISTINCT source FROM documents")
def _(spark, sf):
    return profile.distinct_values(table(spark, sf, "documents"), "source")


@query(
    "I3_split_distribution",
    f"""{WITH_CORPUS}, {split_sql('corpus', 'informative', '0.1', '0.1', 'a')},
    t AS (SELECT count_if(split = 'train') AS t, count_if(split = 'validation') AS v, count_if(split = 'test') AS s FROM a)
    SELECT informative, subset, round(count_if(split = 'train') / any_value(t), 6) AS train,
      round(count_if(split = 'validation') / any_value(v), 6) AS validation, round(count_if(split = 'test') / any_value(s), 6) AS test
    FROM a, t GROUP BY informative, subset""",
)
def _(spark, sf):
    parts = splits.stratified_split(corpus(spark, sf), "informative")
    return profile.split_distribution(parts, ["informative", "subset"])


@query(
    "I4_events_per_type",
    f"{WITH_CORPUS} SELECT event_type, count(DISTINCT event_name) AS n_events FROM corpus GROUP BY event_type",
)
def _(spark, sf):
    return profile.events_per_type(corpus(spark, sf))


@query(
    "I5_count_per_event",
    f"{WITH_CORPUS} SELECT event_type, event_name, count(*) AS n_rows FROM corpus GROUP BY ROLLUP (event_type, event_name)",
)
def _(spark, sf):
    return profile.count_per_event(corpus(spark, sf))


def _profile_sql(column: str, dtype: str, numeric: bool) -> str:
    stats = (
        f"""round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std, CAST(min({column}) AS DOUBLE) AS minimum,
        CAST(quantile_cont({column}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({column}, 0.5) AS DOUBLE) AS median,
        CAST(quantile_cont({column}, 0.75) AS DOUBLE) AS q3, CAST(max({column}) AS DOUBLE) AS maximum"""
        if numeric
        else "NULL AS mean, NULL AS std, NULL AS minimum, NULL AS q1, NULL AS median, NULL AS q3, NULL AS maximum"
    )
    top = f"""(SELECT [v, CAST(n AS VARCHAR)] FROM (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM lineitem
      WHERE {column} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"""
    return f"""SELECT '{column}' AS "column", '{dtype}' AS dtype, count({column}) AS non_null,
      count(DISTINCT {column}) AS n_unique, {top}[1] AS top, CAST({top}[2] AS BIGINT) AS freq, {stats} FROM lineitem"""


@query(
    "I6_profile",
    " UNION ALL ".join(
        [
            _profile_sql("l_linenumber", "int", True),
            _profile_sql("l_quantity", "double", True),
            _profile_sql("l_returnflag", "string", False),
        ]
    ),
)
def _(spark, sf):
    return profile.profile(table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_returnflag"))


@query(
    "I7_null_audit",
    f"{WITH_CORPUS} SELECT event_name, count(*) AS n_null FROM corpus WHERE humanitarian_label IS NULL GROUP BY event_name",
)
def _(spark, sf):
    return profile.null_audit(corpus(spark, sf), "humanitarian_label", "event_name")


FAILED_SQL = f"{WITH_SCORED}, failed AS (SELECT * FROM scored WHERE CAST(informative AS INTEGER) <> predicted)"


@query(
    "I8_confidence_histogram",
    f"""{FAILED_SQL}, s AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM failed)
    SELECT informative, CAST(least(floor((confidence - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n_rows
    FROM failed, s GROUP BY ALL""",
)
def _(spark, sf):
    return profile.histogram(sampling.failed_predictions(scored(spark, sf)), "confidence", "informative")


@query(
    "I8_confidence_box",
    f"""{FAILED_SQL} SELECT informative, min(confidence) AS minimum, quantile_cont(confidence, 0.25) AS q1,
    quantile_cont(confidence, 0.5) AS median, quantile_cont(confidence, 0.75) AS q3, max(confidence) AS maximum
    FROM failed GROUP BY informative""",
)
def _(spark, sf):
    return profile.five_numbers(sampling.failed_predictions(scored(spark, sf)), "confidence", "informative")


@query(
    "I9_order_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return profile.order_limit(rows, [F.desc("o_totalprice"), "o_orderkey"], 25)


@query(
    "I10_split_sizes",
    f"""{WITH_CORPUS}, {split_sql('corpus', 'informative', '0.1', '0.1', 'a')}
    SELECT split, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM a GROUP BY split""",
)
def _(spark, sf):
    return splits.split_sizes(splits.stratified_split(corpus(spark, sf), "informative"))


def _length_model():
    """Stand-in model: decides by text length, in pandas batches."""

    def predict(batch):
        n = batch["n_chars"]
        return (n % 2).astype("int32"), 0.5 + (n % 50) / 100

    return predict


def _tail_model():
    def predict(batch):
        n = batch["n_chars"]
        return (n % 3 == 0).astype("int32"), 0.5 + (n % 40) / 100

    return predict


@query(
    "J1_score",
    f"{WITH_CORPUS} SELECT uid, CAST(n_chars % 2 AS INTEGER) AS predicted, round(0.5 + n_chars % 50 / 100, 6) AS confidence FROM corpus",
)
def _(spark, sf):
    rows = cascade.score(corpus(spark, sf).select("uid", "n_chars"), _length_model)
    return rows.select("uid", "predicted", F.round("confidence", 6).alias("confidence"))


@query(
    "J2_softmax_argmax",
    f"""{WITH_SCORED}, e AS (SELECT uid, exp(z0 - greatest(z0, z1)) AS a, exp(z1 - greatest(z0, z1)) AS b FROM scored)
    SELECT uid, CAST(CASE WHEN b > a THEN 1 ELSE 0 END AS INTEGER) AS predicted, round(greatest(a, b) / (a + b), 6) AS confidence FROM e""",
)
def _(spark, sf):
    rows = evaluate.softmax_argmax(scored(spark, sf).select("uid", "logits"))
    return rows.select("uid", "predicted", F.round("confidence", 6).alias("confidence"))


@query(
    "J3_cascade",
    f"""{WITH_CORPUS} SELECT uid, CAST(n_chars % 2 AS INTEGER) AS stage_1_predicted,
    CAST(CASE WHEN n_chars % 2 = 1 THEN CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END END AS INTEGER) AS stage_2_predicted,
    CAST(CASE WHEN n_chars % 2 = 1 AND n_chars % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS final_prediction FROM corpus""",
)
def _(spark, sf):
    rows = cascade.cascade(corpus(spark, sf).select("uid", "n_chars"), _length_model, _tail_model)
    return rows.select("uid", "stage_1_predicted", "stage_2_predicted", "final_prediction")


@query(
    "J3_merge_stages",
    f"""{WITH_CORPUS} SELECT uid, CAST(probability >= 0.5 AS INTEGER) AS stage_1_predicted,
    CASE WHEN probability >= 0.5 THEN CAST(probability_2 >= 0.5 AS INTEGER) END AS stage_2_predicted,
    CASE WHEN probability >= 0.5 THEN CAST(probability_2 >= 0.5 AS INTEGER) ELSE 0 END AS final_prediction FROM corpus""",
)
def _(spark, sf):
    rows = corpus(spark, sf)
    one = rows.select("uid", (F.col("probability") >= 0.5).cast("int").alias("stage_1_predicted"))
    two = rows.filter(F.col("probability") >= 0.5).select(
        "uid",
        (F.col("probability_2") >= 0.5).cast("int").alias("stage_2_predicted"),
        F.col("probability_2").alias("stage_2_confidence"),
    )
    return cascade.merge_stages(one, two).select("uid", "stage_1_predicted", "stage_2_predicted", "final_prediction")


@query(
    "J4_safety_net",
    f"""{WITH_CORPUS} SELECT uid, 'not_humanitarian' AS humanitarian_label FROM corpus
    WHERE NOT informative AND n_chars % 2 = 1 AND n_chars % 3 = 0""",
)
def _(spark, sf):
    rows = corpus(spark, sf).select("uid", "informative", "n_chars", "humanitarian_label")
    # every third length is informative unless labeled, so the tail model needs the labeled rows
    return cascade.safety_net(rows, _length_model, _tail_model).select("uid", "humanitarian_label")


def report_sql(by: str | None = None) -> str:
    key = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""{WITH_SCORED}, p AS (SELECT {key}CAST(informative AS INTEGER) AS y, predicted AS p FROM scored),
    k AS (SELECT {key}y AS cls FROM p UNION SELECT {key}p FROM p),
    c AS (SELECT {'k.' + by + ',' if by else ''} cls, count(*) FILTER (y = cls AND p = cls) AS tp, count_if(y = cls) AS support, count_if(p = cls) AS guessed
          FROM k JOIN p {using} GROUP BY ALL),
    s AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s),
    u AS (
      SELECT {key}CAST(cls AS VARCHAR) AS name, precision, recall, f1, support FROM f
      UNION ALL SELECT {key}'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM f {'GROUP BY ' + by if by else ''}
      UNION ALL SELECT {key}'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f {'GROUP BY ' + by if by else ''}
      UNION ALL SELECT {key}'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f {'GROUP BY ' + by if by else ''})
    SELECT {key}name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM u"""


@query("J5_classification_report", report_sql())
def _(spark, sf):
    return evaluate.classification_report(scored(spark, sf))


@query("J6_grouped_report", report_sql("subset"))
def _(spark, sf):
    return evaluate.grouped_report(scored(spark, sf), "subset")


MACRO_SQL = """
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0 FROM n),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0 FROM m)"""


@query(
    "J7_binary_metrics",
    f"""{WITH_SCORED}, n AS (SELECT count_if(informative AND predicted = 1) AS tp, count_if(NOT informative AND predicted = 1) AS fp,
      count_if(informative AND predicted = 0) AS fn, count_if(NOT informative AND predicted = 0) AS tn FROM scored), {MACRO_SQL}
    SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((p1 + p0) / 2, 6) AS macro_precision,
      round((r1 + r0) / 2, 6) AS macro_recall, round((f1 + f0) / 2, 6) AS macro_f1,
      round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1, 6) AS f1 FROM f""",
)
def _(spark, sf):
    return evaluate.binary_metrics(scored(spark, sf))


# the same doubles in both engines, so that a score equal to a threshold counts as reaching it
SWEEP_SQL = f"""{WITH_SCORED}, t AS (SELECT unnest({evaluate.thresholds()}::DOUBLE[]) AS threshold),
n AS (SELECT threshold, count_if(informative AND probability >= threshold) AS tp, count_if(NOT informative AND probability >= threshold) AS fp,
  count_if(informative AND probability < threshold) AS fn, count_if(NOT informative AND probability < threshold) AS tn
  FROM scored, t GROUP BY threshold), {MACRO_SQL},
sweep AS (SELECT round(threshold, 6) AS threshold, round((f1 + f0) / 2, 6) AS macro_f1 FROM f)"""


@query("J8_threshold_sweep", f"{SWEEP_SQL} SELECT threshold, macro_f1 FROM sweep")
def _(spark, sf):
    return evaluate.threshold_sweep(scored(spark, sf))


@query("J8_best_threshold", f"{SWEEP_SQL} SELECT threshold, macro_f1 FROM sweep ORDER BY macro_f1 DESC, threshold LIMIT 1")
def _(spark, sf):
    return evaluate.best_threshold(evaluate.threshold_sweep(scored(spark, sf)))


@query(
    "J9_imbalance_strategy",
    f"""{WITH_CORPUS}, c AS (SELECT humanitarian_label AS c, count(*) AS n FROM corpus WHERE humanitarian_label IS NOT NULL GROUP BY 1),
    r AS (SELECT max(n) / min(n) AS r, arg_min(c, n) AS minority_class FROM c)
    SELECT round(r, 6) AS imbalance_ratio, minority_class, CASE WHEN r <= 1.5 THEN 'standard' WHEN r <= 5 THEN 'class_weights'
      WHEN r < 15 THEN 'sampler' ELSE 'focal_loss' END AS strategy FROM r""",
)
def _(spark, sf):
    return evaluate.imbalance_strategy(corpus(spark, sf), "humanitarian_label")


@query(
    "J10_class_weights",
    f"""{WITH_CORPUS}, c AS (SELECT event_type, count(*) AS n_rows FROM corpus GROUP BY 1),
    t AS (SELECT sum(n_rows) AS n, count(*) AS k, sum(1 / n_rows) AS inv FROM c)
    SELECT event_type, n_rows, round(n / (k * n_rows), 6) AS balanced, round(1 / n_rows / inv * k, 6) AS inverse FROM c, t""",
)
def _(spark, sf):
    rows = corpus(spark, sf)
    a = evaluate.class_weights(rows, "event_type").select("event_type", "n_rows", F.round("weight", 6).alias("balanced"))
    b = evaluate.class_weights(rows, "event_type", "inverse").select("event_type", F.round("weight", 6).alias("inverse"))
    return a.join(b, "event_type")


LOSS_SQL = f"""{WITH_SCORED}, l AS (
  SELECT CAST(informative AS INTEGER) AS y, ln(exp(z0) + exp(z1)) - CASE WHEN informative THEN z1 ELSE z0 END AS ce FROM scored),
w AS (SELECT *, CASE y WHEN 1 THEN 0.75 ELSE 1.5 END AS w FROM l)"""


@query(
    "J11_loss",
    f"""{LOSS_SQL} SELECT 'standard' AS kind, round(avg(ce), 6) AS loss FROM w
    UNION ALL SELECT 'class_weights', round(sum(w * ce) / sum(w), 6) FROM w
    UNION ALL SELECT 'focal_loss', round(avg(w * (1 - exp(-ce)) ** 2 * ce), 6) FROM w""",
)
def _(spark, sf):
    rows = scored(spark, sf)
    result = None
    for kind in ("standard", "class_weights", "focal_loss"):
        weights = None if kind == "standard" else {1: 0.75, 0: 1.5}
        part = evaluate.loss(rows, kind=kind, weights=weights).select(F.lit(kind).alias("kind"), "loss")
        result = part if result is None else result.unionByName(part)
    return result


WORD_RULE = "coalesce(lower(tweet_text) LIKE '% the %', false)"


@query(
    "J12_fit_binary",
    f"""{WITH_CORPUS}, ruled AS (SELECT uid, {WORD_RULE} AS informative FROM corpus),
    {split_sql('ruled', 'informative', '0.1', '0.1', 'a')}
    SELECT count(*) AS n_rows, CAST(count_if(informative) AS BIGINT) AS n_informative, true AS learned FROM a WHERE split = 'test'""",
)
def _(spark, sf):
    """A model of a plain word rule predicts it on the test part."""
    rows = corpus(spark, sf).select("uid", "tweet_text", F.expr(WORD_RULE).alias("informative"))
    parts = splits.stratified_split(rows, "informative")
    train = parts.filter(F.col("split") == "train")
    validation = parts.filter(F.col("split") == "validation")
    candidates = ({"regParam": 0.1}, {"regParam": 0.01})
    model, _ = cascade.fit_binary(train, validation, candidates, num_features=1 << 16)
    test = cascade.predict_binary(model, parts.filter(F.col("split") == "test"))
    right = F.count_if(F.col("predicted") == F.col("informative").cast("int"))
    return test.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("informative").alias("n_informative"),
        (right >= 0.8 * F.count(F.lit(1))).alias("learned"),
    )


@query(
    "J13_collapse_check",
    f"""{WITH_SCORED}, k AS (SELECT unnest([0, 1]) AS cls), t AS (SELECT count(*) AS n, count(DISTINCT predicted) AS kinds FROM scored)
    SELECT CAST(cls AS INTEGER) AS cls, round((SELECT count(*) FROM scored WHERE CAST(informative AS INTEGER) = cls) / n, 6) AS label_share,
      round((SELECT count(*) FROM scored WHERE predicted = cls) / n, 6) AS predicted_share, kinds = 1 AS collapsed FROM k, t""",
)
def _(spark, sf):
    return evaluate.collapse_check(scored(spark, sf))


@query("J14_failed_predictions", f"{FAILED_SQL} SELECT uid, predicted FROM failed")
def _(spark, sf):
    return sampling.failed_predictions(scored(spark, sf)).select("uid", "predicted")
