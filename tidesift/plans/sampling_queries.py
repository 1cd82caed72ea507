"""Queries for sampling, quotas, splits and stage sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidesift.operators import sampling, splits
from tidesift.plans.registry import drawn_sql, place, query, split_sql
from tidesift.plans.views import CORPUS_SQL, corpus

WITH_CORPUS = f"WITH {CORPUS_SQL}"


def _pools(spark, sf):
    columns = ["uid", "informative", "humanitarian_label", "subset", "event_name", "event_type"]
    return splits.Pools.of(corpus(spark, sf).select(*columns))


@query(
    "H1_sample_frac",
    f"{WITH_CORPUS}, {drawn_sql('corpus', '(SELECT round_even(count(*) * 0.25, 0) FROM corpus)', 's')} SELECT uid FROM s",
)
def _(spark, sf):
    return sampling.sample_frac(corpus(spark, sf), "0.25").select("uid")


@query("H2_sample_n", f"{WITH_CORPUS}, {drawn_sql('corpus', '100', 's')} SELECT uid FROM s")
def _(spark, sf):
    return sampling.sample_n(corpus(spark, sf), 100).select("uid")


@query("H3_shuffle", f"{WITH_CORPUS} SELECT uid, informative FROM corpus")
def _(spark, sf):
    return sampling.shuffle(corpus(spark, sf)).select("uid", "informative")


POOLS_SQL = f"""{WITH_CORPUS},
disaster AS (SELECT * FROM corpus WHERE subset = 'disaster'),
weather AS (SELECT * FROM corpus WHERE subset = 'weather'),
out_topic AS (SELECT * FROM corpus WHERE subset = 'out_topic')"""


def quota_sql(disaster: str, weather: str, times: str) -> str:
    return f"""(SELECT CAST(ceil(count_if(informative) * {times}) - count_if(NOT informative)
      - (SELECT count(*) FROM {weather}) AS BIGINT) FROM {disaster})"""


@query(
    "H4_noise_quota",
    f"""{POOLS_SQL} SELECT 'net' AS quota, {quota_sql('disaster', 'weather', '3')} AS n_rows
    UNION ALL SELECT 'simple', CAST(count_if(informative) * 3 AS BIGINT) FROM disaster""",
)
def _(spark, sf):
    pools = _pools(spark, sf)
    rows = [(m, sampling.noise_quota(pools.disaster, pools.weather, 3, m)) for m in ("net", "simple")]
    return spark.createDataFrame(rows, "quota string, n_rows long")


def fraction_sql(d: str, w: str, o: str, fraction: str, times: str, tag: str) -> str:
    """CTEs {tag}_d, {tag}_w, {tag}_o of one fraction draw from three pools."""
    size = f"(SELECT round_even(count(*) * {fraction}, 0) FROM {{}})"
    return ",".join(
        [
            drawn_sql(d, size.format(d), f"{tag}_d"),
            drawn_sql(w, size.format(w), f"{tag}_w"),
            drawn_sql(o, quota_sql(f"{tag}_d", f"{tag}_w", times), f"{tag}_o"),
        ]
    )


def union_sql(*names: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT uid, subset{extra} FROM {n}" for n in names)


FRACTION_SQL = f"{POOLS_SQL}, {fraction_sql('disaster', 'weather', 'out_topic', '0.1', '4', 's')}"
TEST_UIDS = f"({' UNION ALL '.join(f'SELECT uid FROM s_{p}' for p in 'dwo')})"


@query(
    "H5_split_fraction",
    f"""{FRACTION_SQL} {union_sql('s_d', 's_w', 's_o', extra=", 'drawn' AS part")}
    UNION ALL SELECT uid, subset, 'left' FROM corpus WHERE uid NOT IN {TEST_UIDS}""",
)
def _(spark, sf):
    drawn, left = splits.split_fraction(_pools(spark, sf), "0.1", 4)
    return (
        drawn.withColumn("part", F.lit("drawn")).unionByName(left.union().withColumn("part", F.lit("left"))).select("uid", "subset", "part")
    )


ISOLATED_SQL = f"""{POOLS_SQL},
i_d AS (SELECT * FROM disaster WHERE humanitarian_label IS NULL),
{drawn_sql('weather', '(SELECT round_even(count(*) * 0.5, 0) FROM weather)', 'i_w')},
{drawn_sql('out_topic', quota_sql('i_d', 'i_w', '4'), 'i_o')}"""


@query(
    "H6_isolated_strategy",
    f"""{ISOLATED_SQL} {union_sql('i_d', 'i_w', 'i_o', extra=", 1 AS stage")}
    UNION ALL SELECT uid, subset, 2 FROM corpus WHERE uid NOT IN
    ({' UNION ALL '.join(f'SELECT uid FROM i_{p}' for p in 'dwo')})""",
)
def _(spark, sf):
    one, two = splits.isolated_strategy(_pools(spark, sf), times=4)
    return one.withColumn("stage", F.lit(1)).unionByName(two.withColumn("stage", F.lit(2))).select("uid", "subset", "stage")


@query(
    "H7_crossed_strategy",
    f"""{FRACTION_SQL} {union_sql('s_d', 's_w', 's_o', extra=", 1 AS stage")}
    UNION ALL SELECT uid, subset, 2 FROM corpus WHERE uid NOT IN {TEST_UIDS}""",
)
def _(spark, sf):
    one, two = splits.crossed_strategy(_pools(spark, sf), "0.1", 4)
    return one.withColumn("stage", F.lit(1)).unionByName(two.withColumn("stage", F.lit(2))).select("uid", "subset", "stage")


@query(
    "H8_stage3_sets",
    f"""{POOLS_SQL} SELECT uid, 'labeled' AS part FROM disaster WHERE humanitarian_label IS NOT NULL
    UNION ALL SELECT uid, 'not_informative' FROM disaster WHERE NOT informative""",
)
def _(spark, sf):
    labeled, negative = splits.stage3_sets(_pools(spark, sf).disaster)
    return (
        labeled.withColumn("part", F.lit("labeled")).unionByName(negative.withColumn("part", F.lit("not_informative"))).select("uid", "part")
    )


def _mix_sql(w: int, o: int) -> str:
    def some(pool: str, n: int) -> str:
        return f"SELECT uid FROM (SELECT uid, {place()} AS i FROM {pool}) WHERE i <= {n}"

    parts = ["SELECT uid FROM disaster", some("weather", w), some("out_topic", o)]
    return f"SELECT {w} AS n_weather, {o} AS n_out_topic, uid FROM ({' UNION ALL '.join(parts)})"


GRID = [(0, 0), (20, 0), (20, 30)]


@query("H9_experiment_grid", f"{POOLS_SQL} {' UNION ALL '.join(_mix_sql(w, o) for w, o in GRID)}")
def _(spark, sf):
    return splits.experiment_grid(_pools(spark, sf), GRID).select("n_weather", "n_out_topic", "uid")


@query(
    "H10_stratified_split",
    f"""{WITH_CORPUS}, {split_sql('corpus', 'informative', '0.1', '0.1', 'a')}, {split_sql('corpus', 'event_type', '0.15', '0.15', 'b')}
    SELECT 'informative' AS by_column, uid, split FROM a UNION ALL SELECT 'event_type', uid, split FROM b""",
)
def _(spark, sf):
    rows = corpus(spark, sf).select("uid", "informative", "event_type")
    a = splits.stratified_split(rows, "informative").select(F.lit("informative").alias("by_column"), "uid", "split")
    b = splits.stratified_split(rows, "event_type", "0.15", "0.15")
    return a.unionByName(b.select(F.lit("event_type").alias("by_column"), "uid", "split"))


@query(
    "H10_stratified_split_many",
    f"""{WITH_CORPUS}, many AS (SELECT uid, CASE WHEN uid % 10 > 0 THEN CAST(n_chars % 400 AS VARCHAR) END AS kind FROM corpus),
    {split_sql('many', 'kind', '0.1', '0.2', 'a')} SELECT uid, kind, split FROM a""",
)
def _(spark, sf):
    kind = F.when(F.col("uid") % 10 > 0, (F.col("n_chars") % 400).cast("string"))
    rows = corpus(spark, sf).select("uid", kind.alias("kind"))
    return splits.stratified_split(rows, "kind", "0.1", "0.2")


@query(
    "H11_random_split",
    f"{WITH_CORPUS}, one AS (SELECT *, 0 AS whole FROM corpus), {split_sql('one', 'whole', '0.1', '0.1', 'a')} SELECT uid, split FROM a",
)
def _(spark, sf):
    return splits.random_split(corpus(spark, sf)).select("uid", "split")


HOLDOUT = {
    "validation_events": ["src0", "src1"],
    "test_events": ["src2", "src3"],
    "train_types": ["en", "fr"],
    "train_events": ["src5"],
    "undefined_types": ["de"],
    "undefined_events": ["src4"],
}


@query(
    "H12_event_holdout_split",
    f"""{WITH_CORPUS},
    undef AS (SELECT * FROM corpus WHERE event_type = 'de' OR event_name IS NULL OR event_name = 'src4'),
    {split_sql('undef', 'informative', '0.15', '0.15', 'u')},
    f AS (SELECT uid, CASE WHEN event_name IN ('src0', 'src1') THEN 'validation' WHEN event_name IN ('src2', 'src3') THEN 'test'
          WHEN event_name = 'src5' OR event_type IN ('en', 'fr') THEN 'train' END AS split
          FROM corpus WHERE uid NOT IN (SELECT uid FROM undef))
    SELECT uid, split FROM f WHERE split IS NOT NULL UNION ALL SELECT uid, split FROM u""",
)
def _(spark, sf):
    return splits.event_holdout_split(corpus(spark, sf), **HOLDOUT).select("uid", "split")


@query(
    "H13_balance_classes",
    f"""{WITH_CORPUS}, r AS (SELECT uid, informative, {place('informative')} AS i FROM corpus)
    SELECT uid, informative FROM r WHERE i <= (SELECT min(n) FROM (SELECT count(*) AS n FROM corpus GROUP BY informative))""",
)
def _(spark, sf):
    return sampling.balance_classes(corpus(spark, sf), "informative").select("uid", "informative")


# A stand-in prediction that misses few informative rows and raises many others.
GUESS_SQL = "CASE WHEN n_chars % 7 = 0 THEN 1 WHEN informative AND n_chars % 29 <> 0 THEN 1 ELSE 0 END"


@query(
    "H14_hard_negatives",
    f"""{WITH_CORPUS}, failed AS (SELECT * FROM corpus WHERE CAST(informative AS INTEGER) <> {GUESS_SQL}),
    fn AS (SELECT * FROM failed WHERE informative), fp AS (SELECT * FROM failed WHERE NOT informative),
    {drawn_sql('fp', '2 * (SELECT count(*) FROM fn)', 'd')}
    SELECT uid, informative FROM fn UNION ALL SELECT uid, informative FROM d""",
)
def _(spark, sf):
    rows = corpus(spark, sf).withColumn("predicted", F.expr(GUESS_SQL))
    return sampling.hard_negatives(rows, times=2).select("uid", "informative")


@query(
    "H15_safety_net_mix",
    f"""{WITH_CORPUS}, labeled AS (SELECT uid FROM corpus WHERE humanitarian_label IS NOT NULL),
    net AS (SELECT uid FROM corpus WHERE NOT informative),
    {drawn_sql('net', '(SELECT least((SELECT count(*) FROM net), CAST(floor(count(*) * 0.1) AS BIGINT)) FROM labeled)', 'd')}
    SELECT uid, 'labeled' AS part FROM labeled UNION ALL SELECT uid, 'net' FROM d""",
)
def _(spark, sf):
    rows = corpus(spark, sf)
    labeled = rows.filter(F.col("humanitarian_label").isNotNull()).select("uid", F.lit("labeled").alias("part"))
    net = rows.filter(~F.col("informative")).select("uid", F.lit("net").alias("part"))
    return sampling.safety_net_mix(labeled, net)


@query(
    "H16_weighted_resample",
    f"""{WITH_CORPUS}, c AS (SELECT humanitarian_label AS c, count(*) AS n, row_number() OVER (ORDER BY humanitarian_label) - 1 AS i,
      count(*) OVER () AS k FROM corpus WHERE humanitarian_label IS NOT NULL GROUP BY 1),
    d AS (SELECT unnest(range(1, (SELECT CAST(sum(n) AS BIGINT) FROM c) + 1)) AS draw),
    h AS (SELECT draw, CAST('0x' || substr(md5('42|class|' || draw), 1, 12) AS BIGINT) AS a,
          CAST('0x' || substr(md5('42|place|' || draw), 1, 12) AS BIGINT) AS b FROM d),
    p AS (SELECT draw, c, b % n + 1 AS place FROM h JOIN c ON a % k = i),
    r AS (SELECT uid, humanitarian_label, {place('humanitarian_label')} AS place FROM corpus WHERE humanitarian_label IS NOT NULL)
    SELECT draw, uid, humanitarian_label FROM p JOIN r ON c = humanitarian_label AND p.place = r.place""",
)
def _(spark, sf):
    return sampling.weighted_resample(corpus(spark, sf), "humanitarian_label").select("draw", "uid", "humanitarian_label")


@query(
    "H17_shrink_proportional",
    f"""{WITH_CORPUS}, {split_sql('corpus', 'informative', '0.1', '0.1', 'a')},
    n AS (SELECT split, count(*) AS n, max(count(*) FILTER (split = 'train')) OVER () AS n_train FROM a GROUP BY split),
    r AS (SELECT uid, split, {place('split')} AS i FROM a)
    SELECT uid, split FROM r JOIN n USING (split) WHERE i <= CASE WHEN split = 'train' THEN 100 ELSE n * 100 // n_train END""",
)
def _(spark, sf):
    parts = splits.stratified_split(corpus(spark, sf), "informative").select("uid", "split")
    cut = sampling.shrink_proportional({p: parts.filter(F.col("split") == p) for p in splits.PARTS}, 100)
    return cut["train"].unionByName(cut["validation"]).unionByName(cut["test"])
