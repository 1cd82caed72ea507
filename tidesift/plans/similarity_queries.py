"""Queries for near-duplicate detection and similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidesift.functions import vectors as vx
from tidesift.operators import neardup, vector_search
from tidesift.operators.greedy import greedy_first_wins
from tidesift.plans import similarity_sql as sql
from tidesift.plans.registry import first_wins_sql, query
from tidesift.plans.views import table, texts, vectors

LIMIT = 0.35  # the largest cosine of the given vectors is about 0.5


def _label_means(spark, sf):
    """One query vector per label, averaged over the whole table."""
    cells = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda c: c["x"]).alias("embedding"))


@query("G1_ngram_cosine_pairs", sql.NGRAM_SQL)
def _(spark, sf):
    pairs = neardup.ngram_cosine_pairs(texts(spark, sf), 0.75)
    return pairs.select("src", "dst", F.round("cosine", 6).alias("cosine"))


@query("G2_jaccard_pairs", sql.JACCARD_SQL)
def _(spark, sf):
    return neardup.jaccard_pairs(texts(spark, sf), 0.8).select("src", "dst", F.round("jaccard", 6).alias("jaccard"))


@query("G3_minhash_pairs", sql.JACCARD_SQL)
def _(spark, sf):
    return neardup.minhash_pairs(texts(spark, sf), 0.8).select("src", "dst", F.round("jaccard", 6).alias("jaccard"))


@query("G5_cosine", sql.COSINE_SQL)
def _(spark, sf):
    rows = vectors(spark, sf).join(_label_means(spark, sf).withColumnRenamed("embedding", "mean"), "label")
    cosine = vx.cosine(F.col("embedding"), F.col("mean"))
    unit, center = vx.l2_normalize(F.col("embedding")), vx.l2_normalize(F.col("mean"))
    gap = F.zip_with(unit, center, lambda a, b: a - b)
    squared = vx.dot(gap, gap)
    scored = rows.select("uid", "label", cosine.alias("c"), squared.alias("d"))
    return scored.select(
        "uid",
        "label",
        F.round("c", 6).alias("cosine"),
        F.round(vx.l2_to_cosine(F.col("d")), 6).alias("cosine_by_distance"),
        F.round("d", 6).alias("squared_distance"),
    )


@query(
    "G6_nearest_cells",
    f"WITH {sql.CELL_SQL} SELECT uid, CAST(cell AS INTEGER) AS cell FROM near WHERE n <= 10",
)
def _(spark, sf):
    rows = vector_search.distinct_vectors(vectors(spark, sf))
    index = vector_search.build_cells(rows, nprobe=10, train="hash")
    return vector_search.nearest_cells(rows, index, index.nprobe).select("uid", F.col("bucket").alias("cell"))


@query("G6_kmeans_cells", f"WITH {sql.UNIT_SQL} SELECT min(uid) AS uid, true AS nearest FROM unit GROUP BY v")
def _(spark, sf):
    """Whether every vector is in the cell of its nearest center, checked beside the assignment."""
    rows = vector_search.distinct_vectors(vectors(spark, sf))
    index = vector_search.build_cells(rows, nlist=16, train="kmeans")
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in center]) for center in index.centroids])
    products = F.transform(centers, lambda c: vx.dot(F.col("vec"), c))
    cells = vector_search.nearest_cells(rows, index, 1).withColumn("products", products)
    own = F.element_at("products", F.col("bucket") + 1)
    return cells.select("uid", (own >= F.array_max("products") - 1e-8).alias("nearest"))


@query("G7_radius_pairs", sql.RADIUS_SQL)
def _(spark, sf):
    return vector_search.radius_pairs(vectors(spark, sf), LIMIT, train="hash").select("src", "dst", F.round("score", 6).alias("score"))


@query("G8_knn_pairs", sql.KNN_PAIRS_SQL)
def _(spark, sf):
    pairs = vector_search.knn_pairs(vectors(spark, sf), 5, LIMIT, train="hash")
    return pairs.select("src", "dst", F.round("score", 6).alias("score"))


# Orders of one customer at most 14 days apart stand for similar pairs.
NEIGHBOUR_SQL = f"""WITH RECURSIVE edges AS (
  SELECT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b
  ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
  AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 14),
{first_wins_sql('edges', 'lost')}
SELECT uid FROM lost"""


@query("G9_greedy_first_wins", NEIGHBOUR_SQL)
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    a, b = rows.alias("a"), rows.alias("b")
    close = F.abs(F.datediff(F.col("a.day"), F.col("b.day"))) <= 14
    pairs = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & close)
    return greedy_first_wins(pairs.select(F.col("a.o_orderkey").alias("src"), F.col("b.o_orderkey").alias("dst")))


@query("G10_near_dedup_ngram", sql.NGRAM_DEDUP_SQL)
def _(spark, sf):
    return neardup.near_dedup(texts(spark, sf), "ngram", threshold=0.75).select("uid")


@query("G10_near_dedup_minhash", sql.MINHASH_DEDUP_SQL)
def _(spark, sf):
    return neardup.near_dedup(texts(spark, sf), "minhash", threshold=0.8).select("uid")


@query("G10_near_dedup_radius", sql.RADIUS_DEDUP_SQL)
def _(spark, sf):
    return neardup.near_dedup(vectors(spark, sf), "radius", threshold=LIMIT, train="hash").select("uid")


@query("G10_near_dedup_knearest", sql.KNN_DEDUP_SQL)
def _(spark, sf):
    return neardup.near_dedup(vectors(spark, sf), "knearest", threshold=LIMIT, top_k=5, train="hash").select("uid")


@query("G11_threshold_sweep_survivors", sql.SWEEP_SQL)
def _(spark, sf):
    return vector_search.threshold_sweep_survivors(vectors(spark, sf), sql.SWEEP_LEVELS, top_k=5, train="hash")


@query("G12_search_nearest", sql.SEARCH_K_SQL)
def _(spark, sf):
    hits = vector_search.search(vectors(spark, sf), _label_means(spark, sf).withColumnRenamed("label", "uid"), k=3)
    return hits.select("query", "uid", F.round("score", 6).alias("score"))


@query("G12_search_radius", sql.SEARCH_RADIUS_SQL)
def _(spark, sf):
    hits = vector_search.search(vectors(spark, sf), _label_means(spark, sf).withColumnRenamed("label", "uid"), radius=0.3)
    return hits.select("query", "uid", F.round("score", 6).alias("score"))
