"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combine and two joins; the number
of rounds grows with the logarithm of the longest chain. A hub's links are
split by the skew join, as only the minimum per node is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.common import NO_ID, id_of, one_of_each, text_of
from tidesift.operators.bloom import drop_rows, keep_rows
from tidesift.session import Workspace


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not its own root; the root is the component's least node."""
    links = space.keep(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _signature(links)
    while before[0]:
        after = space.keep(_small_star(_large_star(links)))
        space.free(links)
        links, now = after, _signature(after)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def drop_followers(docs: DataFrame, members: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``docs`` that lead their component: the least id, one with an id before one without.

    ``members`` has (id, txt, root) of every row, txt being the hash of its text. Rows
    are told apart by id and text, so others that share an id, or have none, stay.
    Only keys of rows that go, or that stand there more than once, are joined.
    """
    own = members.groupBy("root", "id", "txt").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((F.col("id") == NO_ID).alias("none"), F.col("id").alias("first"), F.col("txt").alias("text"))
    best = own.groupBy("root").agg(F.min(rank).alias("best"), F.sum("n").alias("all")).filter("all > 1")
    judged = own.join(best, "root").withColumn("leads", (F.col("id") == F.col("best.first")) & (F.col("txt") == F.col("best.text")))
    space = Workspace(docs.sparkSession, "followers")
    judged = space.keep(judged.select("id", "txt", "leads", "n"))
    document = {"id": id_of(id_column), "txt": F.xxhash64(text_of(text_column))}
    left = drop_rows(docs, judged.filter("NOT leads OR n > 1").select("id", "txt"), document)
    repeated = judged.filter("leads AND n > 1").select("id", "txt")
    if repeated.isEmpty():
        return left
    return left.unionByName(one_of_each(keep_rows(docs, repeated, document), document))
