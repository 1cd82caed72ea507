"""Near-duplicate groups by MinHash with tensored banding, verified on whole shingle sets.

Two collections of ``HALVES`` keys are made, each key of ``VALUES`` minima. A
table key is a pair of one key of the first collection and one of the second, so
HALVES^2 tables need 2 * HALVES * VALUES minima instead of 2 * HALVES^2 *
VALUES: 60 instead of 600. Two sets at similarity s share a table if they share
a key in both collections, with probability (1 - (1 - s^VALUES)^HALVES)^2:
0.99985 at 0.85, more above it. Every link is confirmed by the sizes of
intersection and union of the whole sets.

The pairs of keys are not written out for all documents. A table can only be
shared by documents that share both its keys, so keys that stand in one
component only go first, then documents without such a key on either side; most
documents have none. Equal sets are one node.

First every node meets one other node: of the least nodes of its keys the one it
meets most often. A group of near copies that holds a third of all rows becomes
one component, or a few, at linear cost, and its keys leave. What is left of the
tables then makes neighbourhoods of nodes that share tables, directly or over
others. A neighbourhood is cut into slices, and each pair of slices is compared
in one task: nodes of unlike components that share a table, the likeliest first,
until they are compared or connected. Only links leave the task, not pairs; the
largest component of a neighbourhood is not compared with itself, and no table
or slice is cut off. Pairs whose sizes rule the similarity out are passed over,
and so are those whose 60 minima, four bits of each kept, differ in more than
``MOST_UNLIKE`` places: at similarity 0.85 about 8.4 do, and 25 do with
probability below 0.000001.

A neighbourhood of many texts that are alike in part but not linked stays
quadratic in its size, in numpy comparisons inside tasks.

Defined results
    null, empty or blank text    an empty set: no shingles, linked with nothing, kept
    fewer words than a shingle   the whole sequence is the one shingle
    null doc_id                  the least id of all; a component led by it has a null id
    equal ids                    each row has its own set; a component may be led by any of them
    repeated rows                one node; each row is returned
    long texts                   whole, hashed in blocks
    ties                         components do not depend on the order of nodes
    empty table                  an empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.common import as_id, id_of, text_of
from tidesift.llm.components import components
from tidesift.llm.simhash import shingle_hashes
from tidesift.operators.blocks import cogroup_slices, list_lengths
from tidesift.operators.bloom import keep_rows
from tidesift.session import Workspace

SHINGLE = 3
LEAST_PCT = 85
HALVES, VALUES = 10, 3
MINIMA = 2 * HALVES * VALUES
SEED = 42
PART = 2_048  # shingles hashed at a time
SKETCH_LONGS = 4  # of 15 places of four bits
MOST_UNLIKE = 24
SLICE_ROWS, SLICE_SHINGLES = 2_048, 4_000_000


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64); none of a blank text."""
    blocks = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype=np.uint64)


def set_digest(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def minima(grams: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    draws = np.random.default_rng(SEED).integers(1, 1 << 62, size=(2, MINIMA, 1), dtype=np.uint64)
    factors, shifts = draws[0] * np.uint64(2) + np.uint64(1), draws[1]
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(grams), PART):
        mixed = grams[low : low + PART] * factors + shifts
        mixed ^= mixed >> np.uint64(31)
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def half_keys(least: np.ndarray) -> np.ndarray:
    """One key (int64) for each member of both collections; its place is part of it."""
    keys = np.arange(2 * HALVES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for column in least.reshape(2 * HALVES, VALUES).T:
        keys = (keys ^ column ^ (column >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, 15 to a long."""
    nibbles = ((least >> np.uint64(7)) & np.uint64(15)).reshape(SKETCH_LONGS, -1)
    return (nibbles << (np.arange(nibbles.shape[1], dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            nodes, sizes, keys, sketches = [], [], [], []
            for text in part.column(2):
                grams = shingle_set(text.as_py())
                sizes.append(len(grams))
                if not len(grams):
                    nodes.append(None)
                    keys.append(None)
                    sketches.append(None)
                    continue
                least = minima(grams)
                nodes.append(set_digest(grams))
                keys.append(half_keys(least))
                sketches.append(sketch(least))
            columns = [
                *part.columns[:2],
                pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(sketches, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "txt", "digest", "size", "keys", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            found = [shingle_set(t.as_py()) for t in part.column(0)]
            digests = pa.array([set_digest(g) for g in found], pa.binary())
            grams = pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([digests, grams], names=["digest", "grams"])


def overlaps(grams: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of each other set are in this one."""
    grams, flat = grams.view(np.uint64), np.concatenate(others).view(np.uint64)  # sets are sorted as unsigned numbers
    at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
    starts = np.cumsum([0] + [len(o) for o in others[:-1]])
    return np.add.reduceat((grams[at] == flat).astype(np.int64), starts)


def _similar(grams: np.ndarray, others: list[np.ndarray], least_pct: int) -> np.ndarray:
    both = overlaps(grams, others)
    union = len(grams) + np.array([len(o) for o in others]) - both
    return 100 * both >= least_pct * union


def _confirmed(least_pct: int):
    """Of pairs with both sets, those similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            linked = [bool(_similar(a.values.to_numpy(), [b.values.to_numpy()], least_pct)[0]) for a, b in pairs]
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return run


class _Side:
    """One slice of a neighbourhood as arrays."""

    def __init__(self, table: pa.Table):
        self.node, self.main = table.column("uid").to_numpy(), table.column("main").to_numpy()
        self.root = table.column("root").to_numpy().copy()
        self.size = table.column("size").to_numpy()
        self.keys = list_lengths(table.column("keys"))[0].reshape(-1, 2 * HALVES)
        self.sketch = list_lengths(table.column("sketch"))[0].reshape(-1, SKETCH_LONGS).view(np.uint64)
        flat, lengths = list_lengths(table.column("grams"))
        ends = np.cumsum(lengths)
        self.grams = [flat[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def _candidates(a: _Side, i: int, b: _Side, least_pct: int) -> np.ndarray:
    """Rows of b that share a table with row i of a and may be similar enough, the likeliest first."""
    same = b.keys == a.keys[i]
    may = same[:, :HALVES].any(axis=1) & same[:, HALVES:].any(axis=1) & (b.root != a.root[i])
    may &= 100 * np.minimum(b.size, a.size[i]) >= least_pct * np.maximum(b.size, a.size[i])
    may &= b.main | (b.node > a.node[i])  # of two rows that are not in the main component, either order would do
    rows = np.flatnonzero(may)
    x = b.sketch[rows] ^ a.sketch[i]
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    unlike = np.bitwise_count(x & np.uint64(int("0001" * 15, 2))).sum(axis=1, dtype=np.int64)
    order = np.argsort(unlike, kind="stable")
    return rows[order[unlike[order] <= MOST_UNLIKE]]


def _link_slices(least_pct: int):
    """Links that connect components of two slices; rows already connected are not compared again."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        us, vs = [], []
        if left.num_rows and right.num_rows:
            a, b = _Side(left), _Side(right)
            for i in range(len(a.node)):
                rest, step = _candidates(a, i, b, least_pct), 1
                while len(rest):
                    now, rest = rest[:step], rest[step:]
                    for j in now[_similar(a.grams[i], [b.grams[j] for j in now], least_pct)]:
                        mine, other = a.root[i], b.root[j]
                        if mine != other:
                            us.append(int(a.node[i]))
                            vs.append(int(b.node[j]))
                            for side in (a, b):
                                side.root[side.root == other] = mine
                    rest = rest[b.root[rest] != a.root[i]]
                    step = min(4 * step, 256)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that stand in more than one component."""
    keys = rows.groupBy(key).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select(key)
    return rows.join(keys, key, "left_semi")


class _Linker:
    """Finds links between the nodes of ``rows`` (id, txt, digest, size, keys, sketch) until every shared table is settled."""

    def __init__(self, docs: DataFrame, rows: DataFrame, space: Workspace, id_column: str, text_column: str, least_pct: int):
        self.space, self.least_pct = space, least_pct
        self.docs, self.id_column, self.text_column = docs, id_column, text_column
        one = rows.filter("size > 0").dropDuplicates(["digest"])
        # numbered once and written, so the numbers stay
        self.nodes = space.keep(one.withColumn("node", F.monotonically_increasing_id()))
        self.links = space.keep(self.nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
        self.roots = space.keep(components(self.links, space))
        self.sets: DataFrame | None = None

    def _rooted(self, rows: DataFrame) -> DataFrame:
        named = self.roots.select("node", F.col("root").alias("new"))
        return rows.drop("root").join(named, "node", "left").withColumn("root", F.coalesce("new", "node")).drop("new")

    def _add(self, found: DataFrame) -> None:
        links = self.space.keep(self.links.union(found))
        roots = self.space.keep(components(links, self.space))
        self.space.free(self.links, self.roots)
        self.links, self.roots = links, roots

    def _sets_of(self, wanted: DataFrame) -> DataFrame:
        """(node, grams) of these nodes at least; texts of other documents stay where they are."""
        wanted = wanted if self.sets is None else wanted.join(self.sets, "node", "left_anti")
        rows = self.space.keep(self.nodes.join(wanted, "node", "left_semi").select("id", "txt", "digest", "node"))
        text = text_of(self.text_column)
        docs = keep_rows(self.docs, rows.select("id", "txt"), {"id": id_of(self.id_column), "txt": F.xxhash64(text)})
        # rows that share id and hash of the text may be unlike or repeated; the digest of the set tells the node
        made = docs.select(text_of(self.text_column).alias("text")).mapInArrow(_sets, "digest binary, grams array<long>")
        made = self.space.keep(made.join(rows.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "grams"))
        self.sets = made if self.sets is None else self.sets.union(made)
        return self.sets

    def _half_rows(self) -> DataFrame:
        """(node, place, key, root) of the keys that stand in more than one component."""
        rows = self.nodes.select("node", F.posexplode("keys").alias("place", "key"))
        keys = self.space.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
        return _several(self._rooted(rows.join(keys, "key", "left_semi")), "key")

    def meet_one(self) -> None:
        """Every node meets the least node it shares most keys with."""
        keys = self.space.keep(self._half_rows())
        heads = keys.groupBy("key").agg(F.min("node").alias("head"))
        met = keys.join(heads, "key").filter("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
        one = met.groupBy("node").agg(F.max(F.struct(F.col("n"), (-F.col("head")).alias("head"))).alias("best"))
        pairs = self.space.keep(one.select(F.col("node").alias("u"), (-F.col("best.head")).alias("v")))
        sets = self._sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        left = sets.select(F.col("node").alias("u"), F.col("grams").alias("left"))
        right = sets.select(F.col("node").alias("v"), F.col("grams").alias("right"))
        both = pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right")
        self._add(both.mapInArrow(_confirmed(self.least_pct), "u long, v long"))
        self.space.free(keys, pairs)

    def tables(self) -> DataFrame:
        """(node, root, bucket) of the tables that hold more than one component."""
        held = self._half_rows().groupBy("node", "root").agg(F.collect_list(F.struct("place", "key")).alias("held"))
        first = F.filter("held", lambda k: k["place"] < HALVES)
        second = F.filter("held", lambda k: k["place"] >= HALVES)
        both = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["key"], b["key"]))))
        return _several(self.space.keep(held.select("node", "root", F.explode(both).alias("bucket"))), "bucket")

    def settle(self) -> DataFrame:
        """(node, root) once all nodes that share a table are compared or connected."""
        self.meet_one()
        live = self.space.keep(self.tables())
        if live.isEmpty():
            return self.roots
        # nodes that share a table, directly or over others, are a neighbourhood
        stars = live.join(live.groupBy("bucket").agg(F.min("node").alias("v")), "bucket").select(F.col("node").alias("u"), "v")
        near = self.space.keep(components(stars.distinct(), self.space)).withColumnsRenamed({"node": "uid", "root": "near"})
        members = live.groupBy(F.col("node").alias("uid"), "root").agg(F.lit(1).alias("one")).drop("one").join(near, "uid", "left")
        members = self.space.keep(members.select("uid", "root", F.coalesce("near", "uid").alias("bucket")))
        # all pairs but those inside a neighbourhood's largest component
        sizes = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top")).select("bucket", F.col("top.root").alias("top"))
        sets = self._sets_of(members.select(F.col("uid").alias("node")))
        told = self.nodes.select(F.col("node").alias("uid"), "size", "keys", "sketch").join(sets.withColumnRenamed("node", "uid"), "uid")
        rows = members.join(largest, "bucket").withColumn("main", F.col("root") == F.col("top")).drop("top").join(told, "uid")
        rows = self.space.keep(rows)
        kernel = _link_slices(self.least_pct)
        self._add(cogroup_slices(rows.filter("NOT main"), rows, kernel, "u long, v long", SLICE_ROWS, F.col("size"), SLICE_SHINGLES))
        return self.roots


def linked_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_pct: int = LEAST_PCT) -> tuple[DataFrame, DataFrame]:
    """(id, txt, digest, size, ...) of every row, and (digest, root) of every set: equal roots are linked."""
    space = Workspace(docs.sparkSession, "tensor-minhash")
    text = text_of(text_column)
    narrow = docs.select(id_of(id_column).alias("id"), F.xxhash64(text).alias("txt"), text.alias("text"))
    kinds = "id long, txt long, digest binary, size long, keys array<long>, sketch array<long>"
    rows = space.keep(narrow.mapInArrow(_signed, kinds))
    linker = _Linker(docs, rows, space, id_column, text_column, least_pct)
    roots, nodes = linker.settle(), linker.nodes.select("digest", "node")
    return rows, nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))


def near_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_pct: int = LEAST_PCT) -> DataFrame:
    """One row per document: size of its set, component_id (least id reachable through links) and whether it leads it."""
    rows, roots = linked_sets(docs, id_column, text_column, least_pct)
    least = rows.filter("size > 0").groupBy("digest").agg(F.min("id").alias("least")).join(roots, "digest")
    led = least.groupBy("root").agg(F.min("least").alias("component"))
    components_of = least.join(led, "root").select("digest", "component")
    # a document without a set is its own component
    found = rows.select("id", "digest", "size").join(components_of, "digest", "left").withColumn("component", F.coalesce("component", "id"))
    return found.select(
        as_id(F.col("id")).alias(id_column),
        F.col("size").alias("n_shingles"),
        as_id(F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
