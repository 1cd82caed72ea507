"""Near-duplicate groups by 64-bit SimHash and Golay-code fuzzy hashing.

Two fingerprints link at two or fewer differing bits. A fingerprint is cut into
three segments. Of three segments with at most two errors in all, one has none
and, going round, it can be chosen so that the next one has one at most. So a
key is an exact segment together with the index of a codeword near the next
segment; linked fingerprints share a key, and each has at most 18.

Equal fingerprints are one node, so copies cost nothing. Small buckets of equal
keys are compared inside a task and give a forest of verified links. The
members of large buckets are linked through points instead: a fingerprint and
its 64 neighbours at one bit. Two fingerprints are within two bits if and only
if they share such a point, and a point has 65 members at most. No bucket is
cut off and none is paired out.

Defined results
    null text      an empty text: fingerprint zero, linked like any other
    null doc_id    the least id of all; a component led by it has a null id.
                   ``drop_near_copies`` lets a row with an id stay before one without
    equal ids      each row gets its own fingerprint and component, and stays or
                   goes by id and text; rows equal in both leave one
    long texts     whole, hashed in blocks
    empty table    an empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.common import as_id, id_of, int64, text_of
from tidesift.llm.components import components, drop_followers
from tidesift.llm.golay import near_indices
from tidesift.session import Workspace

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
SMALL_BUCKET = 64
BLOCK = 100_000


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``size`` words, in blocks; a shorter text is one run, a blank text none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return
    n = max(len(words) - size + 1, 1)
    for low in range(0, n, BLOCK):
        part = words[low : low + BLOCK + size - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        width = min(size, len(part))
        starts = np.r_[0, ends[:-width]].tolist()
        stops = (ends[width - 1 :] - 1).tolist()
        yield np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def fingerprint(text: str) -> int:
    """Bit b is set if more than half of the shingles' hashes have it."""
    set_bits, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, SHINGLE):
        octets = hashes.view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["id", "txt", "fp"])


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (uint64)."""
    parts = [(fingerprints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        near = near_indices(parts[(i + 1) % 3])
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(i << 34 | parts[i][row] << 12 | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            node, fp = int64(part.column(0)), int64(part.column(1))
            row, key = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(node[row]), pa.array(fp[row])], names=["key", "node", "fp"]
            )


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of verified links per bucket."""
    for batch in batches:
        us, vs = [], []
        for members in batch.column(0).to_pylist():
            node = np.array([m["node"] for m in members], dtype=np.int64)
            fp = np.array([m["fp"] for m in members], dtype=np.int64)
            close = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= DISTANCE
            left = np.ones(len(node), dtype=bool)
            while left.any():
                front = np.zeros(len(node), dtype=bool)
                root = int(np.argmax(left))
                front[root] = True
                left[root] = False
                while front.any():
                    new = left & close[front].any(axis=0)
                    us += node[new].tolist()
                    vs += [int(node[root])] * int(new.sum())
                    left &= ~new
                    front = new
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            node, fp = int64(part.column(0)), int64(part.column(1)).view(np.uint64)
            points = (fp[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(node, 65))], names=["point", "node"])


def links(nodes: DataFrame, space: Workspace, small: int = SMALL_BUCKET) -> DataFrame:
    """Links (u, v) between nodes (node, fp), fp distinct, whose components are those of all pairs within the distance."""
    keyed = nodes.select("node", "fp").mapInArrow(_keyed, "key long, node long, fp long")
    sizes = space.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = space.keep(keyed.join(sizes, "key"))
    buckets = shared.filter(F.col("n") <= small).groupBy("key").agg(F.collect_list(F.struct("node", "fp")).alias("members"))
    verified = buckets.select("members").mapInArrow(_bucket_links, "u long, v long")
    crowded = shared.filter(F.col("n") > small).select("node", "fp").distinct()
    points = crowded.mapInArrow(_points, "point long, node long")
    stars = points.groupBy("point").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1)
    stars = stars.select(F.explode("nodes").alias("u"), F.array_min("nodes").alias("v"))
    return verified.union(stars)


def _rooted(docs: DataFrame, id_column: str, text_column: str, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, txt, fp) of every row, txt the hash of its text, and (fp, least, root) of every fingerprint."""
    text = text_of(text_column)
    narrow = docs.select(id_of(id_column).alias("id"), F.xxhash64(text).alias("txt"), text.alias("text"))
    rows = space.keep(narrow.mapInArrow(_fingerprints, "id long, txt long, fp long"))
    # nodes are fingerprints, as ids may repeat; the least id of a component is looked up last
    nodes = space.keep(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), space), space)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, rooted


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: fingerprint (long) and component_id, the least id reachable through links."""
    rows, rooted = _rooted(docs, id_column, text_column, Workspace(docs.sparkSession, "simhash"))
    led = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return rows.join(led, "fp").select(
        as_id(F.col("id")).alias(id_column), F.col("fp").alias("fingerprint"), as_id(F.col("component")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay: of every component the document with the least id."""
    space = Workspace(docs.sparkSession, "simhash")
    rows, rooted = _rooted(docs, id_column, text_column, space)
    return drop_followers(docs, space.keep(rows.join(rooted, "fp").select("id", "txt", "root")), id_column, text_column)
