"""Files of token ids, Re-Pair compressed, in ascending order of documents.

Documents are range-partitioned and sorted by id, tokenized in that order and
cut at document ends into shards of about ``SHARD_IDS`` ids; each shard is one
row of a Parquet file: rules with their expansion lengths, symbols in as many bits
as the largest needs, and the documents' ids and lengths. Spark commits the files, so
lost executors leave no half-written shard, and any store that Spark writes will
do. ``read_tokens`` reads all documents, ``read_documents`` some: of their shards it
expands only the symbols that the expansion lengths point to.

Defined results
    null text      an empty document: its end id alone
    null doc_id    before all others
    equal ids      ordered by a hash of the text, then the text; they may lie in several tasks
    long texts     one document is never cut: a longer one is a shard of its own
    empty table    no shard; reading gives no rows
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidesift.llm.byte_tokens import byte_encoder
from tidesift.llm.common import NO_ID, as_id, id_of, text_of
from tidesift.llm.repair import Grammar, compress, pack_bits, unpack_bits
from tidesift.session import checkpoint_dir

SHARD_IDS = 2_000_000
END_ID = 2
BASE = 50_257  # ids of the vocabulary are smaller
_GRAMMAR = ["n_symbols", "width", "rules", "rule_sizes", "symbols"]
_SHARDS = "part int, block int, n_ids long, doc_ids binary, doc_sizes binary, n_symbols int, width int, rules binary, rule_sizes binary, symbols binary"


def _shard(part: int, block: int, doc_ids: list[int], parts: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    grammar = compress(ids, BASE)
    width = (BASE + len(grammar.rules) - 1).bit_length()
    values = [
        part,
        block,
        len(ids),
        np.array(doc_ids, dtype="<i8").tobytes(),
        np.array([len(p) // 4 for p in parts], dtype="<i8").tobytes(),
        len(grammar.symbols),
        width,
        grammar.rules.astype("<u4").tobytes(),
        grammar.sizes.astype("<u4").tobytes(),
        pack_bits(grammar.symbols, width),
    ]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["part", "block", "n_ids", "doc_ids", "doc_sizes", *_GRAMMAR]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    encoder = byte_encoder(vocabulary)
    end = np.array([end_id], dtype="<u4").tobytes()
    part, block, size = TaskContext.get().partitionId(), 0, 0
    doc_ids: list[int] = []
    parts: list[bytes] = []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts.append(encoder.encode(text.as_py()) + end)
            doc_ids.append(doc_id)
            size += len(parts[-1]) // 4
            if size >= shard_ids:
                yield _shard(part, block, doc_ids, parts)
                block, size, doc_ids, parts = block + 1, 0, [], []
    if parts:
        yield _shard(part, block, doc_ids, parts)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write all documents' ids, each followed by ``end_id``."""
    narrow = docs.select(id_of(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    # by the text, too, as a third of all rows may have one id, or none
    keyed = narrow.withColumn("hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered.select("doc_id", "text").mapInArrow(lambda b: _shards(b, vocabulary, end_id, shard_ids), _SHARDS).write.parquet(path)


def grammar_of(n_symbols: int, width: int, rules: bytes, rule_sizes: bytes, symbols: bytes) -> Grammar:
    pairs = np.frombuffer(rules, dtype="<u4").astype(np.int64).reshape(-1, 2)
    sizes = np.frombuffer(rule_sizes, dtype="<u4").astype(np.int64)
    return Grammar(BASE, pairs, sizes, unpack_bits(symbols, n_symbols, width))


def _some_documents(batches: Iterator[pa.RecordBatch], wanted: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, sizes = np.frombuffer(row["doc_ids"], dtype="<i8"), np.frombuffer(row["doc_sizes"], dtype="<i8")
            at = np.flatnonzero(np.isin(doc_ids, wanted))
            if not len(at):
                continue
            grammar, stops = grammar_of(*[row[c] for c in _GRAMMAR]), np.cumsum(sizes)
            ends = grammar.ends()
            found = [grammar.decode(int(stops[i] - sizes[i]), int(stops[i]), ends).astype(np.int32) for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids[at]), pa.array(sizes[at]), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "n_tokens", "ids"],
            )


def read_documents(spark: SparkSession, path: str, wanted: list[int | None], id_column: str = "doc_id") -> DataFrame:
    """The documents with the ids asked for, null for those without one: n_tokens and ids; unknown ids give no row."""
    ids = [NO_ID if i is None else i for i in wanted]
    rows = spark.read.schema(_SHARDS).parquet(path).select("doc_ids", "doc_sizes", *_GRAMMAR)
    rows = rows.mapInArrow(lambda b: _some_documents(b, ids), "doc_id long, n_tokens long, ids array<int>")
    return rows.select(as_id(F.col("doc_id")).alias(id_column), "n_tokens", "ids")


def _documents(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = grammar_of(*[row[c] for c in _GRAMMAR]).decode().astype("<u4")
            doc_ids = np.frombuffer(row["doc_ids"], dtype="<i8")
            sizes = np.frombuffer(row["doc_sizes"], dtype="<i8")
            starts = np.cumsum(sizes) - sizes
            raw = memoryview(ids.tobytes())
            own = [raw[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            n = len(doc_ids)
            columns = [
                pa.array(doc_ids),
                pa.array([row["part"]] * n, pa.int32()),
                pa.array([row["block"]] * n, pa.int32()),
                pa.array(starts),
                pa.array(sizes),
                pa.array([zlib.crc32(x) for x in own], pa.int64()),
            ]
            names = ["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"]
            if with_ids:
                offsets = pa.array(np.r_[starts, len(ids)].astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True, id_column: str = "doc_id") -> DataFrame:
    """One row per document: start (ids of all documents before it), n_tokens, ids_crc32, and its ids."""
    files = spark.read.schema(_SHARDS).parquet(path)
    kinds = "doc_id long, part int, block int, inside long, n_tokens long, ids_crc32 long"
    kinds += ", ids array<int>" if with_ids else ""
    rows = files.select("part", "block", "doc_ids", "doc_sizes", *_GRAMMAR)
    rows = rows.mapInArrow(lambda b: _documents(b, with_ids), kinds)

    # the order of shards: parts are few, so their totals fit one window; blocks stay in their part
    sizes = files.select("part", "block", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_part"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("before_block"))
    starts = blocks.join(parts, "part")
    return rows.join(starts, ["part", "block"]).select(
        as_id(F.col("doc_id")).alias(id_column),
        (F.col("before_part") + F.col("before_block") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def new_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
