"""Packing of tokenized documents into sequences of fixed capacity.

One pass tokenizes the texts and keeps a narrow row per piece: its length, the
task that made it and its place among that task's pieces of equal length. The
length histogram (at most ``capacity`` rows) is packed on the driver by the
configuration LP. Prefix sums of the tasks' counts give every piece a rank
among its length, and the plan turns (length, rank) into sequence and offset
without a sort and without bringing a length together in one task.

Defined results
    null text      an empty document: its end id alone
    null doc_id    kept, as null
    equal rows     packed once each
    long texts     cut into pieces of ``capacity``; the first may be shorter
    empty table    no sequences
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidesift.llm.byte_tokens import byte_encoder
from tidesift.llm.common import as_id, id_of, int64, text_of
from tidesift.llm.configuration_lp import Group, pack_histogram
from tidesift.session import Workspace

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, place long"


def cut(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``total`` ids: full ones, after a shorter first one if needed."""
    full, first = divmod(total, capacity)
    return [first] * bool(first) + [capacity] * full


def _piece_rows(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = byte_encoder(vocabulary)
    end = np.array([end_id], dtype="<u4").tobytes()
    task = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, dtype=np.int64)
    for batch in batches:
        ids, pieces, starts, lengths, crcs, places = [], [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = memoryview(encoder.encode(text.as_py()) + end)
            start = 0
            for piece, length in enumerate(cut(len(tokens) // 4, capacity)):
                ids.append(doc_id)
                pieces.append(piece)
                starts.append(start)
                lengths.append(length)
                crcs.append(zlib.crc32(tokens[4 * start : 4 * (start + length)]))
                places.append(int(seen[length]))
                seen[length] += 1
                start += length
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(pieces, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int32()),
                pa.array(crcs, pa.int64()),
                pa.array([task] * len(ids), pa.int32()),
                pa.array(places, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
        )


def slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """The plan as sorted slots: pieces of one length, from rank ``first`` on, go ``times`` to a sequence.

    Its size depends on the number of groups alone, which the capacity bounds.
    """
    rows, sequence = [], 0
    for copies, items in groups:
        offset = 0
        for length, times in items:
            rows.append((length, times, copies, sequence, offset))
            offset += length * times
        sequence += copies
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.argsort(table[:, 0], kind="stable")]
    size = table[:, 1] * table[:, 2]
    before = np.cumsum(size) - size
    heads = np.r_[True, table[1:, 0] != table[:-1, 0]] if len(table) else np.zeros(0, bool)
    first = before - np.maximum.accumulate(np.where(heads, before, 0)) if len(table) else before
    return {
        "key": (table[:, 0] << 48) | first,
        "first": first,
        "times": table[:, 1],
        "sequence": table[:, 3],
        "offset": table[:, 4],
    }


def locate(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces given by length and rank among that length."""
    at = np.searchsorted(plan["key"], (length << 48) | rank, side="right") - 1
    copy, slot = np.divmod(rank - plan["first"][at], plan["times"][at])
    return plan["sequence"][at] + copy, plan["offset"][at] + slot * length


def _placed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = int64(batch.column(3)), int64(batch.column(5))
        sequence, offset = locate(shared.value, length, rank)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    narrow = docs.select(id_of(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    pieces = space.keep(narrow.mapInArrow(lambda b: _piece_rows(b, vocabulary, capacity, end_id), _PIECES))

    counts = space.keep(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(pack_histogram(histogram, capacity)))

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    placed = ranked.mapInArrow(
        lambda b: _placed(b, shared),
        "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long",
    )
    return placed.select(
        as_id(F.col("doc_id")).alias(id_column),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        "offset",
    )
