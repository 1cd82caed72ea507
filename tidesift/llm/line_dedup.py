"""Line deduplication by range-partitioned hashes with a secondary sort.

A line's key is the stripped line, A-Z lower-cased. Keys of at least 20 code
points that stand in at least 3 documents lose their lines in all documents but
the one with the largest id.

Every long line becomes a row (128-bit hash, document, position). Rows are
range-partitioned by hash and document and sorted by hash, document from the
largest on, and position; a hash held by a third of all documents thus spreads
over many ranges. A task streams its range: the first document met keeps the
line, and from the third one on all but the first lose it. Only the first and
the last hash of a range may go on in another one; their rows stay open, and a
table of at most two hashes per range settles them. What is lost comes back as
one compressed bitmap per document; texts are never sorted.

Defined results
    null text      one empty line
    null doc_id    one document, lower than any other
    equal ids      one document: a line lost in one of its rows is lost in all of
                   them; rows with equal text share one bitmap
    long texts     whole; a line is a hash in every shuffle
    empty table    no bitmaps
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.common import as_id, id_of, int64, text_of
from tidesift.session import Workspace

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = b" \t\n\x0b\x0c\r"
_LINES = "h1 long, h2 long, doc long, twin long, pos int"
LOST, OPEN, WITNESS = 0, 1, 2


def _line_rows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    for batch in batches:
        docs, texts = int64(batch.column(0)), batch.column(1)
        for low in range(0, len(docs), 1024):
            digests, doc, twin, pos = [], [], [], []
            for i in range(low, min(low + 1024, len(docs))):
                raw = texts[i].as_py().encode()
                own = np.uint64(xxh3_64_intdigest(raw)).astype(np.int64)
                for p, line in enumerate(raw.lower().split(b"\n")):
                    key = line.strip(BLANKS)
                    size = len(key)
                    # a code point takes four bytes at most
                    if size >= 4 * min_chars or (size >= min_chars and len(key.decode()) >= min_chars):
                        digests.append(xxh3_128_digest(key))
                        doc.append(docs[i])
                        twin.append(own)
                        pos.append(p)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            columns = [halves[:, 0], halves[:, 1], np.array(doc, np.int64), np.array(twin, np.int64), np.array(pos, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "doc", "twin", "pos"])


class _Range:
    """One sorted range, streamed: columns h1, h2, doc, twin, pos, settled (1: only there as a witness)."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.carry = np.zeros((0, 6), dtype=np.int64)
        self.first: tuple[int, int] | None = None

    def feed(self, rows: np.ndarray, last: bool) -> list[tuple[int, np.ndarray]]:
        """(kind, rows) that can be told now."""
        rows = np.concatenate([self.carry, rows])
        if not len(rows):
            return []
        if self.first is None:
            self.first = int(rows[0, 0]), int(rows[0, 1])
        new_key = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        new_doc = new_key | np.r_[True, rows[1:, 2] != rows[:-1, 2]]
        key = np.cumsum(new_key) - 1
        docs = np.cumsum(new_doc)
        rank = docs - docs[new_key][key]  # 0: the first document that holds the key
        found = np.maximum.reduceat(rank, np.flatnonzero(new_key)) + 1
        is_first = (rows[:, 0] == self.first[0]) & (rows[:, 1] == self.first[1])
        is_last = key == key[-1]
        fresh = rows[:, 5] == 0
        often = found[key] >= self.min_docs
        told = [(OPEN, rows[is_first & fresh]), (LOST, rows[~is_first & fresh & often & (rank > 0)])]
        tail = ~is_first & is_last
        if last:
            # the last key may go on in the next range
            known = found[-1] >= self.min_docs
            if known:
                told.append((WITNESS, rows[tail & new_doc & (rank < self.min_docs)]))
            else:
                told.append((OPEN, rows[tail]))
            self.carry = rows[:0]
        elif found[-1] >= self.min_docs:
            self.carry = rows[tail & new_doc & (rank < self.min_docs)].copy()
            self.carry[:, 5] = 1
        else:
            # too few documents so far: all rows wait, those of fewer than ``min_docs`` documents
            self.carry = rows[tail].copy()
        return [(kind, part) for kind, part in told if len(part)]


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    state = _Range(min_docs)

    def told(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        for kind, part in state.feed(rows, last):
            columns = [pa.array(part[:, i]) for i in range(4)]
            columns += [pa.array(part[:, 4].astype(np.int32)), pa.array(np.full(len(part), kind, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "twin", "pos", "kind"])

    for batch in batches:
        rows = np.stack([*[int64(batch.column(i)) for i in range(5)], np.zeros(batch.num_rows, np.int64)], axis=1)
        yield from told(rows, False)
    yield from told(np.zeros((0, 6), dtype=np.int64), True)


def lost_lines(docs: DataFrame, space: Workspace, id_column: str, text_column: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, twin, pos) of every line that is lost; twin is the hash of the row's text."""
    narrow = docs.select(id_of(id_column).alias("doc"), text_of(text_column).alias("text"))
    # kept, as drawing the range bounds reads the rows once more
    lines = space.keep(narrow.mapInArrow(lambda b: _line_rows(b, min_chars), _LINES))
    order = ["h1", "h2", F.col("doc").desc(), "twin", "pos"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    told = space.keep(ranged.mapInArrow(lambda b: _stream(b, min_docs), _LINES + ", kind int"))
    space.free(lines)
    edges = (
        told.filter(F.col("kind") != LOST)
        .groupBy("h1", "h2", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("holder"))
        .filter(F.col("docs") >= min_docs)
    )
    # two hashes a range at most, whatever the input: open rows need not be shuffled by hash
    settled = told.filter(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).filter("doc <> holder")
    return told.filter(F.col("kind") == LOST).select("doc", "twin", "pos").union(settled.select("doc", "twin", "pos"))


def bitmap_of(lost: np.ndarray) -> bytes:
    """Compressed keep bits up to the last lost line, most significant bit first; later lines stay."""
    keep = np.ones((int(lost.max()) // 8 + 1) * 8, dtype=np.uint8)
    keep[lost] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def keep_bits(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each line of a document stays."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [bitmap_of(np.array(p, dtype=np.int64)) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc", "twin", "bitmap"])


def keep_bitmaps(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(doc, twin, bitmap) of every document that loses a line; ``keep_bits`` reads the bitmap.

    ``doc`` is ``id_of`` the document, ``twin`` the XXH3 hash of its text. The
    positions of one document are gathered, not more than it has lines.
    """
    space = Workspace(docs.sparkSession, "line-dedup")
    lost = lost_lines(docs, space, id_column, text_column, min_chars, min_docs)
    places = lost.groupBy("doc", "twin").agg(F.collect_list("pos").alias("places"))
    return places.mapInArrow(_bitmaps, "doc long, twin long, bitmap binary")


def _applied(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, out = [], [], []
        for text, bitmap in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_py().encode()
            n_lines.append(raw.count(b"\n") + 1)
            n_dropped.append(0)
            if bitmap is not None:
                keep = keep_bits(bitmap, n_lines[-1])
                raw = b"\n".join([x for x, k in zip(raw.split(b"\n"), keep, strict=True) if k])
                n_dropped[-1] = int((~keep).sum())
            out.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode())
        columns = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_lines", "n_dropped", "kept"])


def _text_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        twins = np.array([xxh3_64_intdigest(t.as_py().encode()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(twins.view(np.int64))], names=["doc", "text", "twin"])


def deduplicate_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: bool = False,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """One row per document: n_lines, n_dropped, and the text left (``digest``: its SHA-256)."""
    bitmaps = keep_bitmaps(docs, id_column, text_column, min_chars, min_docs)
    narrow = docs.select(id_of(id_column).alias("doc"), text_of(text_column).alias("text"))
    marked = narrow.mapInArrow(_text_hash, "doc long, text string, twin long").join(bitmaps, ["doc", "twin"], "left")
    done = marked.select("doc", "text", "bitmap").mapInArrow(
        lambda b: _applied(b, digest), "doc long, n_lines long, n_dropped long, kept string"
    )
    name = "kept_sha256" if digest else "kept_text"
    return done.select(as_id(F.col("doc")).alias(id_column), "n_lines", "n_dropped", F.col("kept").alias(name))
