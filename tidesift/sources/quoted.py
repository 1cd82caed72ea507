"""Delimited files whose quoted fields hold line breaks, read by many tasks.

Where a record ends depends on whether a line begins inside quotes, and that
depends on all lines before it. So each byte range of a file (a split of Spark's
text reader) is read once under both assumptions, which tells the state at its
end for either state at its start: two bits a range. Chaining these along each
file gives every range its true start state, and in a second pass each range
cuts its own records. A record that crosses ranges comes as one fragment per
range; only fragments are shuffled, at most two a range.

A quote opens a field only at its very beginning; elsewhere it is a character. A
quote inside a quoted field is doubled, or closes it before the separator or the
end of the line; followed by anything else it makes the field an unquoted one,
which ends at the next separator or line end. Lines end in ``\\n``, or in ``\\r\\n`` if
the first line of the file does; then it is one ``\\n`` inside quotes, too. Compressed files are one range, as they
cannot be split.

The table of ranges has one row per file and split, some 30 MB for 100 TB of
large files. It is broadcast, as a shuffle would lose the order of lines; more
than ``MOST_RANGES`` rows are refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesift.session import Workspace

QUOTE = b'"'
MOST_RANGES = 2_000_000
WHOLE, REST, OPEN = 0, 1, 2  # a record; the end or middle of one; the beginning of one


def can_split(encoding: str) -> bool:
    """Whether line breaks, quotes and separators are single ASCII bytes in this charset."""
    marks = '\r\n",;\t|'
    try:
        return marks.encode(encoding) == marks.encode("ascii")
    except LookupError:
        return False


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether the end of a line is inside quotes, given its start."""
    line = line[:-1] if line.endswith(b"\r") else line
    at = 0
    while True:
        if not inside:
            if not line.startswith(QUOTE, at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        end = line.find(QUOTE, at)
        if end < 0:
            return True
        if line.startswith(QUOTE, end + 1):
            at, inside = end + 2, True
            continue
        end = line.find(sep, end + 1)  # right behind the quote, or the end of what counts as unquoted
        if end < 0:
            return False
        at, inside = end + len(sep), False


def _ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of each run of equal first ``size`` fields, rows read as a stream."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    source = rows()
    row = next(source, None)
    while row is not None:
        key = row[:size]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:size] == key:
                now = row
                row = next(source, None)
                yield now

        yield key, run()


def _end_states(sep: bytes, encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (path, start), rows in _ranges(batches, 2):
            outside, within, first = False, True, None
            for *_, line in rows:
                if first is None:
                    first = line
                if QUOTE in line:
                    outside, within = ends_inside(line, outside, sep), ends_inside(line, within, sep)
            head = _text(first, encoding) if start == 0 else None
            found.append((path, start, int(outside), int(within), head, first.endswith(b"\r") if start == 0 else None))
        if found:
            columns = list(zip(*found, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            names = ["path", "start", "outside", "within", "head", "crlf"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _text(record: bytes, encoding: str) -> str:
    return (record[:-1] if record.endswith(b"\r") else record).decode(encoding, "replace")


def _records(sep: bytes, encoding: str):
    names = ["path", "start", "grp", "kind", "first", "record"]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for (path, start), rows in _ranges(batches, 2):
            held: list[bytes] = []
            inside = kind = None
            first = start == 0
            for _, _, grp, state, crlf, line in rows:
                if inside is None:
                    inside = bool(state)
                    kind = REST if inside else WHOLE
                held.append(line[:-1] if crlf and line.endswith(b"\r") else line)
                if QUOTE in line:
                    inside = ends_inside(line, inside, sep)
                if inside:
                    continue
                record = held[0] if len(held) == 1 else b"\n".join(held)
                out.append((path, start, grp, kind, first, record.decode(encoding, "replace")))
                size += len(record)
                held, kind, first = [], WHOLE, False
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if held:
                # goes on in the next range
                text = b"\n".join(held).decode(encoding, "replace")
                out.append((path, start, grp, REST if kind == REST else OPEN, first, text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


class QuotedFiles:
    """The records of delimited files; ``heads`` are the different first lines if the files have headers."""

    def __init__(
        self,
        spark: SparkSession,
        paths: Sequence[str],
        sep: str,
        encoding: str,
        pattern: str | None = None,
        recursive: bool = False,
    ):
        self.space = Workspace(spark, "quoted")
        self.sep, self.encoding = sep.encode("ascii"), encoding
        reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
        self.lines = reader.text(list(paths)).select(*place, F.col("value").cast("binary").alias("line"))
        found = self.lines.mapInArrow(_end_states(self.sep, encoding), "path string, start long, outside int, within int, head string, crlf boolean")
        self.ranges = self.space.keep(self._states(self.space.keep(found)))

    @staticmethod
    def _states(ranges: DataFrame) -> DataFrame:
        """(path, start, state, head, crlf): the state at the start of each range.

        The state after a range is fixed, as before it, or the opposite. So it is
        the last fixed one, turned once for each opposite since.
        """
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        turns = F.coalesce(F.sum(((F.col("outside") == 1) & (F.col("within") == 0)).cast("int")).over(before), F.lit(0))
        told = ranges.withColumn("turns", turns)
        fixed = F.when(F.col("outside") == F.col("within"), F.struct(F.col("outside").alias("state"), F.col("turns").alias("turns")))
        told = told.withColumn("fixed", fixed).withColumn("fixed", F.last("fixed", ignorenulls=True).over(before))
        state = F.coalesce("fixed.state", F.lit(0)) + F.col("turns") - F.coalesce("fixed.turns", F.lit(0))
        crlf = F.max("crlf").over(Window.partitionBy("path")).alias("crlf")
        return told.select("path", "start", (state % 2).cast("int").alias("state"), "head", crlf)

    def heads(self) -> list[str]:
        """The different header lines, sorted; as many as there are kinds of files."""
        return sorted(r["head"] for r in self.ranges.filter("head IS NOT NULL").select("head").distinct().collect())

    def records(self, groups: dict[str, int] | None = None) -> DataFrame:
        """(path, grp, record) of all records; with ``groups``, header line to number, headers are left out."""
        ranges = self.ranges.select("path", "start", "state", "crlf").withColumn("grp", F.lit(0))
        if groups is not None:
            spark = self.lines.sparkSession
            numbers = spark.createDataFrame(list(groups.items()), "head string, grp int")
            files = self.ranges.filter("start = 0").join(F.broadcast(numbers), "head").select("path", "grp")
            ranges = ranges.drop("grp").join(files, "path")
        ranges = self.space.keep(ranges)
        if ranges.count() > MOST_RANGES:
            raise ValueError(f"more than {MOST_RANGES} ranges; read fewer files at a time")
        # a path and three numbers a row; lines stay in the order of their file
        told = self.lines.join(F.broadcast(ranges), ["path", "start"]).select("path", "start", "grp", "state", "crlf", "line")
        cut = told.mapInArrow(_records(self.sep, self.encoding), "path string, start long, grp int, kind int, first boolean, record string")
        cut = self.space.keep(cut)
        parts = cut.filter(F.col("kind") != WHOLE)
        # an open record is owned by the range it begins in; the rest of a range's first record comes before its open one
        upto = Window.partitionBy("path").orderBy("start", "kind")
        owner = F.last(F.when(F.col("kind") == OPEN, F.col("start")), ignorenulls=True).over(upto)
        pieces = parts.withColumn("owner", owner).groupBy("path", "grp", "owner")
        joined = pieces.agg(
            F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"), F.max("first").alias("first")
        ).select("path", "grp", "first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
        every = cut.filter(F.col("kind") == WHOLE).select("path", "grp", "first", "record").union(joined)
        if groups is not None:
            every = every.filter(~F.col("first"))
        mark = F.col("first") & F.startswith("record", F.lit("﻿"))
        record = F.when(mark, F.substring("record", 2, 1 << 30)).otherwise(F.col("record")).alias("record")
        return every.select("path", "grp", record).filter(F.col("record") != "")
