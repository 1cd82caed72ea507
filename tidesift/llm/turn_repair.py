"""Conversation structure repair: the cheapest edits that make roles alternate, by a Viterbi search whose survivors coalesce.

Turns are looked at in the order of turn number (null first), role and text.
The first of these faults of a turn counts: it is blank, its role and text
stood earlier, or its last character ends no sentence. ``survivors`` finds the
edits and their costs.

A conversation of up to ``limit`` rows is one run of a sorted partition, read
as a stream. A longer one is cut into segments by ranges of its order, so no
task reads a whole long conversation to find its edits. Each segment is searched
once from every state it may be entered in, which gives a small table of costs
and, for ties, the order of the letters; a chain through these tables settles
where each segment is entered and left, and a second search per segment emits
its edits. Only the digest of a long conversation's repaired text is a single
stream, as SHA-256 allows no other way; it is read in order and not held.

Defined results
    null role or text   one space: a null text is blank, a null role has to be changed
    null conv_id        one conversation without an id
    null turn           first; left out of ``gaps``
    repeated rows       duplicates of the first one
    equal turns         in the order of role and text
    other roles         by their first letter; an empty role or another letter has to be changed
    empty texts         blank, so deleted; inserted turns are empty, too
    long texts          whole
    empty table         an empty result
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.llm.common import BLANKS, partitions_of
from tidesift.llm.survivors import CUT_OFF, DOOMED, INFINITE, NOTHING, SOUND, STATES, Edits, Survivors, best_end
from tidesift.session import Workspace

LIMIT = 50_000
PIECE = 1 << 20  # characters of repaired text that travel as one row
LEGAL = frozenset(("su", "ua", "au"))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ORDER = ("_c", "_t", "_r", "_x")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _runs(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of each run of equal first ``width`` fields; a run is read as a stream."""
    row = next(rows, None)
    while row is not None:
        key = row[:width]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:width] == key:
                now, row = row, None
                yield now
                row = next(rows, None)

        yield key, run()


class Faults:
    """Reads the turns of one run in order: counts of faults, and each turn's initial and fault."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.kinds = 0
        self.least = self.most = self.turn = self.first = self.last = None
        self.seen: set[bytes] = set()

    def read(self, turn, role: str, text: str, copies: int, again: bool | None) -> Iterator[int]:
        """The fault of each copy of a turn; ``again`` tells whether it stood earlier, None asks this run."""
        seen_before = bool(again)
        if again is None:
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            seen_before = key in self.seen
            self.seen.add(key)
        if turn is not None:
            self.kinds += self.most is None or turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        shown, initial = text.rstrip(BLANKS), role[:1]
        for copy in range(copies):
            self.illegal += self.last is not None and self.last + initial not in LEGAL
            self.first, self.last = initial if self.first is None else self.first, initial
            if not shown:
                self.blank += 1
                yield DOOMED
            elif seen_before or copy:
                self.duplicate += 1
                yield DOOMED
            elif shown[-1] not in ".!?":
                self.truncated += 1
                yield CUT_OFF
            else:
                yield SOUND

    @property
    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.kinds


class Digest:
    """SHA-256 of ``role:text`` joined by line breaks."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def __call__(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.some = True


def _audits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    found = []
    for (conv,), run in _runs(_rows(batches), 1):
        faults, digest = Faults(), Digest()
        edits = Edits(NOTHING, digest)
        search = Survivors(NOTHING, edits)
        for _, turn, role, text, copies in run:
            for fault in faults.read(turn, role, text, copies, None) if copies else ():
                search.feed(role[:1], fault, (role, text))
        cost = search.finish()
        counts = (faults.gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost)
        found.append((conv, *counts, "".join(edits.audit), digest.sha.hexdigest()))
        if len(found) == 1000:
            yield _batch(found, schema)
            found = []
    if found:
        yield _batch(found, schema)


def _turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (conv,), run in _runs(_rows(batches), 1):
        faults, stand, place = Faults(), [], 0
        search = Survivors(NOTHING, Edits(NOTHING, lambda role, text, s=stand: s.append((role, text))))
        for _, turn, role, text, copies in run:
            for fault in faults.read(turn, role, text, copies, None) if copies else ():
                search.feed(role[:1], fault, (role, text))
            if len(stand) >= 1000:
                yield _batch([(conv, place + i, *t) for i, t in enumerate(stand)], schema)
                place += len(stand)
                stand.clear()
        search.finish()
        if stand:
            yield _batch([(conv, place + i, *t) for i, t in enumerate(stand)], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per segment: costs and letter order from every entry to every exit, and what its neighbours have to know."""
    for (conv, segment), run in _runs(_rows(batches), 2):
        faults = Faults()
        searches = [Survivors(entry, lambda letters, row: None) for entry in range(STATES)]
        for _, _, turn, role, text, copies, again in run:
            for fault in faults.read(turn, role, text, copies, again):
                for search in searches:
                    search.feed(role[:1], fault, None)
        counts = [faults.blank, faults.duplicate, faults.truncated, faults.illegal]
        costs, ranks = [c for s in searches for c in s.cost], [r for s in searches for r in s.ranks()]
        yield _batch([(conv, segment, counts, faults.first, faults.last, costs, ranks)], schema)


def chain(costs: list[list[int]], ranks: list[list[int]]) -> tuple[list[int], int]:
    """The state at every border of a conversation's segments, and the cost up to the last one.

    ``costs[i][4 * p + q]`` leads from p to q through segment i. Paths from unlike
    states have unlike letters before the segment, so their order is settled there.
    """
    best, order = [0 if s == NOTHING else INFINITE for s in range(STATES)], [0] * STATES
    back = []
    for cost, rank in zip(costs, ranks, strict=True):
        step, keys = [], []
        for q in range(STATES):
            options = [(best[p] + cost[4 * p + q], order[p], p) for p in range(STATES) if best[p] < INFINITE and cost[4 * p + q] < INFINITE]
            step.append(min(options) if options else (INFINITE, 0, NOTHING))
            keys.append((step[-1][1], rank[4 * step[-1][2] + q]))
        back.append([p for _, _, p in step])
        best = [total for total, _, _ in step]
        alive = sorted(k for k, b in zip(keys, best, strict=True) if b < INFINITE)
        order = [alive.index(k) if b < INFINITE else -1 for k, b in zip(keys, best, strict=True)]
    end = best_end(best, order)
    borders = [end]
    for states in reversed(back):
        borders.append(states[borders[-1]])
    return borders[::-1], best[end]


def _chains(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (conv,), run in _runs(_rows(batches), 1):
        parts = list(run)  # one short row per segment
        borders, _ = chain([p[5] for p in parts], [p[6] for p in parts])
        out, last = [], None
        for i, (_, segment, counts, first, final, _, _) in enumerate(parts):
            counts[3] += last is not None and last + first not in LEGAL
            last = final
            out.append((conv, segment, counts, borders[i], borders[i + 1], i + 1 == len(parts)))
        yield _batch(out, schema)


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The edits of each segment, and the turns that stand, a piece at a time."""
    for (conv, segment), run in _runs(_rows(batches), 2):
        search, stand, size, number = None, [], 0, 0
        for _, _, turn, role, text, copies, again, counts, entry, leave, at_end in run:
            if search is None:
                edits = Edits(entry, lambda r, x, s=stand: s.append((r, x)))
                search, faults = Survivors(entry, edits), Faults()
            for fault in faults.read(turn, role, text, copies, again):
                search.feed(role[:1], fault, (role, text))
                size += len(text)
            if size > PIECE:
                yield _batch([(conv, segment, number, "".join(edits.audit), _structs(stand), 0, [0] * 4)], schema)
                number, size = number + 1, 0
                edits.audit.clear()
                stand.clear()
        cost = search.finish() if at_end else search.close(leave)
        yield _batch([(conv, segment, number, "".join(edits.audit), _structs(stand), cost, counts)], schema)


def _structs(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in turns]


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per long conversation from its pieces in order."""
    for (conv,), run in _runs(_rows(batches), 1):
        digest, audit, cost, counts = Digest(), [], 0, [0] * 4
        for _, _, _, letters, turns, part, some in run:
            audit.append(letters)
            cost += part
            counts = [a + b for a, b in zip(counts, some, strict=True)]
            for turn in turns:
                digest(turn["role"], turn["text"])
        yield _batch([(conv, *counts, cost, "".join(audit), digest.sha.hexdigest())], schema)


def _arrow(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def _mapped(df: DataFrame, kernel, fields: str, conv_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("_c", conv_type), *T.StructType.fromDDL(fields).fields])
    arrow = _arrow(schema)
    return df.mapInArrow(lambda batches: kernel(batches, arrow), schema)


class _Source:
    """Turns with own column names, short conversations and long ones apart."""

    def __init__(self, turns: DataFrame, names: tuple[str, str, str, str], copies: Column | None, limit: int):
        conv, turn, role, text = names
        blank = F.lit(" ")
        self.rows = turns.select(
            F.col(conv).alias("_c"),
            F.col(turn).cast("long").alias("_t"),
            F.coalesce(F.col(role).cast("string"), blank).alias("_r"),
            F.coalesce(F.col(text).cast("string"), blank).alias("_x"),
            (F.lit(1) if copies is None else copies).cast("long").alias("_n"),
        )
        self.kind = self.rows.schema["_c"].dataType
        self.limit = limit
        self.space = Workspace(turns.sparkSession, "turn-repair")
        sizes = self.rows.groupBy("_c").agg(F.sum(F.greatest("_n", F.lit(1))).alias("size"))
        self.long = self.space.keep(sizes.filter(F.col("size") > limit))
        self.some_long = not self.long.isEmpty()

    def _same(self, other: DataFrame):
        return self.rows["_c"].eqNullSafe(other["_c"])

    def short(self) -> DataFrame:
        rows = self.rows.join(self.long, self._same(self.long), "left_anti") if self.some_long else self.rows
        return rows.repartition(partitions_of(rows), "_c").sortWithinPartitions(*_ORDER)

    def segments(self) -> DataFrame:
        """Rows of long conversations, equal ones as one with their number, cut into segments by their order."""
        total = self.long.agg(F.sum("size")).first()[0]
        rows = self.rows.join(self.long, self._same(self.long), "left_semi").filter("_n > 0")
        rows = rows.groupBy(*_ORDER).agg(F.sum("_n").alias("_n"))
        stood = F.struct(F.col("_t").isNotNull().alias("known"), F.col("_t").alias("turn"))
        keyed = rows.withColumn("_k", F.sha2(F.concat_ws(":", F.length("_r"), "_r", "_x"), 256)).withColumn("_at", stood)
        keyed = self.space.keep(keyed)
        first = keyed.groupBy("_c", "_r", "_k").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).filter("_first < _last").alias("f")
        k = keyed.alias("k")
        same = F.col("k._c").eqNullSafe(F.col("f._c")) & (F.col("k._r") == F.col("f._r")) & (F.col("k._k") == F.col("f._k"))
        again = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False)).alias("_again")
        judged = k.join(first, same, "left").select(*[F.col(f"k.{c}") for c in _ORDER], "_n", again)
        # the first characters of a text bound a range well enough and keep the bounds small
        ranges = [F.col("_c"), F.col("_t"), F.col("_r"), F.substring("_x", 1, 64)]
        cut = judged.repartitionByRange(-(-total // self.limit) + 1, *ranges)
        kept = self.space.keep(cut.withColumn("_s", F.spark_partition_id()))
        return kept.select("_c", "_s", "_t", "_r", "_x", "_n", "_again")

    def by_segment(self, df: DataFrame) -> DataFrame:
        return df.repartition(partitions_of(df), "_c", "_s").sortWithinPartitions("_c", "_s", "_t", "_r", "_x")

    def pieces(self) -> tuple[DataFrame, DataFrame]:
        """Repaired pieces of long conversations, and their gaps."""
        cut = self.segments()
        summed = _mapped(
            self.by_segment(cut), _summaries, "_s int, counts array<long>, first string, last string, costs array<long>, ranks array<long>", self.kind
        )
        summed = self.space.keep(summed)
        in_order = summed.repartition(partitions_of(summed), "_c").sortWithinPartitions("_c", "_s")
        entries = _mapped(in_order, _chains, "_s int, counts array<long>, entry int, leave int, at_end boolean", self.kind)
        e, k = self.space.keep(entries).alias("e"), cut.alias("k")
        both = k.join(e, F.col("k._c").eqNullSafe(F.col("e._c")) & (F.col("k._s") == F.col("e._s")))
        told = both.select("k.*", "counts", "entry", "leave", "at_end")
        repaired = _mapped(
            self.by_segment(told), _pieces, "_s int, number int, audit string, turns array<struct<role: string, text: string>>, cost long, counts array<long>", self.kind
        )
        kinds = cut.groupBy("_c", "_t").agg(F.lit(1).alias("one")).groupBy("_c")
        gaps = kinds.agg((F.max("_t") - F.min("_t") + 1 - F.count("_t")).alias("gaps"))
        return self.space.keep(repaired), gaps


def repair(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    copies: Column | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per conversation: faults, cost and letters of the cheapest edits, digest of the repaired turns.

    ``copies`` tells how often a row stands there; a conversation whose rows all
    stand there no times has no faults and an empty audit.
    """
    source = _Source(turns, (conv_column, turn_column, role_column, text_column), copies, limit)
    counts = [f"{c} long" for c in COUNTS]
    found = _mapped(source.short(), _audits, ", ".join([*counts, "audit string", "repaired_sha256 string"]), source.kind)
    if source.some_long:
        pieces, gaps = source.pieces()
        in_order = pieces.repartition(partitions_of(pieces), "_c").sortWithinPartitions("_c", "_s", "number")
        joined = _mapped(in_order, _joined, ", ".join([*counts[1:], "audit string", "repaired_sha256 string"]), source.kind)
        whole = source.long.alias("l").join(joined.alias("j"), F.col("l._c").eqNullSafe(F.col("j._c")), "left")
        whole = whole.join(gaps.alias("g"), F.col("l._c").eqNullSafe(F.col("g._c")), "left")
        none = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
        nothing = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
        found = found.unionByName(whole.select("l._c", *none, F.coalesce("audit", F.lit("")).alias("audit"), nothing))
    return found.withColumnRenamed("_c", conv_column)


def repaired_turns(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """The turns of the repaired conversations: conversation, place (rising in order), role, text."""
    source = _Source(turns, (conv_column, turn_column, role_column, text_column), None, limit)
    found = _mapped(source.short(), _turns, "place long, role string, text string", source.kind)
    if source.some_long:
        pieces, _ = source.pieces()
        placed = pieces.select("_c", "_s", "number", F.posexplode("turns").alias("i", "turn"))
        piece = F.col("_s").cast("long") * (1 << 40) + F.col("number").cast("long") * (1 << 20) + F.col("i")
        found = found.unionByName(placed.select("_c", piece.alias("place"), "turn.role", "turn.text"))
    return found.select(F.col("_c").alias(conv_column), "place", F.col("role").alias(role_column), F.col("text").alias(text_column))
