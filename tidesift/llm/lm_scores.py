"""Language-model scores of whole texts.

Tokens are words, A-Z lower-cased, and one end per text. The event space is that
of the base model: every word of the training texts, the end, and unseen words.
A token's unit is the end, one of the most frequent words, or a class that the
word's last letters choose. The log-bilinear model gives the unit's normalised
probability from the units before it; inside a class a word has its share of
the class's training tokens, less an absolute discount that goes to the class's
unseen words.

All training texts are counted, and all train the model: tasks train on their
texts, a round ends by averaging the tasks' parameters. Counts are joined by
word; only words above a count that at most ``HEAD_WORDS`` words reach travel
to all tasks, so no word of the join is frequent.

Defined results
    null text      an empty text: the end alone
    null doc_id    in fold 0, so a training text
    equal rows     counted and scored each
    long texts     whole
    no training text   all counts 0; units and words are spread evenly
    empty table    an empty result
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.common import fold_of, int64, shared_value, text_of
from tidesift.llm.common import share as broadcast_of
from tidesift.llm.log_bilinear import UNITS, Model, Trainer, start, windows
from tidesift.session import Workspace

FOLDS, HELD_OUT = 5, 1
HEAD_WORDS = 100_000
PIECE = 8 << 20  # bytes of text that are split into words together
END_UNIT, SHORT_LIST, CLASSES = 0, 127, 128
ROUNDS = 3
TOKENS = 200_000  # tokens that train together
GROUPS = 32
CACHED = 500_000


def pieces_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut behind every text that passes another ``PIECE`` bytes."""
    for batch in batches:
        sizes = int64(pc.binary_length(batch.column(column)))
        begun = (np.cumsum(sizes) - sizes) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(begun)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(low, high - low)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every word its place in the table of distinct words and its text's row; the table, which may hold the empty word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    encoded = pc.dictionary_encode(lists.flatten())
    places, words = int64(encoded.indices), encoded.dictionary.cast(pa.binary())
    rows = np.repeat(np.arange(len(texts)), int64(pc.list_value_length(lists)))
    # blanks at the ends of a text
    empty = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:
        filled = places != empty
        places, rows = places[filled], rows[filled]
    return places, rows, words


def class_of(word: bytes) -> int:
    """A word's class unit, by its last two characters."""
    tail = word[-2:]
    if not tail.isascii():
        tail = word.decode(errors="replace")[-2:].encode()
    return UNITS - CLASSES + zlib.crc32(tail) % CLASSES


def classes_of(words: pa.Array) -> np.ndarray:
    """``class_of`` of an array of words, found once for every ending."""

    def by_ending(some: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        tails = pc.dictionary_encode(pc.binary_slice(some, -size))
        listed, places = tails.dictionary.to_pylist(), int64(tails.indices)
        found = np.array([class_of(t) for t in listed], dtype=np.int32)
        return found[places], np.array([t.isascii() for t in listed], dtype=bool)[places]

    classes, plain = by_ending(words, 2)
    if not plain.all():  # two characters have up to eight bytes
        classes[~plain] = by_ending(words.filter(pa.array(~plain)), 8)[0]
    return classes


@dataclass
class Counts:
    """Corpus statistics of bounded size."""

    tokens: int  # N
    types: int  # V
    ends: int
    short: dict[bytes, int] = field(default_factory=dict)  # word -> unit
    head: dict[bytes, int] = field(default_factory=dict)  # word -> count
    unit_counts: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))  # log10 share of unseen words in their class

    def base(self, count: int) -> float:
        return log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def unit(self, word: bytes) -> int:
        return self.short.get(word) or class_of(word)

    def within(self, word: bytes, count: int) -> float:
        """log10 of the word's share of its unit."""
        if word in self.short:
            return 0.0
        u = class_of(word)
        return log10((count - self.discounts[u]) / self.unit_counts[u]) if count else float(self.unseen[u])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces_of(batches, 0):
        places, _, words = split_words(piece.column(0))
        n = np.bincount(places, minlength=len(words))
        words, n = words.filter(pa.array(n > 0)), n[n > 0]
        yield pa.RecordBatch.from_arrays([words, pa.array(classes_of(words)), pa.array(n)], names=["word", "cls", "n"])


def gather_counts(counts: DataFrame, ends: int) -> Counts:
    """Bounded statistics from the full table of counts (word, cls, n)."""
    bucket = F.floor(F.log2("n") * 8)
    # at most some hundred rows: logarithms of counts
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    types, tokens = sum(r["words"] for r in sizes), sum(r["n"] for r in sizes)
    found = Counts(tokens + ends, types + bool(ends), ends)
    least, taken = None, 0
    for r in sorted(sizes, key=lambda r: -r["b"]):
        taken += r["words"]
        if taken > HEAD_WORDS:
            break
        least = r["b"]
    if least is not None:
        found.head = {bytes(r["word"]): r["n"] for r in counts.filter(bucket >= least).select("word", "n").collect()}
    top = sorted(found.head, key=lambda w: (-found.head[w], w))[:SHORT_LIST]
    found.short = {w: i + 1 for i, w in enumerate(top)}
    classes = counts.groupBy("cls").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")
    )
    listed = Counter(class_of(w) for w in top)
    for r in classes.collect():
        u = r["cls"]
        n = r["n"] - sum(found.head[w] for w in top if class_of(w) == u)
        words = r["words"] - listed[u]
        d = min(max(r["ones"] / max(r["ones"] + 2 * r["twos"], 1), 0.1), 0.9)
        found.unit_counts[u], found.discounts[u] = n, d
        found.unseen[u] = log10(d * words / n) if words else 0.0
    for w, u in found.short.items():
        found.unit_counts[u] = found.head[w]
    found.unit_counts[END_UNIT] = ends
    return found


class _Known(dict):
    """Word -> number; by number the word and its unit, and for head words base and within."""

    def __init__(self, counts: Counts):
        super().__init__()
        self.counts = counts
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.words: list[bytes] = []
        self.unit, self.head = np.zeros(1024, dtype=np.uint8), np.zeros(1024, dtype=bool)
        self.base, self.within = np.zeros(1024), np.zeros(1024)

    def trim(self) -> None:
        if len(self) >= CACHED:
            self._empty()

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words; new words are entered together."""
        listed = words.to_pylist()
        found = np.fromiter(map(self.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        counts, fresh, low = self.counts, [listed[i] for i in new], len(self.words)
        high = low + len(fresh)
        while high > len(self.unit):
            for name in ("unit", "head", "base", "within"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.unit[low:high] = classes_of(words.take(pa.array(new)))
        for i, (word, n) in enumerate(zip(fresh, map(counts.head.get, fresh), strict=True), low):
            if n:
                self.unit[i], self.head[i] = counts.short.get(word, self.unit[i]), True
                self.base[i], self.within[i] = counts.base(n), counts.within(word, n)
        self.words += fresh
        found[new] = np.arange(low, high)
        self.update(zip(fresh, range(low, high), strict=True))
        return found

    def __missing__(self, word: bytes) -> int:
        return int(self.numbers(pa.array([word], pa.binary()))[0])


def _encoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Units of every text, sums over its head words, and its other words."""
    counts: Counts = shared_value(shared)
    part, row = TaskContext.get().partitionId() << 40, 0
    known = _Known(counts)
    end_base = counts.base(counts.ends)
    kinds = [pa.binary(), pa.float64(), pa.int64()]
    for piece in pieces_of(batches, 2):
        known.trim()
        places, rows, words = split_words(piece.column(2))
        n, types = piece.num_rows, max(len(words), 1)
        seen = known.numbers(words)
        unit, is_head = known.unit[seen], known.head[seen][places]
        lengths = np.bincount(rows, minlength=n) + 1
        borders = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        units = np.full(borders[-1], END_UNIT, dtype=np.uint8)
        units[np.arange(len(places)) + rows] = unit[places]
        # a word once per text, so that the join needs no aggregation before it
        pairs, times = np.unique(rows[~is_head] * types + places[~is_head], return_counts=True)
        text, word = np.divmod(pairs, types)
        rare = [words.take(pa.array(word)), pa.array(counts.unseen[unit[word]]), pa.array(times)]
        others = pa.StructArray.from_arrays([v.cast(t) for v, t in zip(rare, kinds, strict=True)], names=["word", "unseen", "times"])
        out = {
            "doc_id": piece.column(0),
            "held_out": piece.column(1),
            "rid": pa.array(part | (row + np.arange(n))),
            "n_tokens": pa.array(lengths),
            "units": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(borders), pa.py_buffer(units)]),
            "base": pa.array(np.bincount(rows, known.base[seen][places], n) + end_base, pa.float64()),
            "within": pa.array(np.bincount(rows, known.within[seen][places], n), pa.float64()),
            "known": pa.array(np.bincount(rows[is_head], minlength=n) + (counts.ends > 0)),
            "rest": pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), others),
        }
        row += n
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _batches_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of batches of about ``TOKENS`` tokens."""
    for batch in batches:
        sequences, low, size = [], 0, 0
        for i, units in enumerate(batch.column(column)):
            sequences.append(np.frombuffer(units.as_py(), dtype=np.uint8))
            size += len(sequences[-1])
            if size >= TOKENS or i + 1 == batch.num_rows:
                yield batch.slice(low, i + 1 - low), sequences
                sequences, low, size = [], i + 1, 0


def _trained(batches: Iterator[pa.RecordBatch], shared, turn: int) -> Iterator[pa.RecordBatch]:
    flat, unit_counts = shared.value
    task = TaskContext.get().partitionId()
    trainer = Trainer(Model.of(flat), unit_counts, 1000 * turn + task)
    seen = 0
    for _, sequences in _batches_of(batches, 0):
        contexts, targets = windows(sequences, END_UNIT)
        trainer.feed(contexts, targets)
        seen += len(targets)
    if seen:
        parameters = trainer.model.flat().astype(np.float64).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task % GROUPS]), pa.array([float(seen)]), pa.array([parameters], pa.binary())], names=["grp", "weight", "parameters"]
        )


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    total, weight = 0.0, group["weight"].sum()
    for w, raw in zip(group["weight"], group["parameters"], strict=True):
        total = total + w / weight * np.frombuffer(raw)
    return pd.DataFrame({"weight": [weight], "parameters": [total.tobytes()]})


def train(encoded: DataFrame, unit_counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Each round trains on its share of the texts; together the rounds cover all training texts once."""
    context = encoded.sparkSession.sparkContext
    model = start(unit_counts)
    texts = encoded.filter(~F.col("held_out"))
    for turn in range(rounds):
        shared = context.broadcast((model.flat(), unit_counts))
        share = texts.filter(F.pmod(F.xxhash64("rid"), F.lit(rounds)) == turn).select("units")
        trained = share.mapInArrow(lambda b, s=shared, t=turn: _trained(b, s, t), "grp long, weight double, parameters binary")
        parts = trained.groupBy("grp").applyInPandas(_averaged, "weight double, parameters binary").collect()
        if parts:
            weight = sum(p["weight"] for p in parts)
            parts = sorted(parts, key=lambda p: (p["weight"], bytes(p["parameters"])))
            model = Model.of(sum(p["weight"] / weight * np.frombuffer(p["parameters"]) for p in parts))
    return model


def _unit_scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = Model.of(shared.value)
    for piece, sequences in _batches_of(batches, 1):
        contexts, targets = windows(sequences, END_UNIT)
        logs = model.log_probabilities(contexts, targets) / np.log(10)
        heads = np.cumsum([0] + [len(s) for s in sequences[:-1]])
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.add.reduceat(logs, heads))], names=["rid", "unit_score"])


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    space = Workspace(spark, "lm-scores")
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (fold_of(id_column, FOLDS) == HELD_OUT).alias("held_out"),
        text_of(text_column).alias("text"),
    )
    training = narrow.filter(~F.col("held_out"))
    counted = training.select("text").mapInArrow(_word_counts, "word binary, cls int, n long")
    counts = space.keep(counted.groupBy("word", "cls").agg(F.sum("n").alias("n")))
    found = gather_counts(counts, training.count())
    shared = broadcast_of(spark, found)

    kinds = "doc_id long, held_out boolean, rid long, n_tokens long, units binary, base double, within double, known long, "
    kinds += "rest array<struct<word: binary, unseen: double, times: long>>"
    encoded = space.keep(narrow.mapInArrow(lambda b: _encoded(b, shared), kinds))
    model = spark.sparkContext.broadcast(train(encoded, found.unit_counts).flat())
    scored = encoded.select("rid", "units").mapInArrow(lambda b: _unit_scores(b, model), "rid long, unit_score double")

    # class tables: one row per class
    table = spark.createDataFrame(
        [(u, float(found.unit_counts[u]), float(found.discounts[u])) for u in range(UNITS - CLASSES, UNITS)],
        "cls int, cls_n double, discount double",
    )
    shares = counts.join(F.broadcast(table), "cls").select(
        "word", "n", (F.log10(F.col("n") + 0.5)).alias("log_n"), F.log10((F.col("n") - F.col("discount")) / F.nullif(F.col("cls_n"), F.lit(0.0))).alias("share")
    )
    rest = encoded.filter(F.size("rest") > 0).select("rid", F.inline("rest"))
    known = F.col("n").isNotNull()
    sums = (
        rest.join(shares, "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.col("times") * F.coalesce(F.col("log_n"), F.lit(log10(0.5)))).alias("log_n"),
            F.sum(F.col("times") * F.coalesce(F.col("share"), F.col("unseen"))).alias("share"),
            F.sum(F.when(known, F.col("times")).otherwise(0)).alias("hits"),
            F.sum("times").alias("times"),
        )
    )
    space_of = log10(found.tokens + 0.5 * (found.types + 1))
    whole = encoded.drop("units", "rest").join(scored, "rid").join(sums, "rid", "left")
    log_n, share, hits, times = (F.coalesce(F.col(c), F.lit(0)) for c in ("log_n", "share", "hits", "times"))
    return whole.select(
        F.col("doc_id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + hits).cast("long").alias("n_known"),
        F.lit(found.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log_n - times * F.lit(space_of)).alias("base_score"),
        (F.col("unit_score") + F.col("within") + share).alias("score"),
    )

