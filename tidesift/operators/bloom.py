"""Keeping or dropping rows by a key table without moving the rows that miss it.

An anti-join whose key table is too large to broadcast shuffles both sides, rows
with all their columns. Here a Bloom filter of the keys goes to every task
instead. A row that misses it has no such key for certain, so it stays where it
is; only rows that hit are shuffled to the exact join. What is shuffled is in
proportion to the rows with a key, plus the filter's errors.

The filter is a table of at most ``MOST_WORDS`` words of 64 bits (16 MB), sized
by the counted keys at ``BITS_PER_KEY``: 2 to 3 of 100 other rows hit it by
error up to 11 million keys. Beyond that errors grow until, at some 100 million
keys, nearly all rows are shuffled as by a plain join. Results are exact at any
number. A key sets four bits of one word, so a test reads one word; it is a
broadcast hash join on the word's row and plain expressions.

Keys are compared null-safely. ``df`` is read twice, so it had better be a table
than the outcome of dear steps.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.session import Workspace

BITS_PER_KEY = 12
WORDS_PER_ROW = 64
MOST_WORDS = 1 << 21
FEW_KEYS = 2_000  # Spark broadcasts the keys themselves
SMALL_BYTES = 64 << 20  # rows that may be moved rather than read twice


def _places(keys: list[Column], rows: int) -> tuple[Column, Column, Column]:
    """(row, word, bits) of a key."""
    first, second = F.xxhash64(F.lit(17), *keys), F.xxhash64(F.lit(23), *keys)
    bits = F.lit(0).cast("long")
    for i in range(4):
        # a shift by a column needs the function by name
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    word = F.shiftright(first, 40).bitwiseAND(F.lit(WORDS_PER_ROW - 1)).cast("int")
    return F.pmod(first, F.lit(rows)).cast("int"), word, bits


def bloom_table(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(row, words) of a filter of ``n`` keys, all columns of ``keys`` being the key, and the number of rows."""
    rows = 1
    while rows * WORDS_PER_ROW * 64 < n * BITS_PER_KEY and rows * WORDS_PER_ROW < MOST_WORDS:
        rows *= 2
    row, word, bits = _places([F.col(f"`{c}`") for c in keys.columns], rows)
    words = keys.select(row.alias("row"), word.alias("word"), bits.alias("bits")).groupBy("row", "word").agg(F.bit_or("bits").alias("bits"))
    found = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    places = F.sequence(F.lit(0), F.lit(WORDS_PER_ROW - 1))
    filled = F.transform(places, lambda w: F.coalesce(F.element_at("found", w), F.lit(0).cast("long")))
    return found.select("row", filled.alias("words")), rows


def _fresh(df: DataFrame, other: DataFrame, stem: str) -> str:
    while stem in df.columns or stem in other.columns:
        stem += "_"
    return stem


def _common(df: DataFrame, table: DataFrame, name: str, own: Column) -> T.DataType:
    """The type in which Spark compares a key column with its expression."""
    left, right = table.select(F.col(f"`{name}`").alias("x")), df.select(own.alias("x"))
    if left.schema["x"].dataType == right.schema["x"].dataType:
        return left.schema["x"].dataType
    return left.union(right).schema["x"].dataType


class KeyTable:
    """Keys that tell rows of ``df`` apart: ``keys`` maps each key column of ``table`` to an expression over ``df``.

    Up to ``few`` keys, or ``small`` bytes of rows by Spark's estimate, the plain join does; the result is the same.
    """

    def __init__(self, df: DataFrame, table: DataFrame, keys: Mapping[str, Column], few: int = FEW_KEYS, small: int = 0):
        space = Workspace(df.sparkSession, "keys")
        self.df = df
        self.names = [_fresh(df, table, f"_key{i}") for i in range(len(keys))]
        # compared as the wider of both types; a hash depends on the type
        kinds = [_common(df, table, c, e) for c, e in keys.items()]
        columns = zip(keys, self.names, kinds, strict=True)
        self.table = table.select(*[F.col(f"`{c}`").cast(kind).alias(name) for c, name, kind in columns])
        self.own = [e.cast(kind) for e, kind in zip(keys.values(), kinds, strict=True)]
        self.filter = None
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < small:
            return
        self.table = space.keep(self.table.distinct())
        self.n = self.table.count()
        if self.n > few:
            words, self.rows = bloom_table(self.table, self.n)
            self.filter = space.keep(words)

    def _tested(self, hit: bool) -> DataFrame:
        """The rows that hit the filter, or those that miss it."""
        row, word, bits = _places(self.own, self.rows)
        at, there = _fresh(self.df, self.table, "_bloom_row"), _fresh(self.df, self.table, "_bloom_words")
        # at most MOST_WORDS / WORDS_PER_ROW rows, whatever the number of keys
        words = F.broadcast(self.filter.select(F.col("row").alias(at), F.col("words").alias(there)))
        joined = self.df.join(words, row == F.col(at), "left")
        hits = F.coalesce(F.element_at(F.col(there), word + 1).bitwiseAND(bits) == bits, F.lit(False))
        return joined.filter(hits if hit else ~hits).select(*[F.col(f"`{c}`") for c in self.df.columns])

    def _exact(self, df: DataFrame, how: str) -> DataFrame:
        match = F.lit(True)
        for e, name in zip(self.own, self.names, strict=True):
            match = match & e.eqNullSafe(F.col(name))
        return df.join(self.table, match, how)

    def drop(self) -> DataFrame:
        """The rows of ``df`` without a key in the table."""
        if self.filter is None:
            return self._exact(self.df, "left_anti")
        return self._tested(False).union(self._exact(self._tested(True), "left_anti"))

    def keep(self) -> DataFrame:
        """The rows of ``df`` with a key in the table."""
        return self._exact(self.df if self.filter is None else self._tested(True), "left_semi")


def drop_rows(df: DataFrame, table: DataFrame, keys: Mapping[str, Column], few: int = FEW_KEYS, small: int = 0) -> DataFrame:
    return KeyTable(df, table, keys, few, small).drop()


def keep_rows(df: DataFrame, table: DataFrame, keys: Mapping[str, Column], few: int = FEW_KEYS, small: int = 0) -> DataFrame:
    return KeyTable(df, table, keys, few, small).keep()
