"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines are normalised (stripped, A-Z lower-cased) and hashed. A line is
boilerplate of its host when it stands in more than a share of the host's
distinct texts (and in a few at least), or in more than a number that no host
excuses. Exact copies of a text count once, so a group of copies does not condemn
its own lines, and the document with the largest id that holds a line keeps it. A
document is depleted, and rejected, when too few of its words are left without
the boilerplate.

Texts are read once: a narrow table keeps every document's counts and, as pairs
of hash and word count, its distinct lines; all else reads that table.

Defined results
    null text      no words: ``base_failed``
    null host      a host of its own
    equal ids      every row is judged by its own text
    equal rows     one text, so their lines count once; all get the same verdict
    ties           of copies of one text with equal ids, all keep the line
    long texts     read whole; a line is a hash and a word count when shuffled
    empty table    an empty result
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.llm.common import BLANKS, ascii_lower, id_of, once, text_of
from tidesift.operators.bloom import drop_rows
from tidesift.session import Workspace

SPLIT = r"[\x20\x09-\x0D]+"
NO_SYMBOLS = "[^#*$%&|<>]+"
_ID, _HOST, _TXT = "_q_id", "_q_host", "_q_txt"


@dataclass(frozen=True)
class Limits:
    """Production limits of the rules."""

    min_words: int = 50  # fewer words fail
    repeat_pct: int = 50  # more words in repeated windows fail
    line_texts: int = 3  # a line of a host is boilerplate from this many texts on …
    line_pct: int = 5  # … if that is above this share of the host's texts, …
    line_most: int = 1000  # … and above this many texts in any host
    left_pct: int = 40  # a document with less of its words left is depleted
    left_words: int = 20  # … or with fewer words left, if it lost any


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    none = F.expr("CAST(array() AS array<string>)")
    return F.when(bare == "", none).otherwise(F.split(bare, SPLIT))


def _windows(words: Column) -> Column:
    """One hash per window of three words."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.transform(F.slice(words, 1, n), lambda a, i: F.xxhash64(a, F.get(words, i + 1), F.get(words, i + 2)))


def _in_repeats(windows: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Windows are sorted with their places; equal neighbours are repeats. Two
    repeated windows at places p < q cover min(3, q - p) words from p on.
    """
    n = F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.expr("array(named_struct('h', CAST(NULL AS BIGINT), 'i', CAST(NULL AS INT)))")
    around = F.zip_with(
        F.concat(nothing, F.slice(placed, 1, n - 1)),
        F.slice(placed, 2, n),
        lambda p, q: F.struct(p["h"].alias("p"), q["h"].alias("q")),
    )
    hits = F.zip_with(
        placed, around, lambda x, y: F.when((x["h"] == y["p"]) | (x["h"] == y["q"]), x["i"])
    )
    places = F.sort_array(F.array_compact(hits))
    widths = F.zip_with(
        places, F.slice(places, 2, n), lambda p, q: F.coalesce(F.least(q - p, F.lit(3)), F.lit(3))
    )
    covered = F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("long")).otherwise(covered)


def document_rows(docs: DataFrame, id_column: str, text_column: str, host_column: str, limits: Limits) -> DataFrame:
    """One row per document: id, host, text hash, counts, and its distinct non-blank lines as (hash, words)."""
    text = F.col("_q_text")
    rows = docs.select(
        id_of(id_column).alias(_ID),
        F.col(host_column).cast("string").alias(_HOST),
        text_of(text_column).alias("_q_text"),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    rows = rows.withColumn("_q_words", once(_words(text)))
    rows = rows.withColumn("_q_win", once(_windows(F.col("_q_words"))))
    rows = rows.withColumn("_q_lines", once(lines))

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.struct(F.xxhash64(ascii_lower(key)).alias("line"), F.size(F.split(key, SPLIT)).alias("words"))

    counted = rows.select(
        _ID,
        _HOST,
        F.xxhash64(text).alias(_TXT),
        F.size("_q_words").cast("long").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        _in_repeats(F.col("_q_win")).alias("n_repeat_words"),
        F.array_distinct(F.transform("_q_lines", hashed)).alias("_q_keys"),
    )
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.repeat_pct * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, holder): lines above the limits of their host, and the largest id that holds them.

    Distinct texts are counted in two steps, keyed by text first, so a line that
    stands in a third of all documents is spread over all tasks.
    """
    texts = lines.groupBy(_HOST, _TXT).agg(F.lit(1).alias("_one")).groupBy(_HOST)
    hosts = texts.agg(F.count(F.lit(1)).alias("host_texts"))
    per_text = lines.groupBy(_HOST, "line", _TXT).agg(F.max(_ID).alias("top"))
    counted = per_text.groupBy(_HOST, "line").agg(
        F.count(F.lit(1)).alias("n_texts"), F.max("top").alias("holder")
    )
    often = counted.filter(F.col("n_texts") >= min(limits.line_texts, limits.line_most + 1)).alias("o")
    joined = often.join(hosts.alias("h"), F.col(f"o.{_HOST}").eqNullSafe(F.col(f"h.{_HOST}")))
    share = (F.col("n_texts") >= limits.line_texts) & (100 * F.col("n_texts") > limits.line_pct * F.col("host_texts"))
    return joined.filter(share | (F.col("n_texts") > limits.line_most)).select(
        F.col(f"o.{_HOST}").alias("_f_host"), F.col("line").alias("_f_line"), "holder"
    )


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    limits: Limits = Limits(),
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``lost_words`` and ``kept``."""
    space = Workspace(docs.sparkSession, "quality-rules")
    rows = space.keep(document_rows(docs, id_column, text_column, host_column, limits))
    lines = rows.select(_ID, _HOST, _TXT, F.inline("_q_keys"))
    often = space.keep(frequent_lines(lines, limits))
    match = F.col(_HOST).eqNullSafe(F.col("_f_host")) & (F.col("line") == F.col("_f_line"))
    document = [F.col(_ID).alias("_l_id"), F.col(_TXT).alias("_l_txt"), F.col(_HOST).alias("_l_host")]
    lost = (
        lines.join(often, match)
        .filter(F.col(_ID) != F.col("holder"))
        .groupBy(*document, "line")  # rows repeated as a whole count once
        .agg(F.max("words").alias("words"))
        .groupBy("_l_id", "_l_txt", "_l_host")
        .agg(F.sum("words").alias("lost"))
    )
    joined = rows.drop("_q_keys").join(
        lost,
        (F.col(_ID) == F.col("_l_id"))
        & (F.col(_TXT) == F.col("_l_txt"))
        & F.col(_HOST).eqNullSafe(F.col("_l_host")),
        "left",
    )
    gone = F.coalesce(F.col("lost"), F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & (
        (100 * left < limits.left_pct * F.col("n_words")) | (left < limits.left_words)
    )
    return joined.select(
        F.nullif(F.col(_ID), F.lit(-(2**63))).alias(id_column),
        F.col(_TXT).alias("text_hash"),
        F.col(_HOST).alias("host"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        gone.alias("lost_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def keep_good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The rows of documents that pass."""
    space = Workspace(docs.sparkSession, "quality-rules")
    bad = space.keep(
        judge(docs, id_column, text_column, host_column)
        .filter(~F.col("kept"))
        .select(id_of(id_column).alias("_b_id"), F.col("text_hash").alias("_b_txt"), F.col("host").alias("_b_host"))
        .distinct()
    )
    document = {"_b_id": id_of(id_column), "_b_txt": F.xxhash64(text_of(text_column)), "_b_host": F.col(host_column).cast("string")}
    return drop_rows(docs, bad, document)
