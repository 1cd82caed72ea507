"""Exact deduplication by progressive refinement, in DataFrame operations only.

Groups are refined from cheap to dear keys: length in bytes, then a hash of the
first characters, then the full SHA-256. To find the groups, only documents whose
(length, prefix) occurs more than once have their full text hashed; decisions are
joined to the rows by id and SHA-256, so no other text shares them.

Defined results
    null text      counts as empty; all empty texts are one group
    null doc_id    lower than any id; a group of null ids keeps a null id
    equal ids      rows that share doc_id and text are one document: they share its
                   decision, and ``drop_copies`` leaves one of them; rows that
                   share an id, or have none, but differ in text are unlike
    long texts     read whole; only digests are grouped
    empty table    an empty result
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesift.llm.common import NO_ID, ascii_lower, id_of, one_of_each, text_of
from tidesift.operators.bloom import drop_rows, keep_rows
from tidesift.session import Workspace

PREFIX_CHARS = 256
_ID, _LEN, _PFX, _FULL = "_dd_id", "_dd_len", "_dd_pfx", "_dd_full"


def _keys(id_column: str, text_column: str) -> list[Column]:
    text = text_of(text_column)
    prefix = F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS)))
    return [id_of(id_column).alias(_ID), F.octet_length(text).alias(_LEN), prefix.alias(_PFX)]


def _full(text_column: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(text_of(text_column)), 256))


def copy_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Members of groups of two or more equal texts.

    Columns: _dd_id, _dd_full (the document), keep (largest id of the group),
    group_size, same (rows of this very document).
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    keys = space.keep(docs.select(*_keys(id_column, text_column)))

    lengths = keys.groupBy(_LEN).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_LEN)
    prefixes = (
        keys.join(lengths, _LEN, "left_semi")
        .groupBy(_LEN, _PFX)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(_LEN, _PFX)
    )
    prefixes = space.keep(prefixes)

    whole = docs.select(*_keys(id_column, text_column), text_of(text_column).alias("_dd_text"))
    members = (
        whole.join(prefixes, [_LEN, _PFX], "left_semi")
        .select(_ID, _LEN, _PFX, _full("_dd_text").alias(_FULL))
        .groupBy(_LEN, _PFX, _FULL, _ID)
        .agg(F.count(F.lit(1)).alias("same"))
    )
    members = space.keep(members)
    space.free(keys, prefixes)
    groups = (
        members.groupBy(_LEN, _PFX, _FULL)
        .agg(F.max(_ID).alias("keep"), F.sum("same").alias("group_size"))
        .filter("group_size > 1")
    )
    return members.join(groups, [_LEN, _PFX, _FULL]).select(_ID, _FULL, "keep", "group_size", "same")


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **more: Column) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, and columns computed from it in the same scan."""
    groups = copy_groups(docs, id_column, text_column)
    rows = docs.select(id_of(id_column).alias(_ID), _full(text_column).alias(_FULL), *[c.alias(name) for name, c in more.items()])
    own = F.coalesce(F.col("keep"), F.col(_ID))
    return rows.join(groups, [_ID, _FULL], "left").select(
        F.nullif(F.col(_ID), F.lit(NO_ID)).alias(id_column),
        F.nullif(own, F.lit(NO_ID)).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        (own == F.col(_ID)).alias("kept"),
        *more,
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay: of equal texts the one with the largest id."""
    space = Workspace(docs.sparkSession, "exact-dedup")
    groups = space.keep(copy_groups(docs, id_column, text_column))
    document = {_ID: id_of(id_column), _FULL: _full(text_column)}
    gone = groups.filter((F.col("keep") != F.col(_ID)) | (F.col("same") > 1)).select(_ID, _FULL)
    left = drop_rows(docs, gone, document)
    repeated = groups.filter((F.col("keep") == F.col(_ID)) & (F.col("same") > 1)).select(_ID, _FULL)
    if repeated.isEmpty():
        return left
    return left.unionByName(one_of_each(keep_rows(docs, repeated, document), document))
