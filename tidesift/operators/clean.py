"""Row-local projections and filters, plus id assignment.

Everything here except ``assign_uid`` and numbered ``synthetic_id`` is a narrow
transformation and works on streaming DataFrames too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.functions import text as tx
from tidesift.operators.rank import with_rank


def to_canonical(df: DataFrame, renames: Mapping[str, str], schema: T.StructType) -> DataFrame:
    """Rename, then project onto the schema; columns that are missing become null."""
    renamed = df.withColumnsRenamed(dict(renames))
    return renamed.select(
        *[
            (F.col(f"`{f.name}`") if f.name in renamed.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def with_constants(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def pack_meta(df: DataFrame, columns: Sequence[str], into: str = "meta", drop: bool = True) -> DataFrame:
    """Fold columns into one JSON field; null values keep their key."""
    packed = df.withColumn(into, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return packed.drop(*[c for c in columns if c != into]) if drop else packed


def meta_get(meta: Column, key: str) -> Column:
    return F.get_json_object(meta, f"$['{key}']")


def clean_id(value: Column) -> Column:
    """Strip the quotes some files put around ids; digits stay text, ids exceed 64 bits."""
    return F.regexp_replace(value.cast("string"), "^'+|'+$", "")


def digits_of(value: Column) -> Column:
    """First run of digits, null if there is none."""
    return F.nullif(F.regexp_extract(value, r"(\d+)", 1), F.lit(""))


def synthetic_id(
    df: DataFrame, columns: Sequence[str], order: str | None = None, name: str = "tweet_id", seed: int = 42
) -> DataFrame:
    """An id from the content, stable across retries.

    Equal rows share the id unless ``order`` names a unique column: then copies
    are numbered and the number is part of the id. Numbering uses the split
    rank, so a text with a very large number of copies is not one task's work.
    """
    if order is None:
        return df.withColumn(name, F.md5(F.concat_ws("|", *columns)))
    group = F.md5(F.concat_ws("|", *columns))
    numbered = with_rank(df.withColumn("_group", group), order, seed, by=["_group"], name="_copy")
    return numbered.withColumn(name, F.md5(F.concat_ws("|", *columns, F.col("_copy")))).drop("_group", "_copy")


def assign_uid(df: DataFrame, key: str, offset: int = 0, seed: int = 42, name: str = "uid") -> DataFrame:
    """Dense shuffled ids ``offset+1 … offset+n``; ``key`` must be unique."""
    ranked = with_rank(df, key, seed, name="_rank")
    return ranked.select((F.col("_rank") + offset).alias(name), *[c for c in df.columns if c != name])


def year_from_tail(value: Column) -> Column:
    return F.element_at(tx.words(value), -1).try_cast("int")


def mask_names(text: Column, names: Sequence[str], mask: str = "@USER") -> Column:
    """Fixed handles, any case, as substrings."""
    for name in names:
        text = F.regexp_replace(text, rf"(?i)@\Q{name}\E", mask)
    return text


def mask_author(text: Column, author_id: Column, mask: str = "@USER") -> Column:
    return F.replace(text, F.concat(F.lit("@"), author_id.cast("string")), F.lit(mask))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def min_words(df: DataFrame, column: str = "tweet_text", n: int = 3) -> DataFrame:
    """Rows with at least n whitespace tokens; the match ends at the n-th token's start."""
    return df.filter(F.col(column).rlike(tx.at_least_words(n)))


def has_label(df: DataFrame, column: str = "humanitarian_label") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def lacks_label(df: DataFrame, column: str = "humanitarian_label") -> DataFrame:
    return df.filter(F.col(column).isNull())


def drop_golden(df: DataFrame, column: str = "_golden", strict: bool = True) -> DataFrame:
    """Quality-control rows out. ``strict`` keeps only rows marked false; otherwise
    rows without a mark stay too."""
    golden = F.lower(F.col(column).cast("string"))
    return df.filter(golden == "false") if strict else df.filter(~golden.eqNullSafe("true"))


def only_language(df: DataFrame, lang: str = "en", column: str = "lang", meta_key: str | None = None) -> DataFrame:
    value = meta_get(F.col(column), meta_key) if meta_key else F.col(column)
    return df.filter(value == lang)


def include_values(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return df.filter(F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def exclude_values(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Null is in no list, so null rows stay."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def tag_subset(df: DataFrame, subset: str, noise: bool = False) -> DataFrame:
    tagged = df.withColumn("subset", F.lit(subset))
    return tagged.withColumn("informative", F.lit(False)) if noise else tagged
