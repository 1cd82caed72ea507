"""Label harmonization with the null rules made explicit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binarize(label: Column, positive: Sequence[str] | None = None, negative: Sequence[str] | None = None) -> Column:
    """True for listed positives, or for everything but listed negatives.

    A null label is not in either list: false by the positive rule, true by the
    negative rule.
    """
    if (positive is None) == (negative is None):
        raise ValueError("give either positive or negative labels")
    listed = F.coalesce(label.isin(list(positive if positive is not None else negative)), F.lit(False))
    return listed if positive is not None else ~listed


def map_labels(label: Column, mapping: Mapping[str, str], missing: str = "null") -> Column:
    """Look labels up in a small dictionary; unknown ones become null or stay."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    mapped = F.try_element_at(table, label)
    if missing == "null":
        return mapped
    if missing == "keep":
        return F.coalesce(mapped, label)
    raise ValueError("missing must be 'null' or 'keep'")


def unmapped_report(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Labels the dictionary does not know, with their counts."""
    return (
        df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(mapping)))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def lookup_event(df: DataFrame, events: DataFrame, key: str, on_missing: str = "skip") -> DataFrame:
    """Attach the event dimension. Unknown keys are dropped, or stop the job.

    No hint: the optimizer broadcasts the dimension while it is small.
    """
    if on_missing == "skip":
        return df.join(events, key, "inner")
    if on_missing != "fail":
        raise ValueError("on_missing must be 'skip' or 'fail'")
    known = events.withColumn("_known", F.lit(True))
    joined = df.join(known, key, "left")
    failed = F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    checked = F.when(F.col("_known"), F.col(key)).otherwise(failed.cast(df.schema[key].dataType))
    return joined.withColumn(key, checked).drop("_known")


def resolve_task_overlap(
    df: DataFrame,
    label: str = "label",
    key: str = "tweet_id",
    mirror: str = "not_humanitarian",
    generic: str = "informative",
    negative: str = "not_informative",
) -> DataFrame:
    """Merge the two tasks of one corpus.

    Rows with the mirror label repeat the negative label of the other task and
    go. A generic row goes if its id also has a specific label.
    """
    kept = df.filter(F.coalesce(F.col(label) != mirror, F.lit(True)))
    specific = (
        kept.filter(~F.coalesce(F.col(label).isin(generic, negative), F.lit(False))).select(key).distinct()
    )
    is_generic = F.coalesce(F.col(label) == generic, F.lit(False))
    redundant = kept.filter(is_generic).join(specific, key, "left_anti")
    return kept.filter(~is_generic).unionByName(redundant)


def derive_label(label: Column) -> Column:
    """not_informative -> not_humanitarian, informative -> unclassified, others stay."""
    return (
        F.when(label == "not_informative", "not_humanitarian").when(label == "informative", "unclassified").otherwise(label)
    )


def relabel_safety_net(df: DataFrame, label: str = "informative", predicted: str = "predicted") -> DataFrame:
    """Non-informative rows that were predicted positive, labeled not_humanitarian."""
    fooled = df.filter(~F.col(label).cast("boolean") & (F.col(predicted).cast("int") == 1))
    return fooled.withColumn("humanitarian_label", F.lit("not_humanitarian"))
