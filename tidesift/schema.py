"""Canonical tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LABELED_TEXT = T.StructType(
    [
        T.StructField("tweet_id", T.StringType()),
        T.StructField("tweet_text", T.StringType()),
        T.StructField("informative", T.BooleanType()),
        T.StructField("humanitarian_label", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("original_informative_label", T.StringType()),
        T.StructField("original_humanitarian_label", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("meta", T.StringType()),
    ]
)

# Column order of the merged corpus, without its uid.
UNIFIED_COLUMNS = [
    "tweet_id",
    "tweet_text",
    "informative",
    "humanitarian_label",
    "dataset",
    "event_type",
    "year",
    "event_name",
    "country",
    "url",
    "original_informative_label",
    "original_humanitarian_label",
    "meta",
]

_unified_types = {f.name: f.dataType for f in LABELED_TEXT} | {
    "country": T.StringType(),
    "url": T.StringType(),
}

UNIFIED_TEXT = T.StructType(
    [T.StructField("uid", T.LongType())]
    + [T.StructField(name, _unified_types[name]) for name in UNIFIED_COLUMNS]
)

POOL_TEXT = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("tweet_text", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("informative", T.BooleanType()),
        T.StructField("subset", T.StringType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model_name", T.StringType()),
    ]
)
