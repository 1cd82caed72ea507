"""Unlabeled noise pools: many one-column sources, two pools."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesift.operators import clean
from tidesift.operators.dedup import dedup
from tidesift.operators.sets import union_by_name
from tidesift.schema import POOL_TEXT
from tidesift.sources.delimited import has_path, read_table


@dataclass(frozen=True)
class PoolSource:
    dataset: str
    file: str
    text: str
    pool: str = "out_topic"
    sep: str = ","
    encoding: str = "utf-8"
    columns: Sequence[str] | None = None
    frac: str | None = None
    keep: Sequence[str] = ()
    edit: Callable[[DataFrame], DataFrame] = lambda df: df


# Handles masked in one source, and the headers of two files without any.
_COMPANIES = ["microsoft", "google", "twitter", "apple"]
_CIKM = ["UserID", "TweetID", "Tweet", "CreatedAt"]
_SENTIMENT = ["target", "id", "date", "flag", "user", "text"]


def _mask_companies(df: DataFrame) -> DataFrame:
    return df.withColumn("tweet_text", clean.mask_names(F.col("tweet_text"), _COMPANIES))


def _mask_author(df: DataFrame) -> DataFrame:
    return df.withColumn("tweet_text", clean.mask_author(F.col("tweet_text"), F.col("author_id"))).drop("author_id")


# The public pools, their files, text columns and parsing options.
SOURCES = [
    PoolSource("Sanders Analytics Sentiment-labelled tweets", "full-corpus.csv", "TweetText", edit=_mask_companies),
    PoolSource("2015-new-years-resolutions", "New-years-resolutions-DFE.csv", "text", encoding="latin-1"),
    PoolSource("Depression - Twitter Dataset + Feature Extraction", "Mental-Health-Twitter.csv", "post_text"),
    PoolSource(
        "Customer Support on Twitter", "twcs/twcs.csv", "text", frac="0.1", keep=["author_id"], edit=_mask_author
    ),
    PoolSource("Twitter Sentiments Dataset", "Twitter_Data.csv", "clean_text"),
    PoolSource("Twitter Toxic Tweets", "twitter_toxic_tweets.csv", "tweet"),
    PoolSource(
        "Sentiment140", "training.1600000.processed.noemoticon.csv", "text", encoding="latin-1", columns=_SENTIMENT
    ),
    PoolSource("twitter_cikm_2010", "training_set_tweets.txt", "Tweet", sep="\t", columns=_CIKM),
    PoolSource("twitter_cikm_2010", "test_set_tweets.txt", "Tweet", sep="\t", columns=_CIKM),
    PoolSource("Sentiment of Climate Change", "1377884570_tweet_global_warming.csv", "tweet", "weather"),
    PoolSource("Twitter Climate Change Sentiment Dataset", "twitter_sentiment_data.csv", "message", "weather"),
    PoolSource("Weather sentiment evaluated", "weather-evaluated-agg-DFE.csv", "tweet_text", "weather"),
]


def read_pool_source(spark: SparkSession, root: str, source: PoolSource) -> DataFrame:
    """(tweet_text, dataset) of one source."""
    rename = {source.text: "tweet_text", **{c: c for c in source.keep}}
    rows = read_table(
        spark,
        f"{root}/{source.dataset}/{source.file}",
        columns=source.columns,
        sep=source.sep,
        encoding=source.encoding,
        rename=rename,
        frac=source.frac,
        multi_line=True,
    )
    return clean.with_constants(source.edit(rows), {"dataset": source.dataset}).select("tweet_text", "dataset")


def build_pool(sources: Sequence[DataFrame], subset: str, offset: int, words: int = 3) -> DataFrame:
    """One pool: nulls and copies out, short texts out, dense uids after ``offset``."""
    rows = clean.drop_nulls(union_by_name(*sources))
    long_enough = clean.min_words(dedup(rows, ["tweet_text"], "dataset"), n=words)
    keyed = long_enough.withColumn("_key", F.sha2("tweet_text", 256))
    numbered = clean.assign_uid(keyed, "_key", offset=offset)
    return clean.to_canonical(clean.tag_subset(numbered, subset, noise=True), {}, POOL_TEXT)


def read_noise_pools(
    spark: SparkSession, root: str, offset: int, absent: Collection[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(weather, out_topic) from the sources below ``root``; the uids of
    out_topic continue after those of weather. ``absent`` names the files that
    may be missing; any other missing file is an error."""
    parts: dict[str, list[DataFrame]] = {"weather": [], "out_topic": []}
    missing = []
    for source in SOURCES:
        if has_path(spark, f"{root}/{source.dataset}/{source.file}"):
            parts[source.pool].append(read_pool_source(spark, root, source))
        elif source.file not in absent:
            missing.append(f"{source.dataset}/{source.file}")
    empty = [pool for pool, found in parts.items() if not found]
    if missing or empty:
        raise FileNotFoundError(f"missing below {root}: {', '.join(missing) or 'all sources of ' + ', '.join(empty)}")
    weather = build_pool(parts["weather"], "weather", offset)
    return weather, build_pool(parts["out_topic"], "out_topic", offset + weather.count())
