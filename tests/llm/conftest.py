"""Small fixtures for the training-data operators."""

from __future__ import annotations

import datetime as dt

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents rows from texts; ids count up from 0."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [
            (i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)
        ]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names."""
    when = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    texts = [None, "", " \t\n", "One two three", "word " * 30_000, "é" * 5_000, "a\n\nb\n", "One two three", "日本 😀 ​x"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", 1, i, "y", when) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, 0, "y", None), (None, None, None, None, None, 0, "y", None)]
    rows += [rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, y string, at timestamp"
    return spark.createDataFrame(rows, schema)
