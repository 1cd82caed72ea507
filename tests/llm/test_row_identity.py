"""Rows without an id, or with a repeated one, are told apart by their texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidesift.llm.exact_dedup import drop_copies, mark_copies
from tidesift.llm.quality_rules import keep_good
from tidesift.llm.simhash import drop_near_copies


def unlike(n):
    rng = random.Random(9)
    return [" ".join(str(rng.getrandbits(32)) for _ in range(40)) for _ in range(n)]


@pytest.mark.parametrize("drop", [drop_near_copies, drop_copies])
def test_unlike_texts_without_an_id_stay(make_docs, drop):
    texts = unlike(8)
    docs = make_docs([*texts, texts[0], texts[0], texts[5]], ids=[None] * 4 + [7] * 4 + [None, 3, 7])
    kept = [(r["doc_id"], r["text"]) for r in drop(docs).collect()]
    want = [(3, texts[0])] + [(None, t) for t in texts[1:4]] + [(7, t) for t in texts[4:]]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_texts_alike_at_the_beginning_are_no_copies(make_docs):
    head = "a" * 300
    rows = [(None, head + "x"), (None, head + "y"), (None, head + "y"), (4, head + "x"), (4, head + "z"), (2, head + "z")]
    docs = make_docs([t for _, t in rows], ids=[i for i, _ in rows])
    kept = [(r["doc_id"], r["text"][-1]) for r in drop_copies(docs).collect()]
    assert sorted(kept, key=repr) == [(4, "x"), (4, "z"), (None, "y")]
    marked = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in mark_copies(docs).collect()), key=repr)
    assert marked == sorted(
        [(None, 4, 2, False), (None, None, 2, True), (None, None, 2, True), (4, 4, 2, True), (4, 4, 2, True), (2, 4, 2, False)], key=repr
    )


@pytest.mark.parametrize("drop", [drop_near_copies, drop_copies, keep_good])
def test_columns_named_as_the_operators_own(make_docs, drop):
    own = ["_dd_id", "_dd_full", "_dd_len", "_b_id", "_b_txt", "_b_host", "_f_id", "_f_txt", "id", "txt", "node", "root", "_key0", "_bloom_row"]
    words = unlike(8)
    texts = [f"{a} {b}" for a, b in zip(words[:4], words[4:], strict=True)]
    docs = make_docs([*texts, texts[0], texts[0]], ids=[0, 1, 2, 3, 4, 4])
    for i, name in enumerate(own):
        docs = docs.withColumn(name, F.lit(i))
    left = drop(docs)
    assert left.columns == docs.columns
    ids = sorted(r["doc_id"] for r in left.collect())
    assert ids in ([0, 1, 2, 3], [1, 2, 3, 4], [0, 1, 2, 3, 4, 4]) and all(r["_b_id"] == 3 for r in left.collect())
