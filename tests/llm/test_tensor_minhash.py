"""MinHash near duplicates with tensored banding against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_dedup import brute_components, words_of

from tidesift.llm import tensor_minhash
from tidesift.llm.queries import op11_minhash_near_dedup
from tidesift.llm.tensor_minhash import HALVES, MINIMA, half_keys, minima, near_sets, shingle_set, sketch


def shingles(text):
    words = words_of(text or "")
    if not words:
        return set()
    return {" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}


def brute(rows):
    """{id: (n_shingles, component_id, kept)} of (id, text) rows with unlike ids."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    holders = {}
    for i in ids:
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for a in h for b in h if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = brute_components(list(sets), linked)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}, linked


def told(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, linked = brute(rows)
    assert linked
    assert told(op11_minhash_near_dedup(spark, sf_dir)) == want


def near_copies(n, words, changes, seed=7):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("slice_rows", [20, 2_048])
def test_crowded_tables(make_docs, monkeypatch, slice_rows):
    monkeypatch.setattr(tensor_minhash, "SLICE_ROWS", slice_rows)
    texts = near_copies(160, 150, 9)  # links and pairs just below the limit
    shared = " ".join(f"p{i}" for i in range(60))  # a passage that many unlike texts hold
    rng = random.Random(2)
    texts += [shared + " " + " ".join(str(rng.getrandbits(40)) for _ in range(60)) for _ in range(60)]
    texts += texts[:5] + ["", " \n", None, "One two", "one  TWO", "one two three", "ONE two three\n"]
    want, linked = brute(list(enumerate(texts)))
    assert len(linked) > 1_000
    assert told(near_sets(make_docs(texts))) == want


def test_one_table_for_all_pairs_at_the_limit(make_docs):
    rng = random.Random(5)
    texts = []
    for i in range(60):  # pairs of sets that share 85 of 100 shingles, and 85 of 101
        base = [str(rng.getrandbits(50)) for _ in range(95)]
        more = [str(rng.getrandbits(50)) for _ in range(7 + i % 2)]
        texts += [" ".join(base), " ".join(base[:87] + more)]
    want, linked = brute(list(enumerate(texts)))
    assert len(linked) == 30
    assert told(near_sets(make_docs(texts))) == want


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = near_sets(odd_docs).collect()
    assert len(got) == len(rows)
    sizes = sorted(r["n_shingles"] for r in got)
    assert sizes == sorted(len(shingles(t)) for _, t in rows)
    for r in got:
        if not r["n_shingles"]:
            assert r["kept"] and r["component_id"] == r["doc_id"]
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 7)} == {3}
    assert near_sets(odd_docs.limit(0)).count() == 0


def test_equal_ids_and_ids_missing(make_docs):
    a, b = near_copies(2, 100, 0, 1)[0], " ".join(f"z{i}" for i in range(50))
    docs = make_docs([a, a + " end", b, b, "other words here"], ids=[7, 7, None, 4, None])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_sets(docs).collect()), key=repr)
    assert got == sorted([(7, 98, 7, True), (7, 99, 7, True), (None, 48, None, True), (4, 48, None, False), (None, 1, None, True)], key=repr)


def test_keys_and_sketches():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**64, 900, dtype=np.uint64)
    hits, unlike = 0, []
    for _ in range(60):
        a = np.r_[shared[:850], rng.integers(0, 2**64, 75, dtype=np.uint64)]
        b = np.r_[shared[:850], rng.integers(0, 2**64, 75, dtype=np.uint64)]
        ma, mb = minima(a), minima(b)
        same = half_keys(ma) == half_keys(mb)
        hits += same[:HALVES].any() and same[HALVES:].any()
        nibbles = [[int(x) >> 4 * i & 15 for x in sketch(m).view(np.uint64) for i in range(15)] for m in (ma, mb)]
        assert len(nibbles[0]) == MINIMA
        unlike.append(sum(x != y for x, y in zip(*nibbles, strict=True)))
    assert hits == 60 and 5 < np.mean(unlike) < 12 and max(unlike) <= tensor_minhash.MOST_UNLIKE
    assert len(np.unique(half_keys(minima(shared)))) == 2 * HALVES
    assert list(shingle_set("A b a B a b")) == sorted(set(shingle_set("a b a b")))
