"""Exact, near and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidesift.llm import golay, line_dedup, simhash
from tidesift.llm.components import components
from tidesift.llm.exact_dedup import drop_copies, mark_copies
from tidesift.llm.line_dedup import bitmap_of, deduplicate_lines, keep_bits, keep_bitmaps
from tidesift.llm.simhash import drop_near_copies, fingerprint, golay_keys, links, near_groups
from tidesift.session import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def brute_fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, linked):
    """Least key reachable from each key."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    near = golay.near_indices(words)
    count = (near >= 0).sum(axis=1)
    assert set(count.tolist()) == {1, 6}
    heads, patterns = golay._tables()
    assert (patterns[:, 0] >= 0).all()


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    sets = []
    for table in (a, b):
        found = defaultdict(set)
        for row, key in zip(*[x.tolist() for x in golay_keys(table)], strict=True):
            found[row].add(key)
        sets.append(found)
    assert all(sets[0][i] & sets[1][i] for i in range(len(a)))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "É é E e", "a b c d", "x\x0by\x85z w " * 9])
def test_fingerprint(text, monkeypatch):
    assert fingerprint(text) == brute_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("small", [2, 64, 100_000])
def test_links_keep_all_components(spark, small):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 5, dtype=np.uint64)
    found = []
    for i in range(700):
        fp = seeds[i % 5]
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            fp ^= np.uint64(1) << np.uint64(bit)
        found.append(fp)
    fps = np.unique(np.array(found))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = brute_components(range(len(fps)), zip(*[x.tolist() for x in np.nonzero(close)], strict=True))
    space = Workspace(spark, "test")
    nodes = spark.createDataFrame(list(enumerate(fps.view(np.int64).tolist())), "node long, fp long")
    got = {r["node"]: r["root"] for r in components(links(nodes, space, small), space).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges, Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(edges.limit(0), Workspace(spark, "test")).count() == 0
    top = 2**63 - 1
    large = spark.createDataFrame([(top - i, top - i - 1) for i in range(5)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(large, Workspace(spark, "test")).collect()}
    assert got == {top - i: top - 5 for i in range(5)}


def test_near_groups_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    ids = sorted(fps)
    linked = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = brute_components(ids, linked)
    got = near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["fingerprint"] % 2**64 == fps[r["doc_id"]] for r in got)
    kept = {r["doc_id"] for r in drop_near_copies(docs).select("doc_id").collect()}
    assert kept == set(want.values())


def test_near_groups_of_odd_rows(odd_docs):
    got = near_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    # the least id of the empty texts is the null one
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {None}
    kept = drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert near_groups(odd_docs.limit(0)).count() == 0
    assert drop_near_copies(odd_docs.limit(0)).count() == 0


def test_exact_copies_of_odd_rows(odd_docs):
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    got = mark_copies(odd_docs, text_sha256=sha).collect()
    assert len(got) == odd_docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add((r["keep_id"], r["group_size"], r["kept"]))
    assert by_id[0] == {(1, 3, False)}
    assert by_id[1] == {(1, 3, True)}
    assert by_id[3] == {(7, 4, False)} and by_id[7] == {(7, 4, True)}
    kept = drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, i) for i in (1, 2, 4, 5, 6, 7, 8)
    ] + [(True, 0)]
    assert drop_copies(odd_docs.limit(0)).count() == 0


def test_repeated_rows_leave_one(make_docs):
    docs = make_docs(["same", "same", "SAME", "other"], ids=[5, 5, 2, 5])
    assert sorted((r["doc_id"], r["text"]) for r in drop_copies(docs).collect()) == [(5, "other"), (5, "same")]


def test_exact_copies_of_many(make_docs):
    rng = random.Random(4)
    texts = [rng.choice(["Aa", "aA", "ab", "b" * 300 + "x", "b" * 300 + "y"]) for _ in range(200)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.translate(LOWER)].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    got = mark_copies(make_docs(texts)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == want


def brute_lines(rows, min_docs=3):
    """{row: (n_lines, kept text)} for (id, text) rows."""
    blanks = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(blanks).translate(LOWER)
            if len(key) >= 20:
                holders[key].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            found = holders.get(line.strip(blanks).translate(LOWER), set())
            if len(found) < min_docs or max(found) == (-1 if i is None else i):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_lines_with_a_hot_line(spark, make_docs, partitions):
    rng = random.Random(5)
    pool = [f"line number {i} of the shared passages é" for i in range(30)] + ["short", "", "x" * 19, "ü" * 20, "ü" * 19]
    hot = "  THIS line stands in every document\t"
    texts = []
    for _ in range(300):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 8))] + [hot] * rng.randint(0, 2)
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    docs = make_docs(texts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = deduplicate_lines(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == brute_lines(list(enumerate(texts)))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1000])
def test_range_streams_alike_in_any_batches(size):
    rng = np.random.default_rng(6)
    rows = np.stack([rng.integers(0, 12, 400), np.zeros(400, int), rng.integers(0, 6, 400), np.zeros(400, int), np.arange(400), np.zeros(400, int)], axis=1)
    rows = rows[np.lexsort((rows[:, 4], -rows[:, 2], rows[:, 0]))]
    state = line_dedup._Range(3)
    told = []
    for low in range(0, 400, size):
        told += state.feed(rows[low : low + size], False)
    told += state.feed(rows[:0], True)
    inner = {k for k in set(rows[:, 0].tolist()) if k not in (rows[0, 0], rows[-1, 0])}
    lost = {int(p) for kind, part in told if kind == line_dedup.LOST for p in part[:, 4]}
    for key in inner:
        own = rows[rows[:, 0] == key]
        holders = set(own[:, 2].tolist())
        want = set(own[own[:, 2] < max(holders)][:, 4].tolist()) if len(holders) >= 3 else set()
        assert {p for p in lost if rows[rows[:, 4] == p][0, 0] == key} == want
    opened = [int(p) for kind, part in told if kind == line_dedup.OPEN for p in part[:, 4]]
    assert set(opened) >= set(rows[rows[:, 0] == rows[0, 0]][:, 4].tolist())
    assert len(opened) == len(set(opened))


def test_lines_of_odd_rows(odd_docs, make_docs):
    got = deduplicate_lines(odd_docs, digest=True).collect()
    assert len(got) == odd_docs.count()
    assert {r["n_lines"] for r in got if r["doc_id"] == 0} == {1}
    assert {r["kept_sha256"] for r in got if r["doc_id"] == 1} == {hashlib.sha256(b"").hexdigest()}
    assert deduplicate_lines(odd_docs.limit(0)).count() == 0
    same = make_docs(["a line of twenty points or more\nx"] * 4, ids=[None, 1, 1, 2])
    assert sorted((r["n_dropped"], r["doc_id"] or 0) for r in deduplicate_lines(same).collect()) == [(0, 2), (1, 0), (1, 1), (1, 1)]


def test_bitmaps_round_trip(make_docs):
    for lost in ([0], [3], [7], [8], [0, 5, 200]):
        keep = keep_bits(bitmap_of(np.array(lost)), 300)
        assert np.flatnonzero(~keep).tolist() == lost
    assert keep_bits(None, 3).all()
    assert keep_bitmaps(make_docs(["only one\nline of twenty points or more"])).count() == 0
