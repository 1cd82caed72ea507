"""Token operators against the tokenizers library, greedy matching and exact round trips."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidesift.llm import token_files
from tidesift.llm.byte_tokens import ByteEncoder, byte_of_char, token_bytes
from tidesift.llm.configuration_lp import best_fit, cover_histogram, pack_histogram, price, solve
from tidesift.llm.packing import cut, locate, pack, slots
from tidesift.llm.piece_counts import count_tokens, load
from tidesift.llm.repair import compress, pack_bits, unpack_bits
from tidesift.llm.token_files import grammar_of, new_path, read_documents, read_tokens, write_tokens
from tidesift.llm.word_bpe import WordEncoder, encode_texts, round_trip_digests

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyzaeiounsth   '.,0123 ÉéßΣσİ́ \x1c\x85\xa0日本😀​\n\t"


def odd_texts(n=400, seed=7):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += ["a" * k for k in range(1, 40)]
    texts += ["", " ", "\n", "  two  blanks ", "it's you'll 'S", "x" * 3000, "haha" * 40, "." * 300]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "<|startoftext|>Hi<|endoftext|>there <|ENDOFTEXT|>", "a<|endoftext|>b c"]
    return texts


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_byte_ids_equal_the_library(spark, sf_dir):
    exact, own = library(BYTES), ByteEncoder(BYTES)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text in texts:
        ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
        assert ids == exact.encode(text, add_special_tokens=False).ids, text[:80]


def test_word_ids_equal_the_library(spark, sf_dir):
    exact, own = library(WORDS), WordEncoder(WORDS)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text in texts:
        ids = own.encode(text)
        want = exact.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text[:80]
        assert own.decode(ids).decode() == exact.decode(want, skip_special_tokens=False), text[:80]


def test_automaton_reads_random_words():
    exact, own = library(WORDS), WordEncoder(WORDS)
    rng = random.Random(8)
    for _ in range(3000):
        word = "".join(rng.choice("aeinstrlhg") for _ in range(rng.randint(1, 14)))
        assert np.frombuffer(own.encode(word), dtype="<u4").tolist() == exact.encode(word).ids, word


def test_word_queries_of_odd_rows(odd_docs):
    exact = library(WORDS)
    got = round_trip_digests(odd_docs, WORDS).collect()
    assert len(got) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            ids = exact.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    full = {r["doc_id"]: r for r in encode_texts(odd_docs, WORDS).collect()}
    assert full[3]["ids"] == exact.encode("One two three", add_special_tokens=False).ids
    assert round_trip_digests(odd_docs.limit(0), WORDS).count() == 0


def test_piece_counts(spark, sf_dir, odd_docs):
    with open(BYTES, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_of_char()
    tokens = {token_bytes(t, table) for t in vocab if t != "<|endoftext|>"}
    longest = max(map(len, tokens))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in tokens)
            n += 1
        return n

    automaton = load(BYTES)
    words = sorted({b" " + w for t in odd_texts() for w in t.encode().split()})
    assert automaton.count(words).tolist() == [greedy(w) for w in words]
    assert automaton.count([]).tolist() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    cache = {}
    for r in count_tokens(docs, BYTES).collect():
        split = texts[r["doc_id"]].encode().split()
        assert r["n_words"] == len(split)
        assert r["n_tokens"] == sum(cache.setdefault(w, greedy(b" " + w)) for w in split)
    assert count_tokens(odd_docs, BYTES).count() == odd_docs.count()
    assert count_tokens(odd_docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("size, kinds", [(0, 3), (1, 3), (2, 1), (500, 3), (5000, 40), (3000, 1)])
def test_grammar_round_trip(size, kinds):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, kinds, size).astype(np.uint32)
    grammar = compress(ids, 50_257, most=20, least=2)
    assert grammar.decode().tolist() == ids.tolist()
    left = Counter(zip(grammar.symbols[:-1].tolist(), grammar.symbols[1:].tolist(), strict=True))
    assert not left or max(left.values()) < 2
    for rule, length in zip(grammar.rules.tolist(), grammar.sizes.tolist(), strict=True):
        assert length == sum(1 if x < grammar.base else grammar.sizes[x - grammar.base] for x in rule)
    width = (grammar.base + len(grammar.rules)).bit_length()
    assert unpack_bits(pack_bits(grammar.symbols, width), len(grammar.symbols), width).tolist() == grammar.symbols.tolist()
    ends = grammar.ends()
    for _ in range(20):
        a, b = sorted(rng.integers(0, size + 1, 2).tolist())
        assert grammar.decode(a, b, ends).tolist() == ids[a:b].tolist()


def test_token_files(spark, odd_docs, monkeypatch):
    exact = library(BYTES)
    for shard in (token_files.SHARD_IDS, 50):
        path = new_path(spark)
        write_tokens(odd_docs, path, BYTES, shard_ids=shard)
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect()))
        got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
        start = 0
        for (known, doc_id, text), r in zip(rows, got, strict=True):
            ids = exact.encode(text, add_special_tokens=False).ids + [2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id if known else None, start, len(ids), ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
        for row in spark.read.parquet(path).collect():
            sizes = np.frombuffer(row["doc_sizes"], "<i8")
            grammar = grammar_of(*[row[c] for c in token_files._GRAMMAR])
            at = int(sizes[:-1].sum())
            assert grammar.decode(at, at + int(sizes[-1])).tolist() == grammar.decode()[at:].tolist()
        wanted = [None, 4, 5, 10**9]
        some = {(r["doc_id"], tuple(r["ids"])) for r in read_documents(spark, path, wanted).collect()}
        assert some == {(r["doc_id"], tuple(r["ids"])) for r in got if r["doc_id"] in wanted} and len(some) > 1
    path = new_path(spark)
    write_tokens(odd_docs.limit(0), path, BYTES)
    assert read_documents(spark, path, [1, None]).count() == 0
    assert read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packed_histogram_is_exact(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    lengths = rng.integers(1, capacity + 1, rng.integers(1, 400))
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    groups = pack_histogram(histogram, capacity, turns=60)
    held: dict[int, int] = {}
    for copies, items in groups:
        assert sum(k * times for k, times in items) <= capacity
        for k, times in items:
            held[k] = held.get(k, 0) + copies * times
    assert held == histogram
    assert sum(c for c, _ in groups) <= sum(c for c, _ in best_fit(histogram, capacity)) * 1.05 + 2
    plan = slots(groups)
    used = np.zeros((sum(c for c, _ in groups), capacity), dtype=int)
    for k, n in histogram.items():
        sequence, offset = locate(plan, np.full(n, k), np.arange(n))
        for s, o in zip(sequence, offset, strict=True):
            used[s, o : o + k] += 1
    assert used.max() == 1
    assert all((row[: row.sum()] == 1).all() for row in used)


@pytest.mark.parametrize("most", [3, 40, 3000])
def test_linear_program_places_nearly_all(most):
    rng = np.random.default_rng(most)
    lengths = np.arange(1, 201)
    counts = rng.integers(1, most + 1, len(lengths))
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    groups, rest = cover_histogram(histogram, 200)
    assert sum(rest.values()) < 0.05 * counts.sum()
    packed = groups + best_fit(rest, 200)
    assert sum(c for c, _ in packed) <= sum(c for c, _ in best_fit(histogram, 200)) * 1.01 + 1
    chosen, covered, bound = solve(lengths, counts, 200)
    held = np.zeros(len(lengths))
    for config, amount in chosen.items():
        assert sum(int(lengths[i]) * times for i, times in config) <= 200
        for i, times in config:
            held[i] += amount * times
    assert np.allclose(held, covered * counts)
    assert bound <= sum(c for c, _ in packed)


def test_price_finds_the_heaviest():
    lengths = np.array([3, 5, 7])
    found = price(np.array([3.0, 5.5, 7.0]), lengths, 16)
    assert found == {0: 2, 1: 2}
    assert pack_histogram({}, 10) == []
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10)


@pytest.mark.parametrize("total", [1, 2048, 2049, 4096, 10_000])
def test_cut(total):
    parts = cut(total, 2048)
    assert sum(parts) == total
    assert all(p == 2048 for p in parts[1:]) and 0 < parts[0] <= 2048


def test_packing_of_odd_rows(odd_docs):
    exact = library(BYTES)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"] is not None}
    got = pack(odd_docs, BYTES).toPandas()
    assert (got["offset"] + got["length"]).max() <= 2048
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows["offset"].to_numpy() == np.cumsum(rows["length"]) - rows["length"]).all()
    for i, text in texts.items():
        ids = np.array(exact.encode(text, add_special_tokens=False).ids + [0], "<u4")
        rows = got[got["doc_id"] == i].drop_duplicates("piece").sort_values("piece")
        assert rows["length"].sum() == len(ids)
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert pack(odd_docs.limit(0), BYTES).count() == 0
