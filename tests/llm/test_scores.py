"""Scores and rules against brute force and on held-out rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidesift.llm import lm_scores
from tidesift.llm.boosting import fit_calibrated, fit_trees, isotonic, sigmoid
from tidesift.llm.lm_scores import score_texts
from tidesift.llm.log_bilinear import UNITS, WINDOW, Trainer, start, windows
from tidesift.llm.quality_rules import Limits, judge, keep_good
from tidesift.llm.toxicity import N_FEATURES, Lexicon, _Tokens, features, fit_toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LIMITS = Limits(min_words=3, line_texts=3, line_pct=20, left_words=2)


def brute_rules(rows, limits):
    """{(id, text, host): row of counts} for (id, text, host) rows."""
    holders = defaultdict(dict)
    texts = defaultdict(set)
    lines_of = {}
    for i, text, host in rows:
        lines = [(x, x.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for x in (text or "").split("\n") if WORD.search(x)]
        lines_of[i, text, host] = lines
        if lines:
            texts[host].add(text)
        for _, key in lines:
            held = holders[host, key].setdefault(text, i)
            holders[host, key][text] = max(held, i, key=lambda x: (x is not None, x))
    often = {
        hk: max(held.values(), key=lambda x: (x is not None, x))
        for hk, held in holders.items()
        if (len(held) >= limits.line_texts and 100 * len(held) > limits.line_pct * len(texts[hk[0]]))
        or len(held) > limits.line_most
    }
    out = {}
    for i, text, host in rows:
        words = WORD.findall(text or "")
        windows_ = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(windows_)
        covered = {k + j for k, w in enumerate(windows_) if count[w] > 1 for j in range(3)}
        lines = lines_of[i, text, host]
        lost = sum(len(WORD.findall(k)) for k in {k for _, k in lines} if often.get((host, k), i) != i)
        failed = len(words) < limits.min_words or 100 * len(covered) > limits.repeat_pct * len(words)
        left = len(words) - lost
        depleted = lost > 0 and (100 * left < limits.left_pct * len(words) or left < limits.left_words)
        out[i, text, host] = (
            len(words),
            sum(map(len, words)),
            sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len({x for x, _ in lines}),
            len(covered),
            failed,
            lost,
            not failed and not depleted,
        )
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept"]


def test_rules_against_brute_force(make_docs):
    rng = np.random.default_rng(1)
    pool = ["Subscribe to our newsletter", "all rights reserved | now", "a b c a b c", "", " \t", "x", "#tag $5 & more é 日本"]
    texts, hosts = [], []
    for i in range(200):
        own = [f"own line {i} number {k} here" for k in range(rng.integers(0, 3))]
        lines = own + [pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 4))]
        texts.append("\n".join(lines))
        hosts.append([None, "a", "b"][int(rng.integers(0, 3))])
    got = judge(make_docs(texts, sources=hosts), limits=LIMITS).collect()
    want = brute_rules(list(zip(range(200), texts, hosts, strict=True)), LIMITS)
    by_id = {k[0]: v for k, v in want.items()}
    assert len(got) == 200
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == by_id
    assert any(v[6] for v in by_id.values()) and any(not v[7] and not v[5] for v in by_id.values())


def test_rules_at_production_limits(make_docs):
    """A line goes from 3 texts on above 5 % of its host's texts, or above 1,000 texts, as op6's SQL states."""
    line = " ".join(f"shared{k}" for k in range(200))
    texts, hosts, lost = [], [], []
    for host, with_line, without in (("often", 3, 40), ("few", 2, 20), ("rare", 3, 57), ("many", 1001, 19_100), ("fewer", 1000, 19_100)):
        if host in ("often", "many"):
            lost += range(len(texts), len(texts) + with_line - 1)
        for i in range(with_line + without):
            own = " ".join(f"{host}{i}word{k}" for k in range(60 if i < with_line else 1))
            texts.append(f"{own}\n{line}" if i < with_line else own)
            hosts.append(host)
    got = judge(make_docs(texts, sources=hosts)).collect()
    want = brute_rules(list(zip(range(len(texts)), texts, hosts, strict=True)), Limits())
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == {k[0]: v for k, v in want.items()}
    assert sorted(r["doc_id"] for r in got if r["lost_words"]) == lost
    assert not any(r["kept"] for r in got if r["lost_words"])


def test_rules_act_on_the_given_tables(spark):
    """Lines go at the smallest size, too, and no long text is rejected for them."""
    got = judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r["lost_words"] > 0 for r in got) > 100
    assert not any(r["n_words"] >= 50 and not r["base_failed"] and not r["kept"] for r in got)


def test_rules_spare_copies(make_docs):
    text = "\n".join(" ".join(f"w{9 * k + j}" for j in range(9)) for k in range(9))
    docs = make_docs([text] * 50 + [f"{text}\nand {i} more" for i in range(2)], sources=["h"] * 52)
    assert {r["lost_words"] for r in judge(docs, limits=LIMITS).collect() if r["doc_id"] == 51} == {0}
    assert judge(make_docs([text] * 50), limits=LIMITS).filter("kept").count() == 50


def test_rules_of_odd_rows(odd_docs):
    got = judge(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["n_words"] == 0 and by_id[0]["base_failed"]
    assert by_id[4]["n_words"] == by_id[4]["n_repeat_words"] == 30_000
    assert keep_good(odd_docs).columns == odd_docs.columns
    assert keep_good(odd_docs).count() == 0
    assert judge(odd_docs.limit(0)).count() == 0


def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    p = np.where((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3), 0.9, 0.1)
    y = (rng.random(3000) < p).astype(float)
    trees = fit_trees(x[:2000], y[:2000])
    assert ((trees.margin(x[2000:]) > 0) == (p[2000:] > 0.5)).mean() > 0.95
    model = fit_calibrated(x[:2000], y[:2000], np.arange(2000))
    score = model.score(x[2000:])
    assert ((score > 0) & (score < 1)).all()
    assert abs(score[p[2000:] > 0.5].mean() - 0.9) < 0.06
    points, values = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(points) > 0).all() and (np.diff(values) >= 0).all()
    assert sigmoid(np.array([0.0]))[0] == 0.5


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = fit_toxicity(docs, labels).score(docs).toPandas()
    assert len(got) == docs.count()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    joined = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    toxic, clean = (joined[joined["toxic"] == k]["score"].to_numpy() for k in (1, 0))
    assert (toxic[:, None] > clean[None, :]).mean() > 0.98
    assert (toxic >= 0.7).mean() > 0.85 and (clean >= 0.7).mean() < 0.01


def test_toxicity_of_odd_rows(spark, odd_docs):
    def labels(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    none = fit_toxicity(odd_docs, labels([])).score(odd_docs).collect()
    assert len(none) == odd_docs.count() and {r["score"] for r in none} == {0.0}
    assert {r["score"] for r in fit_toxicity(odd_docs, labels([(0, 1, 1), (2, 1, 1), (None, 1, 0)])).score(odd_docs).collect()} == {1.0}
    model = fit_toxicity(odd_docs, labels([(i, 1, i % 2) for i in range(9)] + [(3, None, None), (None, 0, 1)]))
    assert model.score(odd_docs).count() == odd_docs.count()
    assert model.score(odd_docs.limit(0)).count() == 0
    assert model.keep_clean(odd_docs).columns == odd_docs.columns


def test_features_see_hidden_words():
    lexicon = Lexicon({"w moron": (40, 40), "5 moron": (40, 40)}, 50, 500)
    tokens = _Tokens(lexicon)
    plain, none, hidden = (features(t, tokens) for t in ("You are a moron!", "You are a maroon!", "you m0r0n"))
    assert len(plain) == N_FEATURES
    assert plain[2] == 1 and plain[12] == 1
    assert none[2] == 0 and none[10] == 0
    assert hidden[10] == 1
    # a training row does not see its own vote
    rare = Lexicon({"w moron": (3, 3)}, 50, 500)
    assert rare.weight("w moron") > 0 and rare.weight("w moron", 1) == 0


def brute_base(rows):
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, _), ws, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [10**6, 5])
def test_base_scores(make_docs, spark, sf_dir, monkeypatch, head):
    monkeypatch.setattr(lm_scores, "HEAD_WORDS", head)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = score_texts(docs).collect()
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=repr) == brute_base(rows)
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(odd_docs, make_docs):
    got = score_texts(odd_docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=repr) == brute_base(rows)
    assert all(r["score"] is not None and np.isfinite(r["score"]) for r in got)
    assert score_texts(odd_docs.limit(0)).count() == 0
    untrained = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    alone = score_texts(make_docs(["a b", "", None], ids=untrained)).collect()
    assert {r["train_tokens"] for r in alone} == {0} and all(np.isfinite(r["score"]) for r in alone)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    # units follow each other in two separate loops
    sequences = [np.array([(s % 2) * 10 + 1 + (k + s) % 5 for k in range(40)], dtype=np.uint8) for s in range(400)]
    counts = np.bincount(np.concatenate(sequences), minlength=UNITS).astype(float)
    contexts, targets = windows(sequences, 0)
    assert contexts.shape == (400 * 40, WINDOW) and (contexts[0] == 0).all()
    trainer = Trainer(start(counts), counts, 1)
    before = trainer.model.log_probabilities(contexts, targets).mean()
    for _ in range(6):
        trainer.feed(contexts, targets)
    assert trainer.model.log_probabilities(contexts, targets).mean() > before + 1
    some = contexts[rng.integers(0, len(contexts), 20)]
    total = sum(np.exp(trainer.model.log_probabilities(some, np.full(20, u))) for u in range(UNITS))
    assert np.allclose(total, 1)


def test_class_shares_add_up(make_docs):
    """Words of a class and its unseen share sum to one."""
    found = {}
    docs = ["tion nation nation station motion", "ration ration lotion notion x y z"] * 3
    keep = lm_scores.gather_counts

    def spy(counts, ends):
        found["rows"] = [(bytes(r["word"]), r["n"]) for r in counts.collect()]
        found["counts"] = keep(counts, ends)
        return found["counts"]

    lm_scores.gather_counts, short = spy, lm_scores.SHORT_LIST
    lm_scores.SHORT_LIST = 1
    try:
        score_texts(make_docs(docs, ids=[0, 2, 4, 6, 8, 10])).collect()
    finally:
        lm_scores.gather_counts, lm_scores.SHORT_LIST = keep, short
    counts = found["counts"]
    sums = defaultdict(float)
    for word, n in found["rows"]:
        if word not in counts.short:
            sums[lm_scores.class_of(word)] += 10 ** counts.within(word, n)
    for u, total in sums.items():
        assert total + 10 ** counts.unseen[u] == pytest.approx(1)


def test_known_words_keep_their_numbers_in_step():
    head = {b"ab": 5, "né".encode(): 3, b"\xff": 2}
    counts = lm_scores.Counts(20, 5, 4, {b"ab": 1}, head, np.full(UNITS, 9.0), np.full(UNITS, 0.5), np.full(UNITS, -2.0))
    known = lm_scores._Known(counts)
    words = [b"ab", "né".encode(), b"\xff", b"new", b"x", "日本".encode(), b"ab"] + [b"w%d" % i for i in range(3000)]
    for _ in range(2):
        seen = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        assert [known.words[i] for i in seen] == words
        assert known.unit[seen].tolist() == [counts.unit(w) for w in words]
        assert known.head[seen].tolist() == [w in head for w in words]
        assert known.base[seen].tolist() == [counts.base(head[w]) if w in head else 0.0 for w in words]
        assert known.within[seen].tolist() == [counts.within(w, head[w]) if w in head else 0.0 for w in words]
        known._empty()
        known[b"x"]  # numbers begin anew, nothing of before is left


def test_class_is_of_the_last_two_characters():
    for word in (b"a", b"ing", "né".encode(), "日本語".encode(), b"a\xff", b"\xe6\x97x", b"xy\xc3"):
        tail = word.decode(errors="replace")[-2:].encode()
        assert lm_scores.class_of(word) == UNITS - lm_scores.CLASSES + zlib.crc32(tail) % lm_scores.CLASSES


def test_large_scores_are_shifted():
    model = start(np.ones(UNITS))
    model.outputs *= 3000
    contexts = np.arange(5 * 40).reshape(40, 5) % UNITS
    logs = [model.log_probabilities(contexts, np.full(40, u)) for u in range(UNITS)]
    assert np.isfinite(logs).all() and np.allclose(np.exp(logs).sum(axis=0), 1, atol=1e-4)


def test_words_are_split_as_by_python():
    texts = ["", " \t\n", "a  B ", "\x1c\x1dX\x1eY\x1fz\x85q\xa0r", "É é ÀB c　d", "".join(map(chr, range(256))), "A\x00b a\x00B", "w " * 50]
    places, rows, words = lm_scores.split_words(pa.array(texts))
    listed = words.to_pylist()
    assert len(set(listed)) == len(listed)
    for i, text in enumerate(texts):
        assert [listed[p] for p in places[rows == i]] == text.encode().lower().split()
    assert [len(a) for a in lm_scores.split_words(pa.array([], pa.string()))] == [0, 0, 0]


def test_classes_are_found_once_for_every_ending(monkeypatch):
    words = [b"w%d-%s" % (i, end) for i in range(500) for end in (b"ing", b"x", "né".encode(), "日本".encode(), b"\xff", b"\xe6\x97x")]
    words += [b"a", "é".encode(), "😀".encode(), b"\xa9", b"xy\xc3", b""]
    each = lm_scores.class_of
    expected, calls = [each(w) for w in words], []
    monkeypatch.setattr(lm_scores, "class_of", lambda w: calls.append(w) or each(w))
    assert lm_scores.classes_of(pa.array(words, pa.binary())).tolist() == expected
    known = lm_scores._Known(lm_scores.Counts(0, 0, 0))
    plain = [b"%d-%s" % (i, end) for i in range(500) for end in (b"ing", b"ed")]
    calls.clear()
    assert known.unit[known.numbers(pa.array(plain, pa.binary()))].tolist() == [each(w) for w in plain]
    assert len(calls) == 2


@pytest.mark.parametrize("piece", [1, 40, 8 << 20])
def test_pieces_keep_all_rows(monkeypatch, piece):
    monkeypatch.setattr(lm_scores, "PIECE", piece)
    texts = pa.array(["a b", "", "c " * 100, "", "d", "e f g"])
    batches = [pa.RecordBatch.from_arrays([texts], names=["text"]), pa.RecordBatch.from_arrays([texts.slice(0, 0)], names=["text"])]
    pieces = list(lm_scores.pieces_of(iter(batches), 0))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == texts.to_pylist()
    assert all(sum(map(len, p.column(0).to_pylist()[:-1])) <= piece for p in pieces)


def test_scores_are_the_softmax_of_all_units():
    rng = np.random.default_rng(5)
    model = start(rng.integers(1, 10_000, UNITS).astype(float))
    model.inputs *= 5
    contexts, targets = rng.integers(0, UNITS, (5000, WINDOW)), rng.integers(0, UNITS, 5000)
    got = model.log_probabilities(contexts, targets)
    r = sum(model.inputs.astype(float)[contexts[:, j]] * model.near[j] for j in range(WINDOW))
    s = r @ model.outputs.T.astype(float) + model.bias
    assert np.allclose(got, s[np.arange(5000), targets] - np.log(np.exp(s).sum(axis=1)), atol=1e-5)
