"""Whitening against an eigendecomposition of the whole covariance, and its exact sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidesift.llm import whitening
from tidesift.llm.queries import op12_whitening
from tidesift.llm.whitening import Centre, bidiagonalise, exact_sums, fit_whitening


def brute(vectors):
    """n, deviations, eigenvalues and eigenvectors of the covariance of (id, vector) rows."""
    usable = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in usable], dtype=np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    away = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = x - np.array(sums) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in usable], n, away, centred, e[::-1], q[:, ::-1]


def hold(model, rows, ids, n, away, centred, e, q, components):
    assert model.centre.n == n and len(model.variances) == components
    assert np.allclose(model.variances, e[:components], rtol=1e-10)
    assert model.trace == pytest.approx(e.sum(), rel=1e-10) and model.identity_error < 1e-9
    found = sorted((r[0], r["deviation"], *r["whitened"]) for r in rows)
    want = centred @ (q[:, :components] / np.sqrt(e[:components]))
    order = np.lexsort((away, ids))
    got = np.array([f[2:] for f in found])
    assert [f[:2] for f in found] == [(ids[i], away[i]) for i in order]
    for k in range(components):
        sign = np.sign(np.dot(got[:, k], want[order, k]))
        assert np.allclose(sign * got[:, k], want[order, k], atol=1e-7)


def test_all_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids, n, away, centred, e, q = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    model = fit_whitening(table)
    hold(model, model.rows().collect(), ids, n, away, centred, e, q, 8)
    rows = op12_whitening(spark, sf_dir).collect()
    assert len(rows) == 8 * n and {r["component"] for r in rows} == set(range(1, 9))
    for r in rows:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-6)


@pytest.mark.parametrize("rank,width", [(1, 4), (3, 12), (12, 12), (40, 200)])
def test_bidiagonalisation(rank, width):
    rng = np.random.default_rng(rank)
    x = rng.standard_normal((500, rank)) * np.logspace(0, -3, rank) @ np.linalg.qr(rng.standard_normal((width, rank)))[0].T
    steps = []

    def multiply(made, w):
        steps.append(made.shape[1])
        u = x @ w
        return (x @ made).T @ u, float(u @ u), x.T @ u

    values, vectors = bidiagonalise(multiply, width, 5)
    _, want, turned = np.linalg.svd(x, full_matrices=False)
    m = min(5, rank)
    assert np.allclose(values[:m], want[:m], rtol=1e-11) and (values[rank:] < 1e-9).all()
    assert np.allclose(np.abs(np.sum(vectors[:, :m].T * turned[:m], axis=1)), 1, atol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    if width == 200:
        assert max(steps) < 100  # far from all directions


def test_equal_deviations():
    x = np.vstack([np.eye(9) * s for s in (3, -3)])  # one value, nine directions

    def multiply(made, w):
        u = x @ w
        return (x @ made).T @ u, float(u @ u), x.T @ u

    values, vectors = bidiagonalise(multiply, 9, 8)
    assert np.allclose(values[:8], np.sqrt(18)) and np.allclose(vectors[:, :8].T @ vectors[:, :8], np.eye(8))


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(5).round(3).tolist()) for i in range(60)]
    odd = [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (7, good[7][1]), (7, good[7][1]), (61, None), (62, []), (63, [1.0] * 4)]
    odd += [(64, [1.0, None, 1.0, 1.0, 1.0]), (65, [float("nan")] * 5), (66, [1.0, float("inf"), 0.0, 0.0, 0.0]), (67, [1e30] * 5)]
    rows = [(i, v, "z", 1) for i, v in good + odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, ids int").repartition(3)
    ids, n, away, centred, e, q = brute([(-1 if i is None else i, v) for i, v in good + odd[:3]])
    model = fit_whitening(table)
    assert n == 63
    found = [(-1 if r[0] is None else r[0], r["deviation"], r["whitened"]) for r in model.rows().collect()]
    assert sorted(f[:2] for f in found) == sorted(zip(ids, away, strict=True))
    assert np.allclose(model.variances, e[:5], rtol=1e-10) and model.identity_error < 1e-9
    assert np.allclose(np.array([f[2] for f in found]).std(axis=0), 1)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_nothing_to_whiten(spark, vectors):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    model = fit_whitening(table)
    assert model.rows().count() == 0 and not len(model.variances)


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(4)
    data = [(i, rng.standard_normal(3).tolist()) for i in range(200)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(30)
    ids, n, away, centred, e, q = brute(data)
    model = fit_whitening(table)
    hold(model, model.rows().collect(), ids, n, away, centred, e, q, 3)


def test_exact_arithmetic():
    x = np.array([[2**61, -(2**61)], [2**61 - 1, 5], [2**61, 7]], dtype=np.int64)
    sums = exact_sums(x)
    assert sums == [3 * 2**61 - 1, 12 - 2**61]
    assert Centre(3, sums).distances(x) == [None] * 3
    small = np.array([[3, 10], [4, 20], [9, 30]], dtype=np.int64)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, (16, 60), strict=True)) for row in small]
    assert Centre(3, [16, 60]).distances(small) == want
