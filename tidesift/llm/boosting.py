"""Gradient-boosted trees for a 0/1 label, and isotonic calibration, in numpy.

Trees are complete binary trees of a fixed depth over quantile bins; each level
takes the split with the largest Newton gain per node from histograms of
gradients and curvatures.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): go right if value > cut
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for labels 0/1; ``least`` is the smallest curvature a child may have."""
    n, width = x.shape
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cuts = np.full((width, BINS), np.inf)
    for j, e in enumerate(edges):
        cuts[j, : len(e)] = e
    flat = binned + np.arange(width) * BINS
    inner = 2**depth - 1
    features = np.zeros((trees, inner), dtype=np.int64)
    chosen = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    margin = np.full(n, start)
    for t in range(trees):
        p = sigmoid(margin)
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (count, width, BINS)
            size = count * width * BINS
            g = np.bincount(place, np.repeat(gradient, width), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(curve, width), size).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least) | (h_all - h < least) | np.isinf(cuts)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1).max(axis=1) > 1e-9
            f, b = np.divmod(best, BINS)
            features[t, first : first + count] = f
            chosen[t, first : first + count] = np.where(good, cuts[f, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > chosen[t, node])
        end = node - inner
        g = np.bincount(end, gradient, inner + 1)
        h = np.bincount(end, curve, inner + 1)
        leaves[t] = rate * g / (h + ridge)
        margin += leaves[t, end]
    return Trees(features, chosen, leaves, start)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, probability) of the monotone fit by pooling adjacent violators.

    Block means are drawn in by half an observation of either label, so no
    probability is 0 or 1.
    """
    order = np.argsort(margin, kind="stable")
    xs, inverse = np.unique(margin[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    total = np.bincount(inverse, y[order])
    blocks: list[list[float]] = []  # weight, sum, sum of margins
    for w, s, x in zip(weight, total, xs, strict=True):
        blocks.append([w, s, x * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 2] / table[:, 0], np.maximum.accumulate((table[:, 1] + 0.5) / (table[:, 0] + 1))


@dataclass
class Calibrated:
    trees: Trees
    points: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        # a trace of the margin keeps the order inside a block
        return 0.999 * np.interp(margin, self.points, self.values) + 0.001 * sigmoid(margin)


def fit_calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = 3) -> Calibrated:
    """Trees on all rows, calibrated on margins of rows that the trees of their fold have not seen."""
    margin = np.zeros(len(y))
    for k in range(folds):
        out = fold % folds == k
        if out.any() and (~out).any():
            margin[out] = fit_trees(x[~out], y[~out]).margin(x[out])
    return Calibrated(fit_trees(x, y), *isotonic(margin, y))
