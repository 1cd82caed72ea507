"""Log-bilinear neural model over 256 output units, trained by noise-contrastive estimation, in numpy.

The unit of the next token is predicted from the units of the ``WINDOW`` tokens
before it: r = sum_j c_j * q(u_j) with one weight vector c_j per distance, score
s(u) = r . w(u) + b(u). Training sees the true unit against noise units drawn
from their corpus frequencies. Scoring normalises: a batch of predictions times
the matrix of all units, then log-softmax.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

UNITS = 256
WIDTH = 32
WINDOW = 5
NOISE = 64
BATCH = 2048
RATE = 0.1
SAFE = 60.0  # sums of exponentials up to this stay inside single precision


@dataclass
class Model:
    inputs: np.ndarray  # q: (UNITS, WIDTH)
    near: np.ndarray  # c: (WINDOW, WIDTH)
    outputs: np.ndarray  # w: (UNITS, WIDTH)
    bias: np.ndarray  # b: (UNITS,)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inputs.ravel(), self.near.ravel(), self.outputs.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        a, b, c = UNITS * WIDTH, WINDOW * WIDTH, UNITS * WIDTH
        flat = np.asarray(flat, dtype=np.float32)
        return Model(
            flat[:a].reshape(UNITS, WIDTH).copy(),
            flat[a : a + b].reshape(WINDOW, WIDTH).copy(),
            flat[a + b : a + b + c].reshape(UNITS, WIDTH).copy(),
            flat[a + b + c :].copy(),
        )

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        """Predicted vectors for (n, WINDOW) units, nearest first."""
        r = (self.inputs * self.near[0]).take(contexts[:, 0], axis=0)
        for j in range(1, WINDOW):
            r += (self.inputs * self.near[j]).take(contexts[:, j], axis=0)
        return r

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each target unit."""
        out = np.empty(len(targets))
        # no score is larger than this; small ones need no shift before the exponential
        reach = sum(np.linalg.norm(self.inputs * c, axis=1).max() for c in self.near)
        most = reach * np.linalg.norm(self.outputs, axis=1).max() + np.abs(self.bias).max()
        to_scores = np.ascontiguousarray(self.outputs.T)
        weights = np.exp(self.bias) if most < SAFE else None
        # written anew for every batch, as fresh memory costs more than the sums
        scores = np.empty((min(BATCH, len(targets)), UNITS), dtype=np.float32)
        for low in range(0, len(targets), BATCH):
            part = slice(low, low + BATCH)
            r = self.predict(contexts[part])
            s = np.matmul(r, to_scores, out=scores[: len(r)])
            if weights is None:
                s += self.bias
                s -= s.max(axis=1, keepdims=True)
                own = s[np.arange(len(s)), targets[part]].astype(np.float64)
                total = np.exp(s, out=s).sum(axis=1)
            else:
                own = s.ravel().take(np.arange(0, s.size, UNITS) + targets[part]) + self.bias.take(targets[part]).astype(np.float64)
                total = np.exp(s, out=s) @ weights
            out[part] = own - np.log(total.astype(np.float64))
        return out


def start(counts: np.ndarray, seed: int = 11) -> Model:
    """A model that begins at the units' frequencies."""
    rng = np.random.default_rng(seed)
    share = (counts + 0.5) / (counts.sum() + 0.5 * UNITS)
    near = np.full((WINDOW, WIDTH), 1 / WINDOW, dtype=np.float32)
    small = [rng.normal(0, 0.1, (UNITS, WIDTH)).astype(np.float32) for _ in range(2)]
    return Model(small[0], near, small[1], np.log(share).astype(np.float32))


def windows(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, targets) of all tokens; before a sequence stand end units."""
    size = sum(len(s) for s in sequences) + WINDOW * len(sequences)
    line = np.full(size, end, dtype=np.uint8)
    target = np.zeros(size, dtype=bool)
    at = 0
    for s in sequences:
        at += WINDOW
        line[at : at + len(s)] = s
        target[at : at + len(s)] = True
        at += len(s)
    places = np.flatnonzero(target)
    contexts = np.stack([line.take(places - j) for j in range(1, WINDOW + 1)], axis=1)
    return contexts, line.take(places)


def _summed(rows: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct units and the sums of their rows."""
    order = np.argsort(units, kind="stable")
    ordered = units.take(order)
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered.take(heads).astype(np.int64), np.add.reduceat(rows.take(order, axis=0), heads, axis=0)


class Trainer:
    """Adagrad on the noise-contrastive objective."""

    def __init__(self, model: Model, counts: np.ndarray, seed: int):
        self.model = model
        self.rng = np.random.default_rng(seed)
        share = (counts + 0.5) / (counts.sum() + 0.5 * UNITS)
        self.ladder = np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.squares = [np.full_like(x, 1e-2) for x in (model.inputs, model.near, model.outputs, model.bias)]

    def _step(self, kind: int, table: np.ndarray, at, gradient: np.ndarray) -> None:
        squares = self.squares[kind]
        squares[at] += gradient**2
        table[at] += RATE * gradient / np.sqrt(squares[at])

    def batch(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        m, n = self.model, len(targets)
        noise = np.unique(np.minimum(np.searchsorted(self.ladder, self.rng.random(NOISE)), UNITS - 1), return_counts=True)
        drawn, times = noise[0], noise[1].astype(np.float32)
        r = m.predict(contexts)
        own, others = m.outputs.take(targets, axis=0), m.outputs[drawn]
        true = np.einsum("ij,ij->i", r, own) + m.bias.take(targets) - self.log_noise.take(targets)
        pull = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        # times / (1 + exp(-clipped score)), in one place
        push = r @ others.T
        push += m.bias[drawn] - self.log_noise[drawn]
        np.clip(push, -30, 30, out=push)
        np.negative(push, out=push)
        np.exp(push, out=push)
        push += 1
        np.divide(times, push, out=push)
        to_r = np.multiply(own, pull[:, None], out=own)
        to_r -= push @ others
        scale = np.float32(1 / n)
        pulls = np.empty((n, WIDTH + 1), dtype=np.float32)
        np.multiply(r, pull[:, None], out=pulls[:, :WIDTH])
        pulls[:, WIDTH] = pull
        units, pulled = _summed(pulls, targets)
        gradient = np.zeros((UNITS, WIDTH + 1), dtype=np.float32)
        gradient[units] = pulled
        gradient[drawn, :WIDTH] -= push.T @ r
        gradient[drawn, WIDTH] -= push.sum(axis=0)
        gradient *= scale
        to_inputs = np.zeros((UNITS, WIDTH), dtype=np.float32)
        to_near = np.zeros_like(m.near)
        for j in range(WINDOW):
            units, summed = _summed(to_r, contexts[:, j])
            to_inputs[units] += summed * m.near[j]
            to_near[j] = (summed * m.inputs[units]).sum(axis=0)
        self._step(0, m.inputs, slice(None), to_inputs * scale)
        self._step(1, m.near, slice(None), to_near * scale)
        self._step(2, m.outputs, slice(None), gradient[:, :WIDTH])
        self._step(3, m.bias, slice(None), gradient[:, WIDTH])

    def feed(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        order = self.rng.permutation(len(targets))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            self.batch(contexts.take(part, axis=0), targets.take(part))
