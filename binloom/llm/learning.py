"""What the two classifiers share: a bounded training sample, and small numpy models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(labels: DataFrame, doc_id: str, label: str, bound: int) -> DataFrame:
    """(id, label, fold 0-3) of labelled ids: all, or about bound of them chosen by a hash of the id.

    Rows without id or label are left out; of several labels of an id the largest counts.
    The result has a proven size, so it may be broadcast.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    total = known.count()
    draw = F.xxhash64(F.lit(5), "_id")
    if total > bound:
        known = known.filter(F.pmod(draw, F.lit(1 << 20)) < int((1 << 20) * bound / total))
    return known.withColumn("_fold", F.pmod(F.shiftright(draw, 24), F.lit(4)).cast("int"))


def joined(docs: DataFrame, sampled: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts of the sample with _label and _fold."""
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sampled), "_id").select("_text", "_label", "_fold")


class Logistic:
    """Logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> None:
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.weights = np.zeros(z.shape[1])
        if len(x) == 0 or y.min() == y.max():  # nothing to tell apart: the share of label 1
            self.weights[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            return
        for _ in range(rounds):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (p - y) / len(y) + ridge * self.weights
            curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(z.shape[1])
            move = np.linalg.solve(curve, slope)
            self.weights -= move
            if np.abs(move).max() < 1e-8:
                break

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


class TwoLayers:
    """A hidden layer of tanh units and a logistic output, fitted by Adam, its logit divided by a temperature fitted on rows of its own."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.temperature = 1.0
        d = x.shape[1]
        p = [rng.normal(size=(d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(1)]
        self.parts = p
        if len(x) == 0 or y.min() == y.max():
            p[2][:], p[3][:] = 0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            return
        z = (x - self.mean) / self.scale
        use = np.flatnonzero(fold != 3)
        if len(np.unique(y[use])) < 2:
            use = np.arange(len(y))
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for epoch in range(epochs):
            order = rng.permutation(use)
            for at in range(0, len(order), 256):
                k = order[at : at + 256]
                h = np.tanh(z[k] @ p[0] + p[1])
                out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[k]
                back = np.outer(out, p[2]) * (1 - h * h)
                grads = [z[k].T @ back / len(k) + 1e-4 * p[0], back.mean(axis=0), h.T @ out / len(k) + 1e-4 * p[2], np.array([out.mean()])]
                step += 1
                for w, g, a, b in zip(p, grads, m, v, strict=True):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    w -= rate / (1 + epoch / 15) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        apart = np.flatnonzero(fold == 3)
        if len(np.unique(y[apart])) == 2:
            logit = self._logit(x[apart])
            loss = lambda t: np.logaddexp(0, np.where(y[apart] == 1, -logit, logit) / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 120), key=loss))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))
