"""Logistic regression over hashed features, and the calibration of its scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    """Weights of hashed features. ``scale`` and ``shift`` turn a score into a calibrated log-odds."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def score(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of sums of weights."""
        return 1 / (1 + np.exp(-np.clip(self.scale * (sums + self.bias) + self.shift, -40, 40)))


def fit(rows: np.ndarray, features: np.ndarray, values: np.ndarray, labels: np.ndarray, size: int, rounds: int = 80, rate: float = 0.5, shrink: float = 1e-6) -> Logistic:
    """Weights by full-batch adaptive gradients. Entry i says that row ``rows[i]`` has ``features[i]`` with ``values[i]``; labels are probabilities, one per row."""
    w, g2, b, b2 = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8
    n = len(labels)
    # entries of the same row and feature are added up once
    pairs, where = np.unique(rows.astype(np.int64) * size + features, return_inverse=True)
    values = np.bincount(where, values, len(pairs))
    rows, features = pairs // size, pairs % size
    for _ in range(rounds if n else 0):
        s = np.bincount(rows, w[features] * values, n) + b
        gap = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - labels
        grad = np.bincount(features, gap[rows] * values, size) / n + shrink * w
        g2 += grad**2
        w -= rate * grad / np.sqrt(g2)
        own = float(gap.mean())
        b2 += own**2
        b -= rate * own / np.sqrt(b2)
    return Logistic(w, b)


#: Gaps between likelihood and label are rounded to this part, so that sums of them are exact in any order.
FINE = 1 << 24


@dataclass
class Packed:
    """Rows of examples: entry i says that row ``rows[i]`` has ``features[i]``; labels are probabilities, and each row stands for ``times`` of its like."""

    rows: np.ndarray
    features: np.ndarray
    labels: np.ndarray
    times: np.ndarray

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The gaps of all rows by feature, in parts of FINE: whole numbers, exact below 2^53."""
        s = np.bincount(self.rows, weights[self.features], len(self.labels))
        gap = np.rint((1 / (1 + np.exp(-np.clip(s, -40, 40))) - self.labels) * FINE) * self.times
        return np.bincount(self.features, gap[self.rows], len(weights))


class Descent:
    """Weights by full-batch adaptive gradients, one round at a time; each has the number of examples that its gaps are averaged over."""

    def __init__(self, sizes: np.ndarray, shrink: np.ndarray, rate: float):
        self.sizes, self.shrink, self.rate = np.maximum(sizes, 1.0), shrink, rate
        self.weights, self.squares = np.zeros(len(sizes)), np.full(len(sizes), 1e-8)

    def step(self, sums: np.ndarray) -> None:
        grad = sums / FINE / self.sizes + self.shrink * self.weights
        self.squares += grad**2
        self.weights -= self.rate * grad / np.sqrt(self.squares)


def calibrate(model: Logistic, sums: np.ndarray, labels: np.ndarray, rounds: int = 50) -> Logistic:
    """The model with scale and shift by Platt's method, on rows that it was not fitted on. Without rows of both kinds it stays as it is."""
    n = len(labels)
    positive = float(np.sum(labels))
    if not 0 < positive < n:
        return model
    target = np.where(labels > 0.5, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
    x = sums + model.bias
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        v = p * (1 - p) + 1e-9
        gap = p - target
        h = np.array([[np.sum(v * x * x) + 1e-6, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 1e-6]])
        step = np.linalg.solve(h, np.array([np.sum(gap * x), np.sum(gap)]))
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, c = a - step[0], c - step[1]
    return Logistic(model.weights, model.bias, float(max(a, 1e-3)), float(c))
