"""Gradient-boosted trees in numpy, with monotonic constraints, kept as flat node arrays.

A tree of depth D is complete: inner node i has the children 2i+1 and 2i+2, so a
model is four arrays and scoring is D vectorised steps for all trees and rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature and threshold: trees x inner nodes; value: trees x leaves.  A row goes right where x > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        inner = self.feature.shape[1]
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.value[trees, node - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def sql(self, names: list[str]) -> str:
        """The margin as one SQL expression over columns called ``names``."""

        def node(tree: int, i: int) -> str:
            inner = self.feature.shape[1]
            if i >= inner:
                return f"{float(self.value[tree, i - inner])!r}D"
            left, right = node(tree, 2 * i + 1), node(tree, 2 * i + 2)
            if left == right or not np.isfinite(self.threshold[tree, i]):
                return left
            return f"IF({names[self.feature[tree, i]]} > {float(self.threshold[tree, i])!r}D, {right}, {left})"

        return " + ".join([f"{self.base!r}D", *(node(t, 0) for t in range(len(self.feature)))])


def train(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64,
    monotone: np.ndarray | None = None, l2: float = 1.0, least: float = 5.0,
) -> Trees:
    """Logistic boosting on histograms of quantile bins.

    ``monotone`` has +1, -1 or 0 for each feature: a split that would break the
    sign is not taken, and the mean of the two sides bounds what lies below.
    Without rows of both classes the model is a constant.
    """
    n, k = x.shape
    p = float(np.clip(y.mean() if n else 1.0, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    inner = (1 << depth) - 1
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if n == 0 or y.min() == y.max():
        return empty
    sign = np.zeros(k, np.int64) if monotone is None else np.asarray(monotone)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin <= b: x <= cuts[b]
    flat = binned + np.arange(k) * bins
    margin = np.full(n, base)
    trees = []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        where = np.zeros(n, np.int64)
        for i in range(inner):
            low[2 * i + 1 : 2 * i + 3], high[2 * i + 1 : 2 * i + 3] = low[i], high[i]
            rows = np.flatnonzero(where == i)
            where[rows] = 2 * i + 1
            if not len(rows):
                continue
            at = flat[rows].ravel()
            gs = np.bincount(at, np.repeat(g[rows], k), k * bins).reshape(k, bins).cumsum(1)
            hs = np.bincount(at, np.repeat(h[rows], k), k * bins).reshape(k, bins).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            left, right = np.clip(-gs / (hs + l2), low[i], high[i]), np.clip(-(gt - gs) / (ht - hs + l2), low[i], high[i])
            gain = lambda w, g, h: -(g * w + 0.5 * (h + l2) * w * w)
            parent = np.clip(-gt / (ht + l2), low[i], high[i])
            won = gain(left, gs, hs) + gain(right, gt - gs, ht - hs) - gain(parent, gt, ht)
            bad = (hs < least / 4) | (ht - hs < least / 4) | (sign[:, None] * (right - left) < 0)
            won[bad] = -np.inf
            for j, c in enumerate(cuts):
                won[j, len(c) :] = -np.inf
            j, b = np.unravel_index(np.argmax(won), won.shape)
            if won[j, b] <= 1e-6:
                continue
            feature[i], threshold[i] = j, cuts[j][b]
            where[rows] = 2 * i + 1 + (binned[rows, j] > b)
            if sign[j]:
                middle = (left[j, b] + right[j, b]) / 2
                (high if sign[j] > 0 else low)[2 * i + 1] = middle
                (low if sign[j] > 0 else high)[2 * i + 2] = middle
        leaf = where - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = rate * np.clip(-gs / (hs + l2), low[inner:], high[inner:])
        margin += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(*(np.stack(a) for a in zip(*trees, strict=True)), base)
