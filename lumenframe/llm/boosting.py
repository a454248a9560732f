"""Gradient-boosted regression trees on the logistic loss (Friedman 2001), in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of equal depth, stored level by level."""

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves, the step included

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, step: float = 0.2, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    """Fits by Newton steps on histograms; no randomness."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = max(len(e) for e in edges) + 1
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    score = np.full(len(x), base)
    inner = 2**depth - 1
    model = BoostedTrees(depth, base, np.zeros((trees, inner), np.int64), np.zeros((trees, inner)), np.zeros((trees, inner + 1)))
    n_features = x.shape[1]
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            cells = many * width
            sums = np.empty((2, n_features, many, width))
            for f in range(n_features):
                key = at * width + coded[:, f]
                sums[0, f] = np.bincount(key, g, cells).reshape(many, width)
                sums[1, f] = np.bincount(key, h, cells).reshape(many, width)
            left = sums.cumsum(axis=3)
            whole = left[..., -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge)
            for f, e in enumerate(edges):
                gain[f, :, len(e) :] = -1.0  # the last bin leaves nothing to the right
            best = gain.transpose(1, 0, 2).reshape(many, -1).argmax(axis=1)
            f, b = best // width, best % width
            model.feature[t, first : first + many] = f
            model.threshold[t, first : first + many] = [edges[i][j] if j < len(edges[i]) else np.inf for i, j in zip(f, b, strict=True)]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[at]] > model.threshold[t, node])
        at = node - inner
        model.leaf[t] = step * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += model.leaf[t][at]
    return model
