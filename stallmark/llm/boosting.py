"""Gradient-boosted trees on histograms, for two classes, and their traversal as flat arrays.

``fit`` runs on a bounded table in memory: values are cut at quantiles into at most BINS bins; a level of a tree adds up
gradients by (node, feature, bin) and splits each node where the gain is largest. Trees are complete, of one depth;
node k has the children 2k + 1 and 2k + 2, so that a forest is three arrays and all rows step down together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray   # tree, inner node
    cut: np.ndarray       # tree, inner node: larger values go right
    leaf: np.ndarray      # tree, leaf
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 1.0,
        least: float = 1.0) -> Trees:
    """Trees for rows ``x`` with labels ``y`` (0 or 1). One class only, or no rows, gives its smoothed share everywhere."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, width = (1 << depth) - 1, x.shape[1]
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    offset = binned + np.arange(width) * BINS
    total, found = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * BINS) + offset).ravel()
            sums = [np.bincount(at, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS).cumsum(axis=2)
                    for v in (grad, weight)]
            g, h = sums
            gain = lambda a, b: a * a / (b + smooth)
            better = gain(g, h) + gain(g[..., -1:] - g, h[..., -1:] - h) - gain(g[..., -1:], h[..., -1:])
            better[(h < least) | (h[..., -1:] - h < least)] = 0
            best = better.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), BINS)
                if better[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaves = node - inner
        g, h = (np.bincount(leaves, v, inner + 1) for v in (grad, weight))
        leaf = rate * g / (h + smooth)
        total += leaf[leaves]
        found.append((feature, cut, leaf))
    return Trees(*(np.stack(a) for a in zip(*found)), start)
