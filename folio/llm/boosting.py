"""Histogram gradient-boosted trees for a 0/1 label, in numpy.

Trees are complete binary trees of a fixed depth, flattened into one array per
property: node i has the children 2i + 1 and 2i + 2. All rows walk down
together, one array step a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray    # (trees, inner nodes) int32
    threshold: np.ndarray  # (trees, inner nodes) float64: greater goes right
    leaf: np.ndarray       # (trees, leaves) float64
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Cut points of each feature: quantiles of its distinct sorted values."""
    cuts = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1], method="lower"))
        cuts.append(q)
    return cuts


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
        l2: float = 1.0, min_hessian: float = 2.0) -> Trees:
    """Fit on rows ``x`` (finite float64) with labels ``y``. One label only, or no rows: a smoothed constant."""
    pos = float(y.sum())
    base = float(np.log((pos + 1) / (len(y) - pos + 1)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not 0 < pos < len(y):
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = _bins(x, bins)
    n_feat = x.shape[1]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            choice = [(0, -1)] * width
            for f in range(n_feat):
                at = (node - first) * bins + binned[f]
                g = np.bincount(at, grad, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(at, hess, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (gt - g)**2 / (ht - h + l2) - gt**2 / (ht + l2)
                gain[(h < min_hessian) | (ht - h < min_hessian)] = 0
                gain[:, len(cuts[f]):] = 0  # nothing lies beyond the last cut
                b = gain.argmax(1)
                for n in np.flatnonzero(gain[np.arange(width), b] > best):
                    best[n], choice[n] = gain[n, b[n]], (f, b[n])
            go = np.zeros(len(y), bool)
            for n, (f, b) in enumerate(choice):
                if b >= 0:
                    feature[first + n], threshold[first + n] = f, cuts[f][b]
                    here = node == first + n
                    go[here] = binned[f][here] > b
            node = 2 * node + 1 + go
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = -rate * g / (h + l2)
        margin += value[leaf]
        out.append((feature, threshold, value))
    return Trees(*(np.stack(part) for part in zip(*out, strict=True)), base)
