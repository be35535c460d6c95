"""Gradient-boosted trees on binned features: logistic loss, depth-wise, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth. A row goes right where its feature exceeds the cut."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boost regression trees on the gradient and curvature of the logistic loss."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    f = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-9)
            total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
            whole = total_g**2 / (total_h + ridge)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = local * bins + binned[:, j]
                gl = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hl = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole[:, None]
                gain[(hl < 1e-3) | (hr < 1e-3)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for i in np.flatnonzero(top > best):
                    best[i] = top[i]
                    feature[first + i], cut[first + i] = j, edges[j][at[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        f += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(values))
