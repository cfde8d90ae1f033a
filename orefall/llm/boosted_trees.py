"""Histogram gradient-boosted trees for two classes, kept as flat arrays that numpy walks for all rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth: node i's children are 2 i + 1 and 2 i + 2, leaves come last."""

    feature: np.ndarray  # trees by inner nodes
    threshold: np.ndarray  # rows with a value above it go right
    leaf: np.ndarray  # trees by leaves
    start: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            z += v[node - (2**self.depth - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def constant(p: float) -> Forest:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Forest(np.zeros((0, 0), dtype=np.int64), np.zeros((0, 0)), np.zeros((0, 0)), float(np.log(p / (1 - p))), 0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Newton boosting of the log loss over binned features. A split needs `least` hessian on both sides, else rows stay left."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = code + np.arange(m) * bins
    start = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * bins) + flat).ravel()
            shape = (width, m, bins)
            sg = np.bincount(at, np.repeat(g, m), width * m * bins).reshape(shape).cumsum(axis=2)
            sh = np.bincount(at, np.repeat(h, m), width * m * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = sg[:, :1, -1:], sh[:, :1, -1:]
            right_g, right_h = all_g - sg, all_h - sh
            gain = sg**2 / (sh + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
            gain = np.where((sh >= least) & (right_h >= least), gain, 0.0)
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        at = node - inner
        v = -np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2) * rate
        z += v[at]
        fs.append(f)
        ts.append(t)
        vs.append(v)
    return Forest(np.stack(fs), np.stack(ts), np.stack(vs), start, depth)
