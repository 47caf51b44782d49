"""Gradient-boosted trees for a yes-or-no label, in numpy, for tables that fit a driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, Newton leaf values, splits on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth, self.least = rounds, depth, rate, bins, smooth, least
        self.start, self.trees, self.edges = 0.0, [], []
        self.slope, self.shift = 1.0, 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
        b, p = self._bin(x), np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds if 0 < y.sum() < len(y) else 0):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - q, q * (1 - q), np.arange(len(y)), self.depth)
            f += self._apply(tree, b)
            self.trees.append(tree)
        return self

    def _grow(self, b, g, h, rows, depth):
        value = self.rate * g[rows].sum() / (h[rows].sum() + self.smooth)
        if not depth or len(rows) < 2 * self.least:
            return value
        best, (G, H) = (1e-6, None, None), (g[rows].sum(), h[rows].sum())
        for j in range(b.shape[1]):
            n = len(self.edges[j]) + 1
            if n < 2:
                continue
            gl, hl, cl = (np.cumsum(np.bincount(b[rows, j], w, n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + self.smooth) + (G - gl) ** 2 / (H - hl + self.smooth) - G**2 / (H + self.smooth)
            gain[(cl < self.least) | (len(rows) - cl < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            return value
        left = b[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _apply(self, tree, b):
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        j, k, left, right = tree
        return np.where(b[:, j] <= k, self._apply(left, b), self._apply(right, b))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(np.asarray(x, float))
        return self.start + sum((self._apply(t, b) for t in self.trees), np.zeros(len(b)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> BoostedTrees:
        """Fit a slope and a shift of the raw score on rows that the trees did not see."""
        f, w = self.raw(x), np.array([1.0, 0.0])
        z = np.column_stack([f, np.ones(len(f))])
        for _ in range(steps if len(y) else 0):
            q = 1 / (1 + np.exp(-z @ w))
            a = z.T @ (z * (q * (1 - q))[:, None]) + 1e-2 * np.eye(2)
            w = w + np.clip(np.linalg.solve(a, z.T @ (y - q) - 1e-2 * (w - [1, 0])), -1, 1)
        self.slope, self.shift = max(float(w[0]), 1e-3), float(w[1])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift))) if len(x) else np.empty(0)
