"""Gradient-boosted trees with logistic loss in numpy, for small candidate tables."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on binned features; every tree is kept as flat arrays and applied level by level."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(n, dtype=np.int64)
            for node in range(size):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                leaf[node] = self.rate * g / (h + self.penalty)
                if node >= 2**self.depth - 1 or len(rows) < 8:
                    continue
                best = (1e-4, -1, 0)
                for j in range(f):
                    if not len(cuts[j]):
                        continue
                    b = binned[rows, j]
                    gl = np.bincount(b, grad[rows], len(cuts[j]) + 1).cumsum()[:-1]
                    hl = np.bincount(b, hess[rows], len(cuts[j]) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + self.penalty) + (g - gl) ** 2 / (h - hl + self.penalty) - g**2 / (h + self.penalty)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                    at[rows] = 2 * node + 1 + (x[rows, best[1]] > cut[node])
            self.trees.append((feature, cut, leaf))
            score += self._tree(x, self.trees[-1])
        return self

    def _tree(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, leaf = tree
        at, row = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            j = feature[at]
            at = np.where(j >= 0, 2 * at + 1 + (x[row, np.maximum(j, 0)] > cut[at]), at)
        return leaf[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._tree(x, tree)
        return 1 / (1 + np.exp(-score))
