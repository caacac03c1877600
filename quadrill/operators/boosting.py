"""List-wise boosting in numpy: regression trees on the gradients of a ranking loss, for a bounded number of queries.

Every query has one true target, its first row. A pair of the true target and another candidate counts as much as the
discounted gain would change if the two changed places; trees are grown on these gradients with second-order gains. Validation
queries stop the growth where their Hit@10 (strict ties) no longer improves, and nothing else of them is used.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np


@dataclass(frozen=True)
class RankerConfig:
    rounds: int = 60
    rate: float = 0.1
    depth: int = 4
    least_rows: int = 20
    penalty: float = 1.0
    least_gain: float = 0.0
    bins: int = 64
    columns: float = 1.0
    rows: float = 1.0
    patience: int = 15
    seed: int = 7

    def __post_init__(self):
        if min(self.rounds, self.depth, self.least_rows, self.bins - 1, self.patience) < 1 or self.rate <= 0 or not (0 < self.columns <= 1 and 0 < self.rows <= 1):
            raise ValueError("counts and rate are positive, shares lie in (0, 1]")


def strict_hits(scores: np.ndarray, starts: np.ndarray, k: int = 10) -> float:
    """Share of queries whose true target has fewer than k candidates that score as much or more."""
    if len(starts) < 2:
        return 0.0
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ahead = np.bincount(owner, scores >= scores[starts[:-1]][owner], len(starts) - 1)  # counts the true target itself
    return float((ahead <= k).mean())


def gradients(scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each row's score."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    order = np.lexsort((-scores, owner))
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores)) - starts[owner[order]] + 1
    first = starts[:-1]
    rho = 1 / (1 + np.exp(np.clip(scores[first][owner] - scores, -50, 50)))
    swap = np.abs(1 / np.log2(1 + rank) - 1 / np.log2(1 + rank[first])[owner])
    pull, bend = rho * swap, rho * (1 - rho) * swap
    pull[first] = bend[first] = 0
    grad, hess = -pull, bend.copy()
    grad[first], hess[first] = np.bincount(owner, pull, n), np.bincount(owner, bend, n)
    return grad, np.maximum(hess, 1e-9)


@dataclass
class Ranker:
    """Trees as flat lists of (feature, cut, left child, value); scores are the sum of the leaves."""

    names: list[str]
    config: RankerConfig = field(default_factory=RankerConfig)
    trees: list[list[list[float]]] = field(default_factory=list)
    best: int = 0

    def fit(self, x: np.ndarray, starts: np.ndarray, val: tuple[np.ndarray, np.ndarray] | None = None) -> Ranker:
        c, r = self.config, np.random.default_rng(self.config.seed)
        if not np.isfinite(x).all():
            raise ValueError(f"{int((~np.isfinite(x)).sum())} feature values are undefined or infinite")
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, c.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(cut, x[:, j], side="left") for j, cut in enumerate(cuts)], 1) if x.shape[1] else np.zeros((len(x), 0), int)
        scores = np.zeros(len(x))
        held, top, since = np.zeros(len(val[0])) if val else None, -1.0, 0
        for _ in range(c.rounds):
            grad, hess = gradients(scores, starts)
            cols = np.sort(r.choice(x.shape[1], max(1, round(c.columns * x.shape[1])), replace=False))
            keep = np.flatnonzero(r.random(len(x)) < c.rows) if c.rows < 1 else np.arange(len(x))
            tree = self._grow(binned, cuts, grad, hess, cols, keep)
            self.trees.append(tree)
            scores += self._apply(tree, x)
            self.best = len(self.trees)
            if val is not None:
                held += self._apply(tree, val[0])
                hit = strict_hits(held, val[1])
                if hit > top + 1e-12:
                    top, since, kept = hit, 0, len(self.trees)
                else:
                    since += 1
                    if since >= c.patience:
                        break
        if val is not None and self.trees:
            self.best = kept
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, cols: np.ndarray, rows: np.ndarray) -> list[list[float]]:
        c = self.config
        tree: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            g, h = grad[own].sum(), hess[own].sum()
            tree[node][3] = float(c.rate * g / (h + c.penalty))
            if depth == c.depth or len(own) < 2 * c.least_rows:
                continue
            best = (c.least_gain + 1e-12, -1, 0)
            for j in cols:
                if not len(cuts[j]):
                    continue
                b = binned[own, j]
                gl, hl, nl = (np.bincount(b, w, len(cuts[j]) + 1).cumsum()[:-1] for w in (grad[own], hess[own], None))
                gain = gl**2 / (hl + c.penalty) + (g - gl) ** 2 / (h - hl + c.penalty) - g**2 / (h + c.penalty)
                gain[(nl < c.least_rows) | (len(own) - nl < c.least_rows)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(j), k)
            if best[1] < 0:
                continue
            _, j, k = best
            left = binned[own, j] <= k
            tree[node][:3] = [j, float(cuts[j][k]), len(tree)]
            todo += [(len(tree), own[left], depth + 1), (len(tree) + 1, own[~left], depth + 1)]
            tree += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        return tree

    @staticmethod
    def _apply(tree: list[list[float]], x: np.ndarray) -> np.ndarray:
        table = np.array(tree)
        feature, cut, left, value = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3]
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            j = np.maximum(feature[at], 0)
            at = np.where(inner, left[at] + (x[rows, j] > cut[at]), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees[: self.best]:
            out += self._apply(tree, x)
        return out

    def to_json(self) -> str:
        return json.dumps({"format": "quadrill_ranker_v1", "names": self.names, "config": asdict(self.config), "trees": self.trees, "best": self.best})

    @staticmethod
    def from_json(text: str) -> Ranker:
        d = json.loads(text)
        if d.get("format") != "quadrill_ranker_v1":
            raise ValueError(f"unknown format {d.get('format')!r}")
        return Ranker(d["names"], RankerConfig(**d["config"]), d["trees"], d["best"])
