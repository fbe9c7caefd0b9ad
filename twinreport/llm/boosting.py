"""Gradient-boosted trees for logistic loss over binned features, and the calibration of their scores; plain numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees on quantile bins. Fitting is deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._tree(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._values(tree, binned)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.base + sum(self._values(t, binned) for t in self.trees)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut, value = np.zeros(inner, int), np.full(inner, self.bins), np.zeros(2**self.depth)
        node = np.zeros(len(g), int)
        for level in range(self.depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == k
                if not own.any():
                    continue
                best = 1e-6
                gs, hs = g[own].sum(), h[own].sum()
                for j in range(binned.shape[1]):
                    b = binned[own, j]
                    gl = np.cumsum(np.bincount(b, g[own], self.bins))[:-1]
                    hl = np.cumsum(np.bincount(b, h[own], self.bins))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    if gain.max() > best:
                        best, feature[k], cut[k] = gain.max(), j, int(gain.argmax())
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        value = self.rate * np.bincount(leaf, g, len(value)) / (np.bincount(leaf, h, len(value)) + self.ridge)
        return feature, cut, value

    def _values(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), int)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a * raw + b))) is calibrated: Newton's steps on the logistic loss, halved until it falls."""
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    loss = lambda t: np.logaddexp(0, np.where(y > 0.5, -1, 1) * (x @ t)).sum() + 5e-4 * t @ t
    t = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * t)
        while np.abs(step).max() > 1e-9 and loss(t - step) > loss(t):
            step = step / 2
        t = t - step
    return float(t[0]), float(t[1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold, at least one half, at which the held-out spans reach the precision."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return max(0.5, float(p[order][good[-1]])) if len(good) else 1.0
