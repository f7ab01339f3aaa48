"""Gradient-boosted trees for a bounded sample, turned into SQL expressions for scoring."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting with trees of two levels; scores are log odds."""

    def __init__(self, trees: int = 40, rate: float = 0.3, leaf: int = 10):
        self.trees, self.rate, self.leaf, self.fitted, self.start = trees, rate, leaf, [], 0.0

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-6, None
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j in range(x.shape[1]):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            a, gs, hs = v[order], np.cumsum(g[rows][order]), np.cumsum(h[rows][order])
            cuts = np.flatnonzero(a[1:] > a[:-1])
            cuts = cuts[(cuts + 1 >= self.leaf) & (len(a) - cuts - 1 >= self.leaf)]
            if len(cuts):
                gain = gs[cuts] ** 2 / (hs[cuts] + 1) + (gs[-1] - gs[cuts]) ** 2 / (hs[-1] - hs[cuts] + 1) - whole
                k = int(gain.argmax())
                if gain[k] > best:
                    best, found = gain[k], (j, float((a[cuts[k]] + a[cuts[k] + 1]) / 2))
        return found

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)

            def grow(rows, depth, g=g, h=h):
                cut = self._split(x, g, h, rows) if depth else None
                if cut is None:
                    value = float(self.rate * g[rows].sum() / (h[rows].sum() + 1))
                    f[rows] += value
                    return value
                left = x[rows, cut[0]] <= cut[1]
                return (*cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1))

            self.fitted.append(grow(np.arange(len(y)), 2))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        def values(node) -> np.ndarray:
            if not isinstance(node, tuple):
                return np.full(len(x), node)
            return np.where(x[:, node[0]] <= node[1], values(node[2]), values(node[3]))

        return self.start + sum(map(values, self.fitted), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        def text(node) -> str:
            if not isinstance(node, tuple):
                return f"{node!r}D"
            return f"IF({names[node[0]]} <= {node[1]!r}D, {text(node[2])}, {text(node[3])})"

        return " + ".join([f"{self.start!r}D", *map(text, self.fitted)])


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * score + b))), by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        w = p * (1 - p)
        grad = np.array([((y - p) * scores).sum() - 0.01 * (a - 1), (y - p).sum() - 0.01 * b])
        hess = np.array([[(w * scores**2).sum() + 0.01, (w * scores).sum()], [(w * scores).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)
