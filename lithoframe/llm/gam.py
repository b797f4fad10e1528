"""A generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

Features are cut into quantile bins; each round fits, feature after feature, a tree of two levels to the
gradient of the log loss and adds it to the feature's lookup table. Then the pairs whose grid explains
most of what is left get tables of their own in the same way. Scoring is one lookup and addition a table.
"""

from __future__ import annotations

import numpy as np


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Best gain and the first bin of the right side, for sums by bin."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    tg, th = g.sum(), h.sum()
    gain = cg**2 / (ch + l2) + (tg - cg) ** 2 / (th - ch + l2) - tg**2 / (th + l2)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, l2: float, depth: int) -> np.ndarray:
    """Values by bin of a tree over ordered bins."""
    gain, at = _split(g, h, l2)
    if depth and gain > 1e-9:
        return np.concatenate([_tree(g[:at], h[:at], l2, depth - 1), _tree(g[at:], h[at:], l2, depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + l2))


def _tree2(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Values of a grid: a split of one axis, then each side along the other."""
    best = None
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        _, at = _split(a.sum(1), b.sum(1), l2)
        parts = [np.tile(_tree(a[s].sum(0), b[s].sum(0), l2, 1), (len(a[s]), 1)) for s in (slice(0, at), slice(at, None)) if len(a[s])]
        v = np.concatenate(parts)
        score = float((v * a - 0.5 * v * v * b).sum())
        if best is None or score > best[0]:
            best = (score, v if axis == 0 else v.T)
    return best[1]


class AdditiveModel:
    def __init__(self, bins: int = 48, coarse: int = 12, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, l2: float = 3.0):
        self.bins, self.coarse, self.rounds, self.pairs, self.pair_rounds, self.rate, self.l2 = bins, coarse, rounds, pairs, pair_rounds, rate, l2

    def _cut(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, m = x.shape
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.edges = [self._cut(x[:, f], self.bins) for f in range(m)]
        self.wide = [self._cut(x[:, f], self.coarse) for f in range(m)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.grids: list[tuple[int, int, np.ndarray]] = []
        if n == 0 or y.min() == y.max():
            return self
        at = [np.searchsorted(self.edges[f], x[:, f], "right") for f in range(m)]
        margin = np.full(n, self.base)

        def slopes():
            p = 1 / (1 + np.exp(-margin))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f in range(m):
                g, h = slopes()
                k = len(self.tables[f])
                v = self.rate * _tree(np.bincount(at[f], g, k), np.bincount(at[f], h, k), self.l2, 2)
                self.tables[f] += v
                margin += v[at[f]]
        wide = [np.searchsorted(self.wide[f], x[:, f], "right") for f in range(m)]
        g, h = slopes()
        scored = []
        for a in range(m):
            for b in range(a):
                shape = (len(self.wide[a]) + 1, len(self.wide[b]) + 1)
                cell = wide[a] * shape[1] + wide[b]
                gs, hs = np.bincount(cell, g, shape[0] * shape[1]), np.bincount(cell, h, shape[0] * shape[1])
                scored.append((float((gs**2 / (hs + self.l2)).sum()), a, b, shape, cell))
        chosen = sorted(scored, key=lambda s: (-s[0], s[1], s[2]))[: self.pairs]
        grids = [np.zeros(s[3]) for s in chosen]
        for _ in range(self.pair_rounds):
            for (_, _, _, shape, cell), grid in zip(chosen, grids, strict=True):
                g, h = slopes()
                v = self.rate * _tree2(np.bincount(cell, g, grid.size).reshape(shape), np.bincount(cell, h, grid.size).reshape(shape), self.l2)
                grid += v
                margin += v.ravel()[cell]
        self.grids = [(s[1], s[2], grid) for s, grid in zip(chosen, grids, strict=True)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            margin += t[np.searchsorted(self.edges[f], x[:, f], "right")]
        for a, b, grid in self.grids:
            margin += grid[np.searchsorted(self.wide[a], x[:, a], "right"), np.searchsorted(self.wide[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-margin))
