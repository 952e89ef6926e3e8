"""Gradient boosted trees for two classes: logistic loss, small trees over binned features, in NumPy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Depth-limited trees as arrays: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.3, least: float = 2.0) -> None:
        self.depth, self.rounds, self.rate, self.least = depth, rounds, rate, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="nearest")) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # bin > b means value > cuts[b]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            n = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(n, -1), np.zeros(n), np.zeros(n)
            node = np.zeros(len(y), np.int64)
            for k in range(n):
                here = np.flatnonzero(node == k)
                if not len(here):
                    continue
                gs, hs = g[here].sum(), h[here].sum()
                value[k] = self.rate * gs / (hs + 1)
                if 2 * k + 2 >= n or hs < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for j, c in enumerate(cuts):
                    m = len(c) + 1
                    gl = np.cumsum(np.bincount(bins[here, j], g[here], m))[:-1]
                    hl = np.cumsum(np.bincount(bins[here, j], h[here], m))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < self.least) | (hs - hl < self.least)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                    node[here] = 2 * k + 1 + (x[here, best[1]] > cut[k])
            self.trees.append((feature, cut, value))
            f += self._one(x, *self.trees[-1])
        return self

    def _one(self, x: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        k = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            j = feature[k]
            k = np.where(j >= 0, 2 * k + 1 + (x[np.arange(len(x)), np.maximum(j, 0)] > cut[k]), k)
        return value[k]

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for t in self.trees:
            f += self._one(x, *t)
        return 1 / (1 + np.exp(-f))
