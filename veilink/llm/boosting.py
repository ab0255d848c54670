"""Gradient-boosted regression trees for the logistic loss, in numpy, over features binned by quantiles."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``fit`` once, then ``probability``. Depth-limited trees with second-order leaf values."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.size, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        if not len(y):
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += self._walk(tree, x)
        return self

    def _grow(self, binned, cuts, g, h):
        """A complete tree in heap order: feature (-1 for none) and cut of each inner node, values of the leaves."""
        inner = 2**self.depth - 1
        feature, cut, value = np.full(inner, -1), np.zeros(inner), np.zeros(2**self.depth)
        rows = {0: np.arange(len(g))}
        for node in range(inner):
            own = rows.pop(node, np.zeros(0, int))
            best, left = 1e-6, None
            if len(own) >= 8:
                whole = g[own].sum() ** 2 / (h[own].sum() + self.l2)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs, hs = (np.bincount(binned[own, f], weights=v[own], minlength=len(c) + 1).cumsum() for v in (g, h))
                    gain = gs[:-1] ** 2 / (hs[:-1] + self.l2) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + self.l2) - whole
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node], left = gain[k], f, c[k], binned[own, f] <= k
            sides = (own[left], own[~left]) if left is not None else (own, own[:0])
            rows[2 * node + 1], rows[2 * node + 2] = sides
        for leaf in range(2**self.depth):
            own = rows.get(inner + leaf, np.zeros(0, int))
            if len(own):
                value[leaf] = -self.rate * g[own].sum() / (h[own].sum() + self.l2)
        return feature, cut, value

    def _walk(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[at]
            at = 2 * at + 1 + ((f >= 0) & (x[np.arange(len(x)), f] > cut[at]))
        return value[at - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))
