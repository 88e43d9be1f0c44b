"""Gradient-boosted trees with logistic loss over binned features."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 48


class Boosted(NamedTuple):
    """Complete binary trees: at inner place i, feature and threshold; values at the leaves."""

    base: float
    feature: np.ndarray  # trees x inner places
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, decay: float = 1.0, least: float = 3.0) -> Boosted:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        bins = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
        base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, base)
        inner, leaves = 2**depth - 1, 2**depth
        feature, threshold, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, int)
            for level in range(depth):
                width, start = 2**level, 2**level - 1
                best = np.zeros(width)
                place = at - start
                gain_of = lambda a, b: a * a / (b + decay)
                all_g, all_h = np.bincount(place, g, width), np.bincount(place, h, width)
                split = np.full((width, 2), -1)
                for j in range(m):
                    key = place * BINS + bins[:, j]
                    gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                    gain = gain_of(gs, hs) + gain_of(all_g[:, None] - gs, all_h[:, None] - hs) - gain_of(all_g, all_h)[:, None]
                    gain[(hs < least * 0.1) | (all_h[:, None] - hs < least * 0.1)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = (top > best + 1e-9) & (k < len(edges[j]))
                    best[better] = top[better]
                    split[better] = np.stack([np.full(width, j), k], 1)[better]
                for w in range(width):
                    if split[w, 0] >= 0:
                        feature[t, start + w], threshold[t, start + w] = split[w, 0], edges[split[w, 0]][split[w, 1]]
                at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
            leaf = at - inner
            value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + decay)
            f += value[t][leaf]
        return cls(base, feature, threshold, value)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            at = np.zeros(len(x), int)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            out += self.value[t][at - inner]
        return out
