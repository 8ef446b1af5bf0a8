"""Gradient-boosted trees for binary labels, in numpy, over quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
TREES = 90
DEPTH = 4
SHRINK = 0.2
RIDGE = 1.0


@dataclass
class Boosted:
    """Trees in arrays: by tree and heap position a feature, a threshold and a leaf value."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for each row."""
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = (1 << DEPTH) - 1
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.limit[t, at])
            z += self.leaf[t, at - inner]
        return z


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Fits trees of fixed depth to the logistic loss by Newton steps on binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    inner = (1 << DEPTH) - 1
    feature = np.zeros((TREES, inner), np.int64)
    limit = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, 1 << DEPTH))
    z = np.full(n, start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cell = (at - first) * (BINS + 1) + binned[:, f]
                hg = np.bincount(cell, g, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                hh = np.bincount(cell, h, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                all_g, all_h = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + RIDGE) + (all_g - hg) ** 2 / (all_h - hh + RIDGE) - all_g**2 / (all_h + RIDGE)
                gain = gain[:, : len(cuts[f])]
                k = gain.argmax(1)
                better = gain[np.arange(count), k] > best + 1e-9
                best = np.where(better, gain[np.arange(count), k], best)
                feature[t, first : first + count][better] = f
                limit[t, first : first + count][better] = cuts[f][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > limit[t, at])
        spot = at - inner
        total_g, total_h = np.bincount(spot, g, 1 << DEPTH), np.bincount(spot, h, 1 << DEPTH)
        leaf[t] = SHRINK * total_g / (total_h + RIDGE)
        z += leaf[t, spot]
    return Boosted(start, feature, limit, leaf)
