"""Gradient-boosted regression trees for a yes-or-no label: small, exact at prediction, fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth; node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes): a row goes right if its value is larger
    value: np.ndarray  # (trees, leaves)
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        total = np.full(len(rows), self.start)
        index = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(rows), dtype=np.int64)
            while inner and len(at) and at[0] < inner:
                at = 2 * at + 1 + (rows[index, feature[at]] > threshold[at])
            total += value[at - inner]
        return total


def fit(
    rows: np.ndarray, labels: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.2, ridge: float = 2.0, share: float = 0.3, seed: int = 11
) -> Trees:
    """Newton boosting of the logistic loss: splits at quantiles of the features, each tree on a share of the rows."""
    n, width = rows.shape
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = labels.mean()
    start = float(np.log(mean / (1 - mean)))
    score = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    cut_count = np.array([len(c) for c in cuts])
    usable = np.arange(BINS)[None, :] < cut_count[:, None]
    columns = np.arange(width) * BINS
    for tree in range(trees):
        chosen = rng.random(n) < share
        own = binned[chosen] + columns
        chance = 1 / (1 + np.exp(-score[chosen]))
        slope, curve = labels[chosen] - chance, chance * (1 - chance)
        node = np.zeros(len(own), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cells = ((node - first)[:, None] * (width * BINS) + own).ravel()
            shape = (count, width, BINS)
            g = np.bincount(cells, np.repeat(slope, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(cells, np.repeat(curve, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain = np.where(usable, gain, 0).reshape(count, -1)
            at = gain.argmax(axis=1)
            for i in np.nonzero(gain[np.arange(count), at] > 1e-9)[0]:
                f, b = divmod(int(at[i]), BINS)
                features[tree, first + i], thresholds[tree, first + i] = f, cuts[f][b]
            node = 2 * node + 1 + (rows[chosen, features[tree, node]] > thresholds[tree, node])
        leaf = node - inner
        values[tree] = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + ridge)
        at_all = np.zeros(n, dtype=np.int64)
        for _ in range(depth):
            at_all = 2 * at_all + 1 + (rows[np.arange(n), features[tree, at_all]] > thresholds[tree, at_all])
        score += values[tree][at_all - inner]
    return Trees(features, thresholds, values, start)
