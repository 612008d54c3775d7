"""Histogram gradient-boosted trees for two classes, as flat arrays that numpy walks for many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of equal depth: node i of a tree has children 2i + 1 and 2i + 2.

    ``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees, leaves); a row goes right where its value
    exceeds the threshold. An unsplit node has an infinite threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        at = np.arange(len(rows))
        out = np.full(len(rows), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


def train(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    penalty: float = 1.0,
    min_weight: float = 1.0,
) -> Forest:
    """Fit log loss by boosting; splits are sought over histograms of at most ``bins`` quantile bins per feature.

    Without rows every score is a half; with one class alone the trees add nothing to its rate.
    """
    n, width = rows.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    rate_of_ones = (labels.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if n == 0 or labels.min() == labels.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base if n else 0.0)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1)
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, weight = p - labels, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            totals = [np.bincount(local, x, count) for x in (slope, weight)]
            before = totals[0] ** 2 / (totals[1] + penalty)
            best = np.full(count, 1e-6)
            for f in range(width):
                place = local * bins + binned[:, f]
                g = np.bincount(place, slope, count * bins).reshape(count, bins).cumsum(axis=1)[:, :-1]
                h = np.bincount(place, weight, count * bins).reshape(count, bins).cumsum(axis=1)[:, :-1]
                g2, h2 = totals[0][:, None] - g, totals[1][:, None] - h
                gain = g**2 / (h + penalty) + g2**2 / (h2 + penalty) - before[:, None]
                gain[(h < min_weight) | (h2 < min_weight)] = -np.inf
                gain[:, len(cuts[f]) :] = -np.inf
                at = gain.argmax(axis=1)
                found = gain[np.arange(count), at]
                better = found > best
                best[better] = found[better]
                where = first + np.flatnonzero(better)
                feature[where], cut[where] = f, at[better]
                threshold[where] = cuts[f][at[better]] if better.any() else np.inf
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        g, h = (np.bincount(leaf_of, x, leaves) for x in (slope, weight))
        leaf = -rate * g / (h + penalty)
        margin += leaf[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)
