"""Histogram gradient-boosted trees for a binary target, in numpy; trees are flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``trees`` complete binary trees of one depth: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, nodes) int
    threshold: np.ndarray  # (trees, nodes): go right if x > threshold
    value: np.ndarray  # (trees, leaves)
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        nodes = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while nodes and at[0:1].size and at[0] < nodes:  # all rows are on one level
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - nodes]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1e-3) -> Forest:
    """Newton boosting of the logistic loss. No rows: a prior of 1/2; one class: nearly that class everywhere."""
    nodes, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), prior)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), prior)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(leaves)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, least)
            cut = np.full(width, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                key = (at - first) * size + binned[:, f]
                gs = np.bincount(key, g, width * size).reshape(width, size).cumsum(axis=1)
                hs = np.bincount(key, h, width * size).reshape(width, size).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain = gain[:, :-1]
                j = gain.argmax(axis=1)
                top = gain[np.arange(width), j]
                better = top > best
                best[better] = top[better]
                cut[better] = j[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = e[j[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - nodes
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        raw += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Forest(np.array(out_f), np.array(out_t), np.array(out_v), prior)
