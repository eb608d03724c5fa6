"""Histogram gradient-boosted trees for a binary label, in numpy, and their vectorised traversal.

Trees are complete binary trees of one depth, flattened: node i of a tree has the children 2i+1 and 2i+2, so a batch of
rows goes down all trees at once with one gather for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature and threshold by (tree, inner node), value by (tree, leaf), and the log-odds all trees start from."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        tree = np.arange(len(self.value))[None, :]
        for at in range(0, len(rows) if len(self.value) else 0, 4096):
            part = rows[at : at + 4096]
            node = np.zeros((len(part), len(self.value)), np.int64)
            line = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[line, self.feature[tree, node]] > self.threshold[tree, node])
            out[at : at + 4096] += self.value[tree, node - (self.value.shape[1] - 1)].sum(axis=1)
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(rows)))


def fit(
    rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
    smoothing: float = 1.0, least_gain: float = 1e-3,
) -> Trees:
    """Logistic loss, second-order gains. Without rows or with one class the result is a smoothed constant."""
    rows, labels = np.asarray(rows, np.float64), np.asarray(labels, np.float64)
    inner, leaves = 2**depth - 1, 2**depth
    start = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    if not len(labels) or labels.min() == labels.max():
        none = np.zeros((0, inner))
        return Trees(none.astype(np.int64), none, np.zeros((0, leaves)), start)
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    edges = np.full((width, bins), np.inf)
    coded = np.empty((n, width), np.int64)
    for f, cut in enumerate(cuts):
        edges[f, : len(cut)] = cut
        coded[:, f] = np.searchsorted(cut, rows[:, f], side="left")  # code <= c as long as the value <= cut[c]
    cells = coded + np.arange(width)[None, :] * bins
    size = width * bins
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    odds = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = labels - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = ((node - first)[:, None] * size + cells).ravel()
            g = np.bincount(at, np.repeat(gradient, width), wide * size).reshape(wide, width, bins)
            h = np.bincount(at, np.repeat(weight, width), wide * size).reshape(wide, width, bins)
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + smoothing) + (all_g - left_g) ** 2 / (all_h - left_h + smoothing)
            gain -= all_g**2 / (all_h + smoothing)
            gain[:, ~np.isfinite(edges)] = -1  # nothing to the right of the last cut
            best = gain.reshape(wide, -1).argmax(axis=1)
            f, c = best // bins, best % bins
            splits = gain.reshape(wide, -1)[np.arange(wide), best] > least_gain
            feature[t, first : first + wide] = f
            threshold[t, first : first + wide] = np.where(splits, edges[f, c], np.inf)
            mine = node - first
            right = splits[mine] & (coded[np.arange(n), f[mine]] > c[mine])
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        value[t] = rate * g / (h + smoothing)
        odds += value[t][leaf]
    return Trees(feature, threshold, value, start)
