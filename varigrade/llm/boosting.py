"""Gradient-boosted trees for yes/no labels, on binned features in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of fixed depth: at each level every node splits on its best (feature, bin) pair."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 1.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> Boosted:
        marks = np.linspace(0, 100, BINS + 1)[1:-1]
        self.edges = [np.unique(np.percentile(rows[:, k], marks)) for k in range(rows.shape[1])]
        bins, width = self.binned(rows), rows.shape[1]
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(rows), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            slope, bend = labels - p, p * (1 - p)
            features = np.zeros(2 ** self.depth - 1, np.int64)
            cuts = np.full(2 ** self.depth - 1, BINS, np.int64)
            place = np.zeros(len(rows), np.int64)
            for level in range(self.depth):
                first, count = 2 ** level - 1, 2 ** level
                inner = place - first
                best = np.full(count, 1e-6)
                for k in range(width):
                    cell = inner * BINS + bins[:, k]
                    g = np.bincount(cell, slope, count * BINS).reshape(count, BINS)
                    h = np.bincount(cell, bend, count * BINS).reshape(count, BINS)
                    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = (left_g ** 2 / (left_h + 1) + right_g ** 2 / (right_h + 1) - all_g ** 2 / (all_h + 1))
                    gain[(left_h < self.least) | (right_h < self.least)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = top > best
                    best[better] = top[better]
                    features[first: first + count][better] = k
                    cuts[first: first + count][better] = at[better]
                place = 2 * place + 1 + (bins[np.arange(len(rows)), features[place]] > cuts[place])
            leaf = place - (2 ** self.depth - 1)
            g = np.bincount(leaf, slope, 2 ** self.depth)
            h = np.bincount(leaf, bend, 2 ** self.depth)
            values = self.rate * g / (h + 1)
            z += values[leaf]
            self.forest.append((features, cuts, values))
        return self

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of yes."""
        z = np.full(len(rows), self.base)
        if not len(rows):
            return z
        bins, here = self.binned(rows), np.arange(len(rows))
        for features, cuts, values in self.forest:
            place = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (bins[here, features[place]] > cuts[place])
            z += values[place - (2 ** self.depth - 1)]
        return z
