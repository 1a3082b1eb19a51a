"""Gradient-boosted trees with logistic loss on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of fixed depth; every split and leaf lives in flat arrays, so scoring is vectorised."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.base, self.features, self.cuts, self.leaves = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """``x``: rows by features; ``y``: 0 or 1. With one class or no rows the margin is constant."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                g_all = np.bincount(at - first, grad, width)
                h_all = np.bincount(at - first, hess, width)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    key = (at - first) * k + binned[:, j]
                    g = np.cumsum(np.bincount(key, grad, width * k).reshape(width, k), axis=1)[:, :-1]
                    h = np.cumsum(np.bincount(key, hess, width * k).reshape(width, k), axis=1)[:, :-1]
                    gain = g**2 / (h + self.l2) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + self.l2)
                    gain -= (g_all**2 / (h_all + self.l2))[:, None]
                    top = gain.argmax(axis=1)
                    won = gain[np.arange(width), top]
                    for node in np.flatnonzero(won > best):
                        best[node], feature[first + node], cut[first + node] = won[node], j, e[top[node]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            g, h = np.bincount(at - inner, grad, inner + 1), np.bincount(at - inner, hess, inner + 1)
            leaf = self.rate * g / (h + self.l2)
            margin += leaf[at - inner]
            self.features.append(feature), self.cuts.append(cut), self.leaves.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = np.asarray(x, float)
        margin, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            margin += leaf[at - inner]
        return 1 / (1 + np.exp(-margin))


def calibrate_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold whose share of true rows at or above it is at least ``precision`` (else 1)."""
    order = np.argsort(-np.asarray(score, float), kind="stable")
    s, hit = np.asarray(score, float)[order], np.cumsum(np.asarray(y, float)[order])
    good = np.flatnonzero((hit / np.arange(1, len(s) + 1) >= precision) & np.append(s[:-1] != s[1:], True)) if len(s) else []
    return float(s[good[-1]]) if len(good) else 1.0
