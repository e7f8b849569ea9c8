"""Gradient-boosted trees on binned features, for the small models trained here."""

from __future__ import annotations

import numpy as np


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


class Trees:
    """Trees of one depth: node i has children 2i+1 and 2i+2; feature value <= cut goes left."""

    def __init__(self, depth: int, rate: float):
        self.depth, self.rate, self.bias = depth, rate, 0.0
        self.features: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def leaf(self, x: np.ndarray, t: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.features[t][node]] > self.cuts[t][node])
        return node - (2**self.depth - 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for t in range(len(self.leaves)):
            out += self.rate * self.leaves[t][self.leaf(x, t)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, bins: int = 24, ridge: float = 1.0) -> Trees:
        w = np.ones(len(y)) if weight is None else weight
        edges = quantile_edges(x, bins)
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        width = max(len(e) for e in edges) + 1
        flat = (codes + np.arange(len(edges)) * width).astype(np.int64)
        # A feature has no cut behind its last edge.
        barred = np.arange(width)[None, :] >= np.array([len(e) for e in edges])[:, None]
        share = min(max(float(np.average(y, weights=w)), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            self.grow(codes, flat, barred, edges, w * (y - p), w * p * (1 - p), ridge)
            score += self.rate * self.leaves[-1][self.leaf(x, len(self.leaves) - 1)]
        return self

    def grow(self, codes, flat, barred, edges, g, h, ridge) -> None:
        """One tree, level by level: sums of all nodes and features come from one histogram each."""
        size, inner = 2**self.depth, 2**self.depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(g), np.int64)
        n_features, width = barred.shape
        for level in range(self.depth):
            first, nodes = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (n_features * width) + flat).ravel()
            sums = [np.bincount(place, np.repeat(v, n_features), nodes * n_features * width).reshape(nodes, n_features, width).cumsum(2) for v in (g, h)]
            (gl, hl), (gs, hs) = sums, (s[:, :1, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain = np.where(barred[None], -np.inf, gain).reshape(nodes, -1)
            best = np.argmax(gain, 1)
            for i in range(nodes):
                if gain[i, best[i]] > 1e-9:
                    j, k = divmod(int(best[i]), width)
                    feature[first + i], cut[first + i] = j, edges[j][k]
            limit = np.array([np.searchsorted(edges[f], c) if np.isfinite(c) else width for f, c in zip(feature[first : first + nodes], cut[first : first + nodes], strict=True)])
            right = codes[np.arange(len(g)), feature[node]] > limit[node - first]
            node = 2 * node + 1 + right
        leaf = node - inner
        self.features.append(feature)
        self.cuts.append(cut)
        self.leaves.append(np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + ridge))
