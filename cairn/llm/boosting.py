"""Gradient-boosted trees for a binary target on small dense tables, in numpy, with a monotone calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits, complete trees of fixed depth.  Deterministic: no sampling."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = np.asarray(x, np.float64)
        edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees, score = [], np.full(len(y), self.base)
        nodes = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p) + 1e-6
            feature, cut = np.zeros(nodes, int), np.full(nodes, np.inf)
            at = np.zeros(len(y), int)
            for node in range(nodes):
                rows = at == node
                best = 1e-6
                if rows.sum() >= 8:
                    gr, hr = g[rows], h[rows]
                    whole = gr.sum() ** 2 / (hr.sum() + self.l2)
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, f], gr, len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], hr, len(e) + 1))[:-1]
                        gain = gl**2 / (hl + self.l2) + (gr.sum() - gl) ** 2 / (hr.sum() - hl + self.l2) - whole
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[node], cut[node] = gain[k], f, e[k]
                right = x[rows, feature[node]] > cut[node]
                at[rows] = 2 * node + 1 + right
            leaf = at - nodes
            value = -np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + self.l2) * self.rate
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


class Calibration:
    """Raw score to probability: pooled adjacent violators on held-back rows, shrunk by one row of each class."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Calibration:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum, count, last raw
        for s, t in zip(raw[order], y[order], strict=True):
            blocks.append([float(t), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], a[2]]
        self.upto = np.array([b[2] for b in blocks])
        self.share = np.array([(b[0] + 1) / (b[1] + 2) for b in blocks])
        self.share = np.maximum.accumulate(self.share)
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return self.share[np.minimum(np.searchsorted(self.upto, raw, side="left"), len(self.upto) - 1)]
