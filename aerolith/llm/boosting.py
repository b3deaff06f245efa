"""Gradient-boosted trees for binary labels on a bounded sample, in numpy, with Platt calibration."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Depth-limited regression trees on binned features, fitted to the logistic loss by Newton steps."""

    def __init__(self, trees: int = 30, depth: int = 4, rate: float = 0.25, least: int = 10, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.scale = (1.0, 0.0)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        codes = self._codes(x)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        n, k = 2 ** (self.depth + 1) - 1, x.shape[1]
        wide = codes + np.arange(k) * (BINS + 1)
        self.forest = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(n, -1), np.zeros(n, np.int16), np.zeros(n)
            node = np.zeros(len(y), int)
            for level in range(self.depth + 1):
                for i in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == i)
                    if not len(at):
                        continue
                    gs, hs = g[at].sum(), h[at].sum()
                    value[i] = gs / (hs + self.ridge)
                    if level == self.depth or len(at) < 2 * self.least:
                        continue
                    flat = wide[at].ravel()
                    gl, hl, nl = (np.bincount(flat, w, k * (BINS + 1)).reshape(k, -1).cumsum(axis=1)[:, :-1] for w in (np.repeat(g[at], k), np.repeat(h[at], k), None))
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(nl < self.least) | (len(at) - nl < self.least)] = -1
                    j, t = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    best = (gain[j, t], int(j), int(t)) if gain[j, t] > 1e-6 else (0, -1, 0)
                    if best[1] >= 0:
                        feature[i], cut[i] = best[1], best[2]
                        node[at] = np.where(codes[at, best[1]] <= best[2], 2 * i + 1, 2 * i + 2)
            self.forest.append((feature, cut, value))
            score += self.rate * value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.forest:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, np.where(codes[rows, f] <= cut[node], 2 * node + 1, 2 * node + 2))
            out += self.rate * value[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Fits probability = logistic(a * score + b) on a holdout, by damped Newton steps."""
        s = self.score(x)
        a, b = 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - t) * s).sum() + 0.1 * (a - 1), (p - t).sum()])
            hess = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum()]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale = (max(float(a), 0.05), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.score(x) + b, -60, 60)))
