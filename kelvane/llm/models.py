"""Small models that the driver fits on a bounded sample and executors apply: boosted trees, isotonic and logistic regression."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p: np.ndarray, eps: float = 1e-3) -> np.ndarray:
    p = np.clip(p, eps, 1 - eps)
    return np.log(p / (1 - p))


class BoostedTrees:
    """Gradient-boosted trees with logistic loss over quantile bins; full binary trees of a fixed depth."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base, self.nodes, self.leaves = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        low = x.min(axis=0) if n else np.zeros(m)
        # A mostly constant feature has that constant as every quantile; a cut above it still tells the rest apart.
        cuts = [np.unique(np.append(c, low[j])) for j, c in enumerate(cuts)]
        coded = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        width = max(len(c) for c in cuts) + 1
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(n, self.base)
        cell = coded + width * np.arange(m)
        for _ in range(self.trees):
            q = sigmoid(raw)
            g, h = q - y, q * (1 - q)
            at = np.zeros(n, np.int64)  # node within the level
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for d in range(self.depth):
                k = 2**d
                flat = (at[:, None] * (m * width) + cell).ravel()
                sums = [np.bincount(flat, np.repeat(v, m), k * m * width).reshape(k, m, width) for v in (g, h)]
                left = [s.cumsum(axis=2) for s in sums]
                total = [s[:, :, -1:] for s in left]
                gain = sum(a**2 / (b + self.l2) for a, b in ((left[0], left[1]), (total[0] - left[0], total[1] - left[1]))) - total[0] ** 2 / (total[1] + self.l2)
                gain[(left[1] < self.least) | (total[1] - left[1] < self.least)] = -1
                for j, c in enumerate(cuts):
                    gain[:, j, len(c) :] = -1
                best = gain.reshape(k, -1).argmax(axis=1)
                for node in range(k):
                    j, b = divmod(int(best[node]), width)
                    if gain[node, j, b] > 1e-9:
                        feature[k - 1 + node], cut[k - 1 + node] = j, cuts[j][b]
                at = 2 * at + (x[np.arange(n), feature[k - 1 + at]] > cut[k - 1 + at])
            k = 2**self.depth
            leaf = -np.bincount(at, g, k) / (np.bincount(at, h, k) + self.l2) * self.rate
            raw += leaf[at]
            self.nodes.append((feature, cut))
            self.leaves.append(leaf)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for (feature, cut), leaf in zip(self.nodes, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                node = 2**d - 1 + at
                at = 2 * at + (x[rows, feature[node]] > cut[node])
            out += leaf[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


class Isotonic:
    """The non-decreasing step function nearest to (score, label) pairs, by pooling adjacent violators; linear between blocks."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum, weight, lowest and highest score
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            if blocks and blocks[-1][3] == s:
                blocks[-1][0] += v
                blocks[-1][1] += 1
            else:
                blocks.append([v, 1, s, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a, w, _, top = blocks.pop()
                blocks[-1][0] += a
                blocks[-1][1] += w
                blocks[-1][3] = top
        self.x = np.array([x for b in blocks for x in (b[2], b[3])])
        self.y = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0, 1)


class Constant:
    """For samples without both classes."""

    def __init__(self, p: float):
        self.p = p

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale == 0] = 1
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        self.w = np.zeros(z.shape[1])
        ridge = l2 * np.eye(z.shape[1])
        ridge[0, 0] = 1e-6
        for _ in range(steps):
            p = sigmoid(z @ self.w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.w)
