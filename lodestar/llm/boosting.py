"""Gradient-boosted trees over dense features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32
DEPTH = 3
ROUNDS = 80
RATE = 0.15
#: Ridge of a leaf's value, and least hessian of a leaf.
RIDGE = 1.0
LEAST = 2.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Boosted:
    """Trees of one depth, as arrays: a node's feature and bar, a leaf's value. Values up to the bar go left."""

    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    bars: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Log-loss boosting with histograms: at each level of a tree, every node takes the split of most gain."""
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        model, n_nodes = cls(float(np.log(share / (1 - share)))), 2**DEPTH - 1
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), model.base)
        for _ in range(ROUNDS):
            p = sigmoid(margin)
            g, h = p - y, p * (1 - p)
            feature, bar, node = np.zeros(n_nodes, int), np.full(n_nodes, np.inf), np.zeros(len(y), int)
            for depth in range(DEPTH):
                first, width = 2**depth - 1, 2**depth
                best = np.zeros(width)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    slot = (node - first) * BINS + binned[:, f]
                    gs, hs = (np.bincount(slot, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gl, hl = gs[:, : len(e)], hs[:, : len(e)]
                    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                    gain[(hl < LEAST) | (ht - hl < LEAST)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    for j in np.flatnonzero(top > best + 1e-9):
                        best[j], feature[first + j], bar[first + j] = top[j], f, e[k[j]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > bar[node])
            leaf = node - n_nodes
            gs, hs = (np.bincount(leaf, weights=w, minlength=n_nodes + 1) for w in (g, h))
            value = -RATE * gs / (hs + RIDGE)
            margin += value[leaf]
            model.features.append(feature)
            model.bars.append(bar)
            model.values.append(value)
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, bar, value in zip(self.features, self.bars, self.values, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > bar[node])
            out += value[node - len(feature)]
        return out


@dataclass
class Isotonic:
    """A rising function through pooled points, straight between them and flat beyond."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        """Pool adjacent violators; each pool has one label of either kind more, so none is quite 0 or 1."""
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # sum of labels, rows, first and last margin
        for m, label in zip(margin[order], y[order], strict=True):
            pools.append([label, 1.0, m, m])
            while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
                s, n, _, last = pools.pop()
                pools[-1][0] += s
                pools[-1][1] += n
                pools[-1][3] = last
        at = [v for p in pools for v in (p[2], p[3])]
        value = [v for p in pools for v in ((p[0] + 1e-3) / (p[1] + 2e-3),) * 2]
        return cls(np.array(at), np.maximum.accumulate(np.array(value)))

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)
