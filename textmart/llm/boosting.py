"""Gradient-boosted trees on a few dense features, and isotonic calibration; small matrices, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: nodes in heap order, `feature` -1 where a node is not split."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > limit[node])
                node = 2 * node + 1 + right
            total += leaf[node - (2 ** self.depth - 1)]
        return total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15,
        bins: int = 48, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    trees = Trees(float(np.log(share / (1 - share))), depth)
    z = np.full(len(y), trees.base)
    inner = 2 ** depth - 1
    for _ in range(rounds):
        p = _sigmoid(z)
        gradient, hessian = weight * (y - p), weight * p * (1 - p)
        feature, limit = np.full(inner, -1), np.zeros(inner)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                if not len(here) or not len(c):
                    continue
                g = np.bincount(binned[here, j], gradient[here], len(c) + 1).cumsum()
                h = np.bincount(binned[here, j], hessian[here], len(c) + 1).cumsum()
                gain = (g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
                        - g[-1] ** 2 / (h[-1] + ridge))
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            right = np.zeros(len(here), np.int64)
            if best[1] >= 0:
                feature[node], limit[node] = best[1], cuts[best[1]][best[2]]
                right = (binned[here, best[1]] > best[2]).astype(np.int64)
            at[here] = 2 * node + 1 + right
        leaf_of = at - inner
        g, h = (np.bincount(leaf_of, v, inner + 1) for v in (gradient, hessian))
        leaf = rate * g / (h + ridge)
        trees.feature.append(feature)
        trees.limit.append(limit)
        trees.leaf.append(leaf)
        z += leaf[leaf_of]
    return trees


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both ascending, to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of score
    for s, v, w in zip(score[order], y[order], weight[order]):
        blocks.append([w, w * v, w * s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 2] / table[:, 0], table[:, 1] / table[:, 0]
