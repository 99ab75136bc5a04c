"""Histogram gradient-boosted trees for two classes, flattened into arrays for vectorised scoring."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays: node k tests feature[k] <= threshold[k] and goes to left[k] or left[k] + 1.
    A leaf is its own left child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all rows walk all trees at once, a level a step."""
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                child = self.left[node]
                right = part[row, self.feature[node]] > self.threshold[node]
                node = np.where(child == node, node, child + right)
            out[at : at + 4096] = self.base + self.value[node].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each feature at its quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Newton boosting on the logistic loss. Gradients are summed in histograms of binned features, a level of a tree
    at a time. With no rows, or rows of one class only, the forest has no split and gives the (smoothed) prior."""
    n, width = x.shape
    p0 = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p0 / (1 - p0)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1), np.zeros(1, int), base, 0)
    cuts = _edges(x, bins)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    size = bins + 1
    raw = np.full(n, base)
    offset = np.arange(width) * size
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = len(feature)
        roots.append(root)
        feature.append(0), threshold.append(0.0), left.append(root), value.append(0.0)
        node_of = np.zeros(n, int)  # place of a row's node among this level's nodes; -1 once in a leaf
        level = [root]
        for d in range(depth + 1):
            live = np.nonzero(node_of >= 0)[0]
            k = len(level)
            gs, hs = np.bincount(node_of[live], g[live], k), np.bincount(node_of[live], h[live], k)
            for i, node in enumerate(level):
                value[node] = -rate * gs[i] / (hs[i] + ridge)
            if d == depth or not k:
                break
            flat = ((node_of[live] * width * size)[:, None] + offset + binned[live]).ravel()
            rep = lambda v: np.repeat(v[live], width)
            shape = (k, width, size)
            hg = np.bincount(flat, rep(g), k * width * size).reshape(shape).cumsum(2)
            hh = np.bincount(flat, rep(h), k * width * size).reshape(shape).cumsum(2)
            hn = np.bincount(flat, minlength=k * width * size).reshape(shape).cumsum(2)
            tg, th, tn = hg[:, :, -1:], hh[:, :, -1:], hn[:, :, -1:]
            gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
            gain[(hn < least) | (tn - hn < least)] = -np.inf
            best = gain.reshape(k, -1).argmax(1)
            next_level, goes = [], np.full(k, -1)
            f_of, b_of = best // size, best % size
            for i, node in enumerate(level):
                if gain[i, f_of[i], b_of[i]] > 1e-6:
                    child = len(feature)
                    feature[node], threshold[node], left[node] = int(f_of[i]), float(cuts[f_of[i]][b_of[i]]), child
                    for c in (child, child + 1):
                        feature.append(0), threshold.append(0.0), left.append(c), value.append(0.0)
                    goes[i] = len(next_level)
                    next_level += [child, child + 1]
            mine = node_of[live]
            right = binned[live, f_of[mine]] > b_of[mine]
            node_of[live] = np.where(goes[mine] >= 0, goes[mine] + right, -1)
            # rows that stop here take the leaf's value at the end of the tree
            stopped = live[node_of[live] < 0]
            raw[stopped] += np.array([value[level[i]] for i in mine[goes[mine] < 0]]) if len(stopped) else 0
            level = next_level
        live = np.nonzero(node_of >= 0)[0]
        if len(live):
            raw[live] += np.array([value[node] for node in level])[node_of[live]]
    # internal nodes carry no value
    left_, value_ = np.array(left), np.array(value)
    value_[left_ != np.arange(len(left_))] = 0.0
    return Forest(np.array(feature), np.array(threshold), left_, value_, np.array(roots), base, depth)
