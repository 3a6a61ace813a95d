"""Gradient boosting of small trees, and thresholds calibrated on held-out rows.

Trees grow from sums over rows alone: weights of each column's values, and per
level slopes and curvatures of the loss in each bin. Whoever calls says how
they are summed: over arrays (``boosted``), or over tasks. Sums are whole
numbers of 1 / UNIT, so neither their order nor a division of the rows matters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

DEPTH = 3
BINS = 24
SHRINK = 1.0
#: What a row of weight one counts.
UNIT = 1 << 30
INNER = 2**DEPTH - 1


@dataclass
class Trees:
    """Complete trees: feature and cut of each inner node, level by level, and leaf values."""

    bias: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Growing:
    """Trees over numbers of bins: feature and last bin to the left of each inner
    node, and leaf values, which the tree that still grows lacks."""

    bias: float
    features: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)


def edges_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Cuts between the bins of a column, from its sorted values and their weights."""
    ends = np.cumsum(weights)
    return np.unique(values[np.searchsorted(ends, np.linspace(0, 1, BINS + 1)[1:-1] * ends[-1])])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def first_bias(right: int, every: int) -> float:
    return float(np.log((right + 0.5 * UNIT) / (every - right + 0.5 * UNIT)))


def descended(bins: np.ndarray, feature: np.ndarray, place: np.ndarray, levels: int) -> np.ndarray:
    rows, node = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (bins[rows, feature[node]] > place[node])
    return node


def slope_sums(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, grown: Growing, level: int) -> np.ndarray:
    """Slopes and curvatures of the loss, summed by node of a level of the last
    tree, column and bin."""
    margin = np.full(len(y), grown.bias)
    for feature, place, leaf in zip(grown.features, grown.places, grown.leaves, strict=False):
        margin += leaf[descended(bins, feature, place, DEPTH) - INNER]
    p = 1 / (1 + np.exp(-margin))
    node = descended(bins, grown.features[-1], grown.places[-1], level) - (2**level - 1)
    columns = bins.shape[1]
    at = (bins + (np.arange(columns) + columns * node[:, None]) * BINS).ravel()
    sums = [np.bincount(at, np.repeat(np.rint(weight * v), columns), 2**level * columns * BINS) for v in (y - p, p * (1 - p))]
    return np.array(sums).astype(np.int64)


def grown_trees(sums: Callable[[Growing, int], np.ndarray], edges: list[np.ndarray], bias: float, rounds: int = 60, rate: float = 0.2) -> Trees:
    """Trees fitted one after another to the slope of the log loss; ``sums`` gives
    ``slope_sums`` over all rows."""
    grown = Growing(bias)
    for _ in range(rounds):
        feature, place = np.zeros(INNER, dtype=np.int64), np.full(INNER, BINS)
        grown.features.append(feature)
        grown.places.append(place)
        for level in range(DEPTH):
            g, h = (sums(grown, level) / UNIT).reshape(2, 2**level, len(edges), BINS)
            for k in range(2**level):
                found = best_split(g[k], h[k])
                if found is not None:
                    feature[2**level - 1 + k], place[2**level - 1 + k] = found
        leaf = []
        for k in range(2**level):
            at = 2**level - 1 + k
            for side in (slice(0, place[at] + 1), slice(place[at] + 1, BINS)):
                leaf.append(rate * g[k, feature[at], side].sum() / (h[k, feature[at], side].sum() + SHRINK))
        grown.leaves.append(np.array(leaf))
    cuts = [[edges[f][p] if p < BINS else np.inf for f, p in zip(*nodes, strict=True)] for nodes in zip(grown.features, grown.places, strict=True)]
    return Trees(bias, np.array(grown.features), np.array(cuts), np.array(grown.leaves))


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees from arrays; a row of weight UNIT counts once."""
    columns = [np.unique(x[:, i], return_inverse=True) for i in range(x.shape[1])]
    edges = [edges_of(values, np.bincount(at, weight)) for values, at in columns]
    bins = binned(x, edges)
    bias = first_bias(int(weight[y > 0].sum()), int(weight.sum()))
    return grown_trees(lambda grown, level: slope_sums(bins, y, weight, grown, level), edges, bias)


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
    """(column, last bin to the left) of the split that gains most, if any does,
    from slopes and curvatures by column and bin."""
    gs, hs = g.cumsum(axis=1), h.cumsum(axis=1)
    rest_g, rest_h = gs[:, -1:] - gs, hs[:, -1:] - hs
    gain = gs**2 / (hs + SHRINK) + rest_g**2 / (rest_h + SHRINK) - gs[:, -1:] ** 2 / (hs[:, -1:] + SHRINK)
    gain[:, -1] = 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(i), int(j)) if gain[i, j] > 1e-9 else None


def least_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The least score from which on the accepted rows reach a precision; 2, beyond any score, if none does."""
    values, at = np.unique(-scores, return_inverse=True)
    right, every = np.bincount(at, weight * y).cumsum(), np.bincount(at, weight).cumsum()
    enough = np.flatnonzero(right >= precision * every)
    return max(0.5, float(-values[enough[-1]])) if len(enough) else 2.0
