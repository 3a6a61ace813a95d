"""Quality by a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and so have a few
pairs of features.  Shallow trees, boosted in turn over the features and then
over the pairs, are added into those tables (Lou et al., 2013), so that a score
is a sum of table entries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_texts, table
from .toxicity import fold, labelled_sample

#: The model is fitted on so many labelled rows at most, the first by a hash of the id.
MOST_ROWS = 8_000
BINS = 32
#: Bins of a feature within a pair, and how many pairs get a table.
PAIR_BINS = 8
MOST_PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
LEAST_ROWS = 15
SHRINK = 1.0
THRESHOLD = 0.7

#: Kinds of bytes whose shares are features.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" ",
    "line": b"\n",
    "stop": b".,;:?",
    "bang": b"!",
    "quote": b"'\"()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "pipe": b"|",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "beyond_ascii": bytes(range(128, 256)),
}
FEATURES = (*KINDS, "size", "entropy", "word_size", "distinct", "repeated", "longest", "line_size", "line_repeats", "ends")

_kind = np.zeros((256, len(KINDS)))
for _i, _bytes in enumerate(KINDS.values()):
    _kind[list(_bytes), _i] = 1.0


def features(text: bytes) -> list[float]:
    """Numbers about a whole text; none depends on its language or source column."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    many, held = max(len(words), 1), max(len(lines), 1)
    return [
        *(counts @ _kind / n).tolist(),
        math.log1p(n),
        float(-(share * np.log(share)).sum()),
        sum(map(len, words)) / many,
        math.log(max(len(set(words)), 1)) / math.log(many + 1),
        sum(map(eq, words, words[1:])) / many,
        math.log1p(max(map(len, words), default=0)),
        math.log1p(n / held),
        1 - len(set(lines)) / held if lines else 0.0,
        sum(x.rstrip()[-1:] in b".?" for x in lines) / held,
    ]


@dataclass
class Model:
    """Cuts between bins, a table per feature, tables of pairs, and the bias."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        if self.cuts:
            bins = binned(x, self.cuts)
            for i, lookup in enumerate(self.tables):
                margin += lookup[bins[i]]
            for i, j, lookup in self.pairs:
                margin += lookup[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal counts; a value that many rows share has a bin of its own."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    edges = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    following = distinct[np.minimum(np.searchsorted(distinct, edges, side="right"), len(distinct) - 1)]
    return np.unique((edges + following) / 2)


def split_gain(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best place to part bins in two, and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    left = np.cumsum(np.stack([g, h, n]), axis=1)
    right = left[:, -1:] - left
    gain = left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - left[0, -1] ** 2 / (left[1, -1] + SHRINK)
    gain = np.where((left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS), gain, 0.0)[:-1]
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def small_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of two levels over ordered bins, as the value of each bin."""
    value = np.zeros(len(g))
    gain, middle = split_gain(g, h, n)
    if gain <= 0:
        return value
    for a, b in ((0, middle), (middle, len(g))):
        inner, at = split_gain(g[a:b], h[a:b], n[a:b])
        for x, y in ((a, a + at), (a + at, b)) if inner > 0 else ((a, b),):
            value[x:y] = g[x:y].sum() / (h[x:y].sum() + SHRINK)
    return value


def quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross cut of a square of bins: its gain, and the value of each cell."""
    sums = np.stack([g, h, n]).cumsum(axis=1).cumsum(axis=2)
    all_, row, column = sums[:, -1:, -1:], sums[:, :-1, -1:], sums[:, -1:, :-1]
    a = sums[:, :-1, :-1]
    b, c = row - a, column - a
    d = all_ - row - column + a
    gain = sum(q[0] ** 2 / (q[1] + SHRINK) for q in (a, b, c, d)) - all_[0] ** 2 / (all_[1] + SHRINK)
    gain = np.where(np.minimum.reduce([q[2] for q in (a, b, c, d)]) >= LEAST_ROWS, gain, 0.0)
    value = np.zeros(g.shape)
    if not gain.size or gain.max() <= 0:
        return 0.0, value
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [float(q[0, i, j] / (q[1, i, j] + SHRINK)) for q in (a, b, c, d)]
    value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts features in turn, then the pairs with the largest gain left.

    Without rows, or with one label only, the model scores the share of label 1.
    """
    n, positive = len(y), int(y.sum())
    bias = math.log((positive + 0.5) / (n - positive + 0.5))
    if not 0 < positive < n:
        return Model(bias)
    cuts = [cuts_of(x[:, i], BINS) for i in range(x.shape[1])]
    bins = binned(x, cuts)
    width = [len(c) + 1 for c in cuts]
    tables = [np.zeros(w) for w in width]
    counts = [np.bincount(b, minlength=w).astype(float) for b, w in zip(bins, width, strict=True)]
    margin = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, (b, w) in enumerate(zip(bins, width, strict=True)):
            g, h = slopes()
            step = RATE * small_tree(np.bincount(b, g, w), np.bincount(b, h, w), counts[i])
            tables[i] += step
            margin += step[b]

    coarse = [np.minimum(np.cumsum(c) - c, c.sum() - 1) * PAIR_BINS // c.sum() for c in counts]
    coarse = [np.unique(c, return_inverse=True)[1] for c in coarse]
    g, h = slopes()

    def square(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = coarse[i].max() + 1, coarse[j].max() + 1
        return np.bincount(coarse[i][bins[i]] * shape[1] + coarse[j][bins[j]], values, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((quadrants(square(i, j, g), square(i, j, h), square(i, j, np.ones(n)))[0], i, j) for i, j in combinations(range(len(bins)), 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:MOST_PAIRS] if gain > 0]
    held = {p: np.zeros((coarse[p[0]].max() + 1, coarse[p[1]].max() + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slopes()
            _, value = quadrants(square(i, j, g), square(i, j, h), square(i, j, np.ones(n)))
            held[i, j] += RATE * value
            margin += RATE * value[coarse[i][bins[i]], coarse[j][bins[j]]]
    return Model(bias, cuts, tables, [(i, j, t) for (i, j), t in held.items()], coarse)


def feature_rows(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``keys`` and x, the features of each whole text."""
    return map_texts(docs, lambda texts: {"x": [features(t) for t in texts]}, "x array<double>", keys)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, most_rows: int = MOST_ROWS) -> Model:
    """The model fitted on labelled rows that are not held out, ``most_rows`` at
    most. The driver gets the features of those rows, a table of fixed size."""
    sample = labelled_sample(docs, labels, "quality", ~held_out, most_rows)
    rows = feature_rows(sample, {"doc_id": F.col("doc_id"), "label": F.col("label").cast("double")}).toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, rows.column("doc_id").to_numpy()])
    return fit(x[order], rows.column("label").to_numpy()[order])


def scored(docs: DataFrame, model: Model, keys: dict[str, Column]) -> DataFrame:
    """``keys`` and the score of each whole text: how likely its quality is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list[bytes]) -> dict:
        return {"score": shared.value.scores(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))).tolist()}

    return map_texts(docs, kernel, "score double", keys)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Held out are rows whose crc32 of the id's text is 2 modulo 4 (a null id: of
    an empty text). Labels are nothing but training targets; of a doc_id with
    several labels the largest counts. A null text is empty; empty texts have
    all features 0 and are scored like others, and rows that repeat are scored
    each. Texts of any length are read whole. Without labels every score is alike.
    Columns beyond doc_id and text are not looked at; an empty table gives no rows.
    """
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs, labels, held_out)
    found = scored(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
