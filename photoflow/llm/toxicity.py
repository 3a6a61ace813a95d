"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes.

The features of a text are the character n-grams of its words, each counted
once however often it occurs.  A feature's value is its log-count ratio r, how
much more often texts labelled toxic have it (Wang and Manning, 2012), and a
logistic model with an L2 penalty is fitted on those values.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .base import hash52, map_texts, named, staged, table, worker_table
from .pieces import Bounded

#: Lengths of the n-grams; a word has one mark in front and one behind.
SIZES = (3, 4, 5, 6)
#: The model is fitted on so many labelled rows at most, the first by a hash of the id.
MOST_ROWS = 8_000
#: N-grams enter the model if so many texts of the sample have them and their
#: log-likelihood ratio against the label is at least so large (chance: 1 in 100).
LEAST_TEXTS = 3
LEAST_GAIN = 3.32
#: Texts whose n-grams are counted in one table before it is given on.
COUNTED_AT_ONCE = 200
SMOOTHING = 1.0
PENALTY = 0.01
THRESHOLD = 0.5

words_of = re.compile(r"[^\W\d_]+").findall


def distinct_words(text: bytes) -> set[str]:
    return set(words_of(text.decode("utf-8", "replace").lower()))


def ngrams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Weights of n-grams (already times r), the bias, and where scores are cut."""

    weights: dict[str, float]
    bias: float


def fit(rows: list[np.ndarray], labels: np.ndarray, grams: list[str], texts_with: np.ndarray) -> Model:
    """``rows`` are the places in ``grams`` of each text's n-grams; ``texts_with``
    has for each n-gram the number of texts of label 1 and 0 that have it.
    Without both labels the model knows nothing: it scores every text by the
    share of label 1."""
    n, positive = len(labels), int(labels.sum())
    if not 0 < positive < n or not grams:
        return Model({}, math.log((positive + 0.5) / (n - positive + 0.5)) if n else -1.0)
    p, q = texts_with.T.astype(float)
    ratio = np.log((p + SMOOTHING) / (positive + SMOOTHING)) - np.log((q + SMOOTHING) / (n - positive + SMOOTHING))
    row_of = np.repeat(np.arange(n), [len(r) for r in rows])
    weights, bias = logistic(row_of, np.concatenate(rows), ratio, labels.astype(float), PENALTY)
    return Model({g: float(w) for g, w in zip(grams, weights * ratio, strict=True) if abs(w) > 1e-9}, bias)


def likelihood_gain(positive: int, negative: int) -> Column:
    """The log-likelihood ratio of an n-gram's presence against the label, of columns p and q."""
    rate = (F.col("p") + F.col("q")) / F.lit(float(positive + negative))

    def part(k: Column, m: int) -> Column:
        has = F.when(k > 0, k * F.ln(k / (rate * m))).otherwise(0.0)
        lacks = F.when(k < m, (F.lit(m) - k) * F.ln((F.lit(m) - k) / ((F.lit(1.0) - rate) * m))).otherwise(0.0)
        return has + lacks

    return part(F.col("p"), positive) + part(F.col("q"), negative)


def chosen_grams(sample: DataFrame, positive: int, negative: int) -> tuple[list[str], np.ndarray]:
    """The n-grams that enter the model, and how many texts of either label have
    them: counted over the sample by Spark, summed per batch before the shuffle."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_AT_ONCE):
                part = batch.slice(start, COUNTED_AT_ONCE)
                counts: dict[str, int] = {}  # texts of label 1 in the upper half of a number, all in the lower
                for words, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    one = 1 + (label << 32)
                    for g in {g for w in words for g in ngrams(w)}:
                        counts[g] = counts.get(g, 0) + one
                held = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                p = held >> 32
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(p), pa.array((held & 0xFFFFFFFF) - p)], names=["gram", "p", "q"])

    counted = sample.select("words", "label").mapInArrow(run, "gram string, p long, q long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    ranked = counted.where(F.col("p") + F.col("q") >= LEAST_TEXTS).withColumn("gain", likelihood_gain(positive, negative))
    rows = ranked.where(F.col("gain") >= LEAST_GAIN).orderBy("gram").select("gram", "p", "q").toArrow()
    return rows.column("gram").to_pylist(), np.stack([rows.column(c).to_numpy() for c in ("p", "q")], axis=1)


def logistic(row: np.ndarray, column: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the penalised mean log
    loss; a text of the rarer label weighs more, by the root of the counts' ratio.
    The step is the inverse of the loss's largest curvature, found by power iteration."""
    n, m = len(y), len(ratio)
    value = ratio[column]
    share = y.mean()
    importance = np.where(y > 0, math.sqrt((1 - share) / share), 1.0)
    importance /= importance.mean()
    v, bend = np.ones(m + 1), 1.0
    for _ in range(30):
        along = (np.bincount(row, value * v[column], minlength=n) + v[m]) * importance
        v = np.append(np.bincount(column, along[row] * value, minlength=m), along.sum()) / n
        bend = max(float(np.linalg.norm(v)), 1e-12)
        v /= bend
    rate = 1.0 / (0.26 * bend + penalty)
    w, b = np.zeros(m), math.log(share / (1 - share))
    ahead_w, ahead_b, momentum = w, b, 1.0
    for _ in range(rounds):
        margin = np.bincount(row, value * ahead_w[column], minlength=n) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * importance
        next_w = ahead_w - rate * (np.bincount(column, error[row] * value, minlength=m) / n + penalty * ahead_w / math.sqrt(n))
        next_b = ahead_b - rate * error.mean()
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        ahead_w, ahead_b = next_w + pull * (next_w - w), next_b + pull * (next_b - b)
        w, b, momentum = next_w, next_b, following
    return w, float(b)


class Scorer:
    """Scores of whole texts. N-grams of the model have numbers in their order,
    and are found by their first letters; of a word, the packed numbers of those
    it has are kept."""

    def __init__(self, model: Model):
        grams = sorted(model.weights)
        self.bias, self.values = model.bias, np.array([model.weights[g] for g in grams])
        self.starting: dict[str, list[tuple[str, int]]] = {}
        for i, gram in enumerate(grams):
            self.starting.setdefault(gram[: SIZES[0]], []).append((gram, i))
        self.of_word = Bounded(self._of_word)

    def _of_word(self, word: str) -> bytes:
        padded, first, starting = f"<{word}>", SIZES[0], self.starting
        held = [n for i in range(len(padded) - first + 1) for gram, n in starting.get(padded[i : i + first], ()) if padded.startswith(gram, i)]
        return array("i", held).tobytes()

    def score(self, text: bytes) -> float:
        packed = b"".join(map(self.of_word.__getitem__, distinct_words(text)))
        held = np.zeros(len(self.values), dtype=bool)
        held[np.frombuffer(packed, dtype=np.intc)] = True
        margin = self.bias + float(self.values[held].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most_rows: int) -> DataFrame:
    """doc_id, text and label of at most ``most_rows`` labelled rows where
    ``train`` holds: the first in the order of a hash of the id.

    The sample's ids have a fixed size, so they are broadcast. Of rows that
    repeat an id, that whose text has the least hash stands for it.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = ids.orderBy(hash52(F.col("doc_id")), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, most_rows: int = MOST_ROWS) -> Model:
    """The model fitted on labelled rows that are not held out, ``most_rows`` at
    most. The driver gets the counts of the chosen n-grams and which of them each
    row has: tables of that sample, which its bound keeps from growing."""
    chosen = labelled_sample(docs, labels, "toxic", ~held_out, most_rows)

    def kernel(texts: list[bytes]) -> dict:
        return {"words": pa.array([sorted(distinct_words(t)) for t in texts], type=pa.list_(pa.string()))}

    sample = staged(map_texts(chosen, kernel, "words array<string>", {"doc_id": F.col("doc_id"), "label": (F.col("label") > 0).cast("int")}))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    grams, texts_with = chosen_grams(sample, positive, n - positive) if 0 < positive < n else ([], np.zeros((0, 2)))
    place = {g: i for i, g in enumerate(grams)}

    def places(batches):
        for batch in batches:
            held = [sorted({place[g] for w in words for g in ngrams(w) if g in place}) for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "label", "held"])

    rows = sample.select("doc_id", "label", "words").mapInArrow(places, sample.select("doc_id", "label").schema.add("held", ArrayType(IntegerType()))).orderBy("doc_id", "held").toArrow()
    held = rows.column("held").combine_chunks()
    return fit([np.asarray(x.values, dtype=np.int64) for x in held], rows.column("label").to_numpy(), grams, texts_with)


def scored(docs: DataFrame, model: Model, keys: dict[str, Column]) -> DataFrame:
    """``keys`` of each document and its score, 0 to 1: how likely it is toxic.

    Whole texts are read; a null or empty text, or one without letters, has the
    score of the bias alone.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), ("toxicity", model.bias, len(model.weights), sum(model.weights.values()))

    def kernel(texts: list[bytes]) -> dict:
        scorer = worker_table(key, lambda: Scorer(shared.value))
        return {"score": [scorer.score(t) for t in texts]}

    return map_texts(docs, kernel, "score double", keys, tables=True)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Held out are rows whose crc32 of the id's text is 0 modulo 5 (a null id:
    of an empty text). Labels are nothing but training targets; a doc_id with
    several labels counts as toxic if one of them is. A null text is empty; an
    empty text, like one without letters, has the score of the bias alone.
    Rows that repeat are scored each, a text of any length is read whole, and
    without labels every score is alike. Columns beyond doc_id and text are not
    looked at; an empty table gives no rows.
    """
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs, labels, held_out)
    found = scored(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted_rows(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored toxic; all columns stay, whatever their names.

    The text and the other columns pass through the scoring task, so nothing
    is shuffled. Null and empty texts are no more toxic than the bias says; rows
    that repeat are judged alike; an empty table stays empty.
    """
    model = train(train_docs, labels, fold(F.col("doc_id"), 5) == 0)
    found = scored(docs, model, {f"c{i}": named(c) for i, c in enumerate(docs.columns)})
    return found.where(F.col("score") < THRESHOLD).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
