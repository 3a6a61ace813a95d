"""Token counts of every prefix of a text, by prefix dynamic programming.

The shortest path (BPE) of a prefix ends in one piece, and what stands before
that piece is the path of a shorter prefix.  So ``count[i] = count[i - len(last[i])] + 1``, where last[i]
is the only piece ending at i that BPE keeps apart from the last piece of the
shorter prefix.  One pass gives the exact count at every prefix.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_texts, table, worker_table
from .pieces import Bounded, Pieces, default_model, shared_model

LIMIT = 4096
#: A generation of the tables of chunks' steps and of pairs; a worker holds no others.
TABLE_BYTES = 48 << 20


def prefix_steps(chunk: str, model: Pieces) -> bytes:
    """How the count changes with each character of a chunk, one signed byte each.

    A new character joins at most the characters of one piece, so a step below
    -128 needs a piece of more than 128 characters; such a step is an error
    (OverflowError), never a wrong count.
    """
    ids, counts = model.ids, [0]
    for i, piece in enumerate(model.relaxed(chunk)[1:], 1):
        counts.append(counts[i - len(piece)] + (1 if piece in ids else len(model.fallback(piece))))
    return array("b", [b - a for a, b in zip(counts, counts[1:], strict=False)]).tobytes()


class Counter:
    """Steps of whole texts; chunks that no piece spans are counted apart, once each."""

    def __init__(self, model: Pieces):
        if not model.identity or not model.byte_ids:
            raise ValueError("counts of prefixes need the identity normaliser with a space in front, no user-defined pieces, and byte fallback")
        self.model = model
        self.steps = Bounded(lambda chunk: prefix_steps(chunk, model), TABLE_BYTES)

    def of_text(self, text: str) -> bytes:
        if not text:
            return b""
        steps = b"".join(map(self.steps.__getitem__, self.model.chunks(text)))
        first = np.frombuffer(steps[:2], dtype=np.int8).sum()  # the leading space is no character of the text
        return first.astype(np.int8).tobytes() + steps[2:]


def counts_at(steps: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64)


def longest_within(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(counts_at(steps) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, limit_chars
    (characters of the longest prefix within the limit) and prefix_steps.

    prefix_steps has a signed byte for each character: the change of the token
    count from the prefix before it. Their running sum is the exact count at
    every prefix, so any budget is answered without encoding again
    (``longest_prefixes``). A null or empty text has no tokens. No special
    tokens are added; their strings are ordinary text. Texts of any length are
    counted whole and rows that repeat each; an empty table gives no rows;
    other columns are not looked at.
    """
    shared = shared_model(docs.sparkSession, model_path)

    def kernel(texts: list[bytes]) -> dict:
        counter = worker_table(("prefixes", shared.value), lambda: Counter(Pieces(shared.value, TABLE_BYTES)))
        steps = [counter.of_text(t.decode("utf-8", "replace")) for t in texts]
        tokens = [int(np.frombuffer(s, dtype=np.int8).sum(dtype=np.int64)) for s in steps]
        return {
            "n_bytes": [len(t) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
            "limit_chars": [longest_within(s, limit) if n > limit else len(s) for s, n in zip(steps, tokens, strict=True)],
            "prefix_steps": pa.array(steps, type=pa.binary()),
        }

    schema = "n_bytes long, n_tokens long, over_limit boolean, limit_chars long, prefix_steps binary"
    return map_texts(docs, kernel, schema, {"doc_id": F.col("doc_id")}, tables=True)


def longest_prefixes(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id and budget_chars: the characters that a token budget leaves, read
    from the stored counts, whatever the text's length. Null counts are those of
    an empty text, which any budget leaves 0; rows that repeat are answered
    each, an empty table gives no rows, other columns are not looked at."""

    def run(batches):
        for batch in batches:
            chars = [longest_within(s or b"", budget) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64())], names=["doc_id", "budget_chars"])

    return counted.select("doc_id", "prefix_steps").mapInArrow(run, counted.select("doc_id").schema.add("budget_chars", "long"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
