"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is
written as Parquet and read again as the next one's ``docs``.  All stages but
the last return the columns of ``docs``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.cluster import ship_package
from photoflow.llm import exact_dedup, mixing, near_copies, piece_coding, toxicity
from photoflow.llm.base import discard, free_name, named, shared_dir, table, written
from photoflow.llm.pieces import default_model

#: Near-duplicates: sets of shingles of five words with a Jaccard similarity of
#: 0.8 or more. 256-bit fingerprints only propose them: texts of similarity 0.8
#: differ in 39 bits on average (4 against 5 shingles: 48), with a deviation of
#: 6; unrelated texts in 110 to 128, with one of 8.
SHINGLE, LANES, RADIUS, SIMILARITY = 5, 4, 72, 0.8


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The classifier is
    fitted on labelled rows of the raw table that its contract lets it see.

    Null and empty texts have the score of the bias alone, which keeps them;
    whole texts of any length are scored; rows that repeat are kept or dropped
    alike; an empty table stays empty.
    """
    ship_package(spark)
    return toxicity.accepted_rows(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each equal text: that with the largest doc_id.

    Null texts count as empty, and one of all empty ones stays; a null doc_id
    stays only in a group without any other; of rows that repeat doc_id and
    text one stays; texts of any length are compared whole; an empty table
    stays empty.
    """
    ship_package(spark)
    return exact_dedup.kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id.

    Null texts, empty ones and those of white space are one group; of rows
    that repeat doc_id and text one stays; all shingles of a text of any
    length count; an empty table stays empty.
    """
    ship_package(spark)
    return near_copies.kept_rows(docs, shingle=SHINGLE, lanes=LANES, radius=RADIUS, similarity=SIMILARITY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weighted mix of sources takes it.

    Null and empty texts, and those of white space, have no words and are
    taken 0 times; a null source is the last one; rows that repeat are
    documents of their own; a text of any length is taken whole or not at all;
    an empty table stays empty.
    """
    ship_package(spark)
    return mixing.mixed_rows(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs but text, then n_tokens and ids of each whole text,
    the text that the ids spell, and whether that is the text which went in.

    A null text is empty, and an empty one has no ids; rows that repeat are
    coded each; an empty table stays empty. Where docs has a column of such a
    name, the new one gets an underscore behind it.
    """
    ship_package(spark)
    keys = tuple(c for c in docs.columns if c != "text")
    found = piece_coding.round_trip(docs, default_model(), keys)
    own = {c: free_name(c, keys) for c in ("n_tokens", "ids", "decoded", "round_trip")}
    renamed = {"decoded": free_name("text", keys)}
    return found.select(*[named(k).alias(k) for k in keys], *[F.col(c).alias(renamed.get(k, c)) for k, c in own.items()])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", coded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself is deleted once its
    result is written; stages' results stay, for a look at what each one kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, mark = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}", written()
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, mark)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
#: The classifier and the shortest paths are beyond SQL.
ORACLE_SQL = None
