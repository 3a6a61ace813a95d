"""Exact duplicates by composable polynomial fingerprints.

A text of bytes b_0..b_{n-1} has the fingerprint sum(b_i * B^(n-1-i)) modulo
two primes below 2^31.  Chunks are hashed apart from one another and combined
by length-shifted arithmetic: H(xy) = H(x) * B^len(y) + H(y).  A huge text is
dealt in parts over tasks, each of which shifts its part's hash by what comes
after it; the sum of the shifted hashes is the text's.  Equal fingerprints only
nominate: their texts are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_texts, slices, staged, table, text_bytes, without_marked

#: Two primes below 2^31, and a base for each.
PRIMES = np.array([2147483647, 2147483629], dtype=np.int64)
BASES = (1000000007, 911382323)
CHUNK = 1024
#: Bytes whose chunks are hashed at once.
BLOCK = 1 << 20
#: Texts above so many bytes are huge: their parts, of as many bytes, are hashed by different tasks.
HUGE = 8 << 20
#: A bit table tells which fingerprints may occur more than once: so many bits
#: for each that does, within these bounds (2 and 64 MiB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 24, 1 << 29
COMPARE_CHUNK = 1 << 16


def powers(base: int, prime: int, n: int) -> list[int]:
    out = [1] * n
    for i in range(1, n):
        out[i] = out[i - 1] * base % prime
    return out


WEIGHTS = np.array([powers(b, int(p), CHUNK)[::-1] for b, p in zip(BASES, PRIMES, strict=True)], dtype=np.float64).T


def chunk_hashes(data: bytes) -> np.ndarray:
    """Hashes of the chunks of CHUNK bytes, aligned at the end; zeros in front
    of the first chunk add nothing. All products and sums stay below 2^53."""
    lead = -len(data) % CHUNK
    rows = np.frombuffer(bytes(lead) + data, dtype=np.uint8).reshape(-1, CHUNK)
    return (rows.astype(np.float64) @ WEIGHTS).astype(np.int64) % PRIMES


def shift(i: int, length: int) -> int:
    return pow(BASES[i], length, int(PRIMES[i]))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """The fingerprint of a text from those of its two parts."""
    return tuple((left[i] * shift(i, right_length) + right[i]) % int(PRIMES[i]) for i in range(2))


STEPS = tuple(shift(i, CHUNK) for i in range(2))


def block_fingerprint(data: bytes) -> tuple[int, int]:
    first = second = 0
    p, q = int(PRIMES[0]), int(PRIMES[1])
    for a, b in chunk_hashes(data).tolist():
        first, second = (first * STEPS[0] + a) % p, (second * STEPS[1] + b) % q
    return first, second


def fingerprint(data: bytes) -> tuple[int, int]:
    """Blocks are hashed one after another and combined, so that a long text
    takes no more memory than its own and a block's."""
    blocks = [data] if len(data) <= BLOCK else (data[at : at + BLOCK] for at in range(0, len(data), BLOCK))
    pairs = ((block_fingerprint(b), len(b)) for b in blocks)
    return reduce(lambda left, right: (combine(left[0], right[0], right[1]), 0), pairs)[0]


def kernel(texts: list[bytes]) -> dict:
    pairs = [fingerprint(t) for t in texts]
    return {"n_bytes": [len(t) for t in texts], "fp_a": [a for a, _ in pairs], "fp_b": [b for _, b in pairs], "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}


CLASS = ["fp_a", "fp_b", "n_bytes"]


def is_huge() -> Column:
    return F.coalesce(F.octet_length("text") > HUGE, F.lit(False))


def parts_of(texts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys``, part_no and part: texts in parts of ``size`` bytes, at least one
    each, a part a row."""
    last = F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / size).cast("int")
    numbered = texts.select(*keys, F.explode(F.sequence(F.lit(0), last)).alias("part_no"), "text")
    return numbered.select(*keys, "part_no", F.substring("text", F.col("part_no") * size + 1, F.lit(size)).alias("part"))


def described_huge(docs: DataFrame) -> DataFrame:
    """The columns of ``kernel`` for huge texts: parts are rows that any task can
    hash, and the text's fingerprint is the sum of their shifted hashes."""
    texts = docs.where(is_huge()).select(F.monotonically_increasing_id().alias("row"), "doc_id", text_bytes().alias("text"))
    texts = texts.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "text")
    parts = parts_of(texts, ["row", "doc_id", "n_bytes", "text_sha256"], HUGE).repartition("row", "part_no")
    schema = parts.drop("part_no", "part").schema.add("fp_a", "long").add("fp_b", "long")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, number, size = batch.column(5)[k].as_py(), batch.column(4)[k].as_py(), batch.column(2)[k].as_py()
                after = size - number * HUGE - len(part)
                moved = combine(fingerprint(part), (0, 0), after)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(k, 1) for i in range(4)), pa.array([moved[0]], pa.int64()), pa.array([moved[1]], pa.int64())], names=schema.names)

    hashed = parts.mapInArrow(run, schema)
    sums = [F.pmod(F.sum(c), F.lit(int(p))).alias(c) for c, p in zip(("fp_a", "fp_b"), PRIMES, strict=True)]
    return hashed.groupBy("row", "doc_id", "n_bytes", "text_sha256").agg(*sums).select("doc_id", "n_bytes", "fp_a", "fp_b", "text_sha256")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, fp_a, fp_b and text_sha256 of each row."""
    small = map_texts(docs.where(~is_huge()), kernel, "n_bytes long, fp_a long, fp_b long, text_sha256 string", {"doc_id": F.col("doc_id")})
    return small.unionByName(described_huge(docs))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when their bytes are; the row with the largest doc_id of a
    group stays.  A null text counts as empty.  Rows that repeat both the text
    and the largest doc_id all carry ``kept`` here (``kept_rows`` leaves one of
    them); a null doc_id is kept only in a group without any other.  Columns
    beyond doc_id and text are not looked at.  An empty table gives an empty
    result.  Texts above HUGE bytes are hashed in parts by many tasks; only
    their SHA-256, which cannot be put together from parts, is made by one.

    A bit table, sized by how many fingerprints repeat but never above 64 MiB,
    marks those that may; only such texts meet again, cut into chunks whose
    least and greatest value per class and chunk number are aggregated
    (partially before the shuffle), so that a class of any size moves one chunk
    per task.  Where the table is full more texts meet, with the same result.
    """
    narrow = staged(described(docs))
    for by in (CLASS, [*CLASS, "text_sha256"]):
        digests = (F.min("text_sha256") == F.max("text_sha256")).alias("one_digest")
        multiple = staged(narrow.groupBy(*by).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), digests).where("group_size > 1"))
        if multiple.where("not one_digest").isEmpty() and not has_unequal_texts(docs, narrow, multiple, by):
            return report(narrow.join(multiple, by, "left"))
    raise ValueError("different texts share a polynomial fingerprint, a length and a SHA-256")


def report(joined: DataFrame) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_bytes",
    )


def repeated_bits(multiple: DataFrame) -> np.ndarray:
    """The bit table: of as many bits as fit the number of classes, MOST_BITS at most."""
    bits = LEAST_BITS
    wanted = min(MOST_BITS, multiple.count() * BITS_EACH)
    while bits < wanted:
        bits *= 2
    place = F.expr(f"(fp_a * 31 + fp_b) & {bits - 1}L")
    words = multiple.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast((fp_a * 31 + fp_b) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def has_unequal_texts(docs: DataFrame, narrow: DataFrame, multiple: DataFrame, by: list[str]) -> bool:
    """Whether any class of equal fingerprints holds different texts.

    If all chunks of a class have one value each per chunk number, its texts
    are equal: they have the same length, which is part of the class.
    """
    candidates = texts_of(docs, multiple).withColumn("text_sha256", F.sha2("text", 256))
    known = narrow.where(F.col("n_bytes") > HUGE).select(*CLASS, "text_sha256").distinct().join(multiple.select(*by), by, "left_semi")
    huge = docs.where(is_huge()).select(text_bytes().alias("text")).withColumn("text_sha256", F.sha2("text", 256)).join(known, "text_sha256")
    pieces = parts_of(candidates.select(*by, "text").unionByName(huge.select(*by, "text")), by, COMPARE_CHUNK)
    compared = pieces.groupBy(*by, "part_no").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    return not compared.where("least != most").join(multiple.select(*by), by, "left_semi").isEmpty()


def texts_of(docs: DataFrame, multiple: DataFrame) -> DataFrame:
    """Texts, but for huge ones, whose fingerprint may be among ``multiple``,
    hashed anew where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bits(multiple).tobytes())

    def run(batches):
        bits = np.frombuffer(shared.value, dtype=np.uint64)
        mask = len(bits) * 64 - 1
        for batch in batches:
            for part in slices(batch):
                texts = part.column(0).to_pylist()
                pairs = np.array([fingerprint(t) for t in texts], dtype=np.int64).reshape(-1, 2)
                at = (pairs[:, 0] * 31 + pairs[:, 1]) & mask
                hit = np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
                columns = [pa.array(pairs[hit, 0]), pa.array(pairs[hit, 1]), pa.array([len(texts[i]) for i in hit], pa.int64()), pa.array([texts[i] for i in hit], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*CLASS, "text"])

    return docs.where(~is_huge()).select(text_bytes().alias("text")).mapInArrow(run, "fp_a long, fp_b long, n_bytes long, text binary")


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each equal text: that with the largest doc_id.
    All columns stay, whatever their names; of rows that repeat that doc_id and
    text one stays. A null text is empty, and an empty table stays empty."""
    found = staged(exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("tag"), "kept"))
    repeated = found.where("kept").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
    return without_marked(docs, F.sha2(text_bytes(), 256), found.where("not kept").distinct(), repeated)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents"""
}
