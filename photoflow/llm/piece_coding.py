"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The machine is the composition of three parts, compiled from a model file:
the normaliser (rewriting rules, spaces to U+2581, one in front), the pieces
(a trie whose final states emit an id) and byte fallback (a character that no
piece has emits its bytes, or the unknown id).  A text is composed with it
part by part, only where the text leads, and the tropical-semiring shortest
path is its encoding (``Pieces.relaxed``).

For a unigram model an arc weighs minus its score.  For a BPE model the
weights are 0 and infinity: the machine remembers the piece it emitted last,
and an arc to a piece that BPE would not keep apart from it weighs infinity.
Exactly one path of a text has a finite weight, and that path is BPE's result,
so the shortest path is exact for the merges too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .base import free_name, map_texts, named, table, worker_table
from .pieces import SPACE, TABLE_BYTES, Bounded, Pieces, default_model, shared_model

#: Ids that are spelled at once.
BLOCK = 1 << 17
#: A generation of each table of a worker that holds no others before.
ALONE_BYTES = 48 << 20


class Transducer:
    """Shortest paths of whole texts, and what ids spell. ``most`` bounds a
    generation of the table of chunks' paths."""

    def __init__(self, model: Pieces, most: int = TABLE_BYTES):
        self.model = model
        self.paths = Bounded(lambda chunk: np.array(model.shortest(chunk), dtype="<i4").tobytes(), most)
        self.spelled = [b"" if i in model.control else p.replace(SPACE, " ").encode() for i, p in enumerate(model.text)]
        for byte, i in model.byte_ids.items():
            self.spelled[i] = bytes([byte])
        self.spelled[model.unknown] = model.unknown_text.encode()
        self.letters = np.frombuffer(b"".join(self.spelled), dtype=np.uint8)
        self.sizes = np.array([len(p) for p in self.spelled], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit numbers. Paths never span two chunks,
        so the shortest path is the chunks' paths in a row."""
        packed = b"".join(map(self.paths.__getitem__, self.model.chunks(text)))
        if self.model.byte_ids:
            return packed
        ids = np.frombuffer(packed, dtype="<i4")
        again = np.zeros(len(ids), dtype=bool)  # a run of unknown characters is one id
        again[1:] = (ids[1:] == self.model.unknown) & (ids[:-1] == self.model.unknown)
        return ids[~again].tobytes()

    def spell(self, ids: np.ndarray) -> bytes:
        """What ids spell, one after another."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        source = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.letters[source].tobytes()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of several documents, whose ids lie one after another; the
        document k has those from offsets[k] to offsets[k + 1]."""
        spelled = b"".join(self.spell(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK))
        cuts = np.concatenate([[0], np.cumsum(self.sizes[ids])])[offsets].tolist()
        front, trim = self.model.normalised.front, self.model.normalised.trim
        texts = [spelled[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [t.lstrip(b" ") if trim else t[1:] if front and t[:1] == b" " else t for t in texts]


def transducer_of(model: bytes, most: int = TABLE_BYTES) -> Transducer:
    """The compiled machine of a model file, shared by the tasks of a worker."""
    return worker_table(("paths", model, most), lambda: Transducer(Pieces(model, most), most))


def coded_batch(machine: Transducer, texts: list[bytes], both: bool) -> dict:
    packed = [machine.encode(t.decode("utf-8", "replace")) for t in texts]
    sizes = np.fromiter((len(p) // 4 for p in packed), dtype=np.int64, count=len(packed))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.frombuffer(b"".join(packed), dtype="<i4")
    made = {"n_tokens": pa.array(sizes), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))}
    if both:
        decoded = machine.decode(ids, offsets)
        made["decoded"] = [t.decode("utf-8", "replace") for t in decoded]
        made["round_trip"] = [a == b for a, b in zip(texts, decoded, strict=True)]
    return made


def coded(docs: DataFrame, model_path: str, keys: tuple[str, ...], both: bool, most: int = TABLE_BYTES) -> DataFrame:
    shared = shared_model(docs.sparkSession, model_path)

    def kernel(texts: list[bytes]) -> dict:
        return coded_batch(transducer_of(shared.value, most), texts, both)

    own = ["text_crc32", "n_tokens", "ids", *(["decoded", "round_trip"] if both else [])]
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    schema = "n_tokens long, ids array<int>" + (", decoded string, round_trip boolean" if both else "")
    found = map_texts(docs, kernel, schema, {f"key {i}": named(k) for i, k in enumerate(keys)} | {"text_crc32": crc}, tables=True)
    return found.select(*[named(f"key {i}").alias(k) for i, k in enumerate(keys)], *[F.col(c).alias(free_name(c, keys)) for c in own])


def encode(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: its ``keys``, text_crc32 of its bytes, n_tokens and
    ids (array<int>). A null or empty text has no ids; texts of any length are
    encoded whole and rows that repeat each; an empty table gives no rows.
    Other columns are not looked at. Own columns whose name a key has get an
    underscore behind it."""
    return coded(docs, model_path, keys, both=False)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with the column decoded (with an underscore behind it if there
    is one): the text that its ids spell. Null ids and empty lists spell an empty
    text; lists of any length are spelled whole, in blocks; rows that repeat are
    spelled each; other columns pass through; an empty table stays empty."""
    shared = shared_model(encoded.sparkSession, model_path)
    at, name = encoded.columns.index("ids"), free_name("decoded", encoded.columns)
    schema = StructType([*encoded.schema.fields, StructField(name, StringType())])

    def run(batches):
        machine = transducer_of(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(at).fill_null([]) if part.column(at).null_count else part.column(at)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                texts = [t.decode("utf-8", "replace") for t in machine.decode(ids, offsets - offsets[0])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",), most: int = TABLE_BYTES) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task holds one compiled
    machine: the columns of both, and round_trip, whether the decoded text is
    the one that went in (null as empty). A normaliser that rewrites texts
    makes it false. Awkward rows and names are dealt with as by ``encode``.
    ``most``: bytes of a generation of each table of a worker."""
    return coded(docs, model_path, keys, both=True, most=most)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"), default_model(), most=ALONE_BYTES)
    return both.select("doc_id", "n_tokens", "ids", "text_crc32", "round_trip")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
