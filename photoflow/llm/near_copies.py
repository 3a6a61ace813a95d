"""Near-duplicates by exact Jaccard similarity; fingerprints only propose them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free_worker_table, join_hot, map_texts, staged
from .components import components
from .simhash import SEED, first_places, forest, links, local_roots, majority, mixed, relabelled, shingle_hashes, without_dropped

#: Sets of shingles, and shingles in all, that one tile of a proposed group holds on average at most.
TILE_SETS, TILE_SHINGLES = 256, 1 << 20


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def described(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """doc_id, tag (a hash of the text), set (a hash of its distinct shingles),
    size (their number) and the words f0, f1, ... of their fingerprint."""

    def kernel(texts: list[bytes]) -> dict:
        made: dict[str, list] = {"set": [], "size": [], **{f"f{i}": [] for i in range(lanes)}}
        for text in texts:
            h = shingle_set(text, shingle)
            made["set"].append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64)))
            made["size"].append(len(h))
            for lane in range(lanes):
                made[f"f{lane}"].append(majority(mixed(h, lane)))
        return made

    schema = "set long, size long, " + ", ".join(f"f{i} long" for i in range(lanes))
    return map_texts(docs, kernel, schema, {"doc_id": F.col("doc_id"), "tag": F.xxhash64("text")})


def unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of a tile's sets, their sizes, and their shingles one after the other."""
    names, hashes = rows.flatten()
    return np.asarray(names), np.asarray(pc.list_value_length(hashes)).astype(np.int64), np.asarray(hashes.flatten())


def similar(a: tuple, b: tuple | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a set of tile ``a`` and one of ``b`` (of two of ``a`` if that is
    None) whose Jaccard similarity is at least ``similarity``, reduced to a
    forest with the same components; sets of the same name are linked already."""
    (names, sizes, hashes), (others, lengths, shingles) = a, a if b is None else b
    order = np.argsort(hashes, kind="stable")
    keys, owners = hashes[order], np.repeat(np.arange(len(names)), sizes)[order]
    ends, left, right = np.cumsum(lengths), [], []
    for j in range(len(others)):
        h = shingles[ends[j] - lengths[j] : ends[j]]
        low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owners[at], minlength=len(names))
        hit = np.flatnonzero(shared / (sizes + lengths[j] - shared) >= similarity)
        hit = hit[hit < j] if b is None else hit
        left.append(hit)
        right.append(np.full(len(hit), j))
    nodes = names if b is None else np.concatenate([names, others])
    i, j = np.concatenate(left), np.concatenate(right) + (0 if b is None else len(names))
    own = first_places(nodes)
    return forest(nodes, own, local_roots(len(nodes), own.copy(), i, j))


def verified(members: DataFrame, docs: DataFrame, shingle: int, similarity: float, parallel: int) -> DataFrame:
    """A forest (u, v) over sets of shingles of one proposed group that are
    ``similarity`` alike. ``members``: root (the group), set, size, and doc_id
    and tag of a document that has the set.

    All pairs of a group are compared, in tiles of bounded size: a large group
    is divided over as many tasks as it has pairs of tiles, and no row is made
    of a pair of documents. A tile is linked within first and its sets take
    their group's name, so two tiles add a link per pair of such groups.
    """
    groups = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / TILE_SETS, F.col("total") / TILE_SHINGLES)).cast("int")
    wanted = members.join(groups.select("root", chunks.alias("chunks")), "root")
    wanted = staged(wanted.select("root", "set", "chunks", F.pmod(F.xxhash64("set", F.lit(2)), "chunks").cast("int").alias("chunk"), F.col("doc_id").alias("id__"), F.col("tag").alias("tag__")))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.xxhash64("text") == F.col("tag__")))
    keys = {c: F.col(c) for c in ("root", "set", "chunks", "chunk")}
    sets = map_texts(texts, lambda batch: {"hashes": [shingle_set(t, shingle).view(np.int64) for t in batch]}, "hashes array<long>", keys)
    tiles = staged(sets.groupBy("root", "chunks", "chunk").agg(F.collect_set(F.struct("set", "hashes")).alias("rows")))
    renamed = "root long, chunks int, chunk int, u array<long>, v array<long>"

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        for batch in batches:
            for k in range(batch.num_rows):
                u, v = similar(unpacked(batch.column(3)[k].values), None, similarity)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[k : k + 1] for c in range(3)), *(pa.array([x], pa.list_(pa.int64())) for x in (u, v))], names=["root", "chunks", "chunk", "u", "v"])

    own = staged(tiles.select("root", "chunks", "chunk", "rows").mapInArrow(linked, renamed))
    within = own.select(F.explode(F.arrays_zip("u", "v")).alias("e")).select("e.u", "e.v")
    large = tiles.where("chunks > 1").join(own.select("root", "chunk", "u", "v"), ["root", "chunk"])
    left = large.where("chunk + 1 < chunks").select("root", *[F.col(c).alias(f"{c}_a") for c in ("rows", "u", "v")], F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"))
    left = left.repartition(parallel, "root", "chunk")
    across = left.join(large.repartition(parallel, "root", "chunk").hint("shuffle_hash"), ["root", "chunk"]).select("rows_a", "u_a", "v_a", "rows", "u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        for batch in batches:
            for k in range(batch.num_rows):
                named = []
                for c in (0, 3):
                    names, *rest = unpacked(batch.column(c)[k].values)
                    named.append((relabelled(names, *(np.asarray(batch.column(c + i)[k].values) for i in (1, 2))), *rest))
                u, v = similar(*named, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return within.unionByName(across.mapInArrow(run, "u long, v long"))


def near_copies(docs: DataFrame, shingle: int, lanes: int, radius: int, similarity: float) -> DataFrame:
    """One row per document: doc_id, tag (a hash of the text) and component_id,
    the least doc_id that links reach.

    Two documents are linked when their sets of distinct shingles (XXH64 of
    runs of ``shingle`` words) have a Jaccard similarity of ``similarity`` or
    more, or are equal, as of texts without words. Fingerprints of ``64 *
    lanes`` bits that differ in at most ``radius``, of sets whose sizes allow
    that similarity, propose groups; every pair
    within a proposed group is then compared by its shingles. A pair is missed
    only if no chain of proposals joins it. Sets so small that one shingle
    more or less is below ``similarity`` are linked to equal ones only.

    Null and empty texts, and those of white space, have equal sets. Rows that
    repeat are linked as their sets are; a null doc_id gets the component of
    its set. All shingles of a text of any length count; one text's set, and a
    tile of several, is a value of one row. Columns beyond doc_id and text are
    not looked at; an empty table gives no rows.
    """
    words = [f"f{i}" for i in range(lanes)]
    spark = docs.sparkSession
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    narrow = staged(described(docs, shingle, lanes))
    one = F.min(F.struct("doc_id", "tag")).alias("one")
    sets = narrow.groupBy("set", "size", *words).agg(F.min("doc_id").alias("least_id"), one, F.count("*").alias("n"))
    same = ["set", "size", *words]
    sets = staged(sets.withColumnsRenamed({"set": "digest"}).withColumns({"set": F.monotonically_increasing_id(), "node": F.xxhash64(*words, "size")}))
    large = sets.where(F.col("size") / (F.col("size") + 1) >= similarity)
    nodes = staged(large.groupBy("node", "size", *words).agg(F.min("least_id").alias("least_id")))
    proposed = components(links(nodes, lanes, radius, parallel, similarity))
    members = large.join(proposed, "node", "left").select(F.coalesce("root", "node").alias("root"), "set", "size", "one.doc_id", "one.tag")
    roots = components(verified(members, docs, shingle, similarity, parallel))
    labelled = staged(sets.select("set", "digest", "size", *words, "least_id", "n").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")))
    total = narrow.count()
    of_root = staged(labelled.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("held")))
    of_set = join_hot(labelled.select("root", F.col("digest").alias("set"), "size", *words, "n"), of_root, ["root"], "held", total)
    return join_hot(narrow, staged(of_set.select(*same, "component_id", "n")), same, "n", total).select("doc_id", "tag", "component_id")


def kept_rows(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group: that with the least doc_id.

    All columns stay, whatever their names. Of rows that repeat the least
    doc_id and its text one stays. Null and empty texts, and those of white
    space, are equal; an empty table stays empty.
    """
    return without_dropped(docs, near_copies(docs, **how))
