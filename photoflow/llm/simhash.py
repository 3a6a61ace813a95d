"""Near-duplicates by SimHash, all fingerprints compared exactly in tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import free_worker_table, join_hot, map_texts, staged, table, without_marked
from .components import components

SEED = 42
#: Distinct fingerprints of one tile, on average at most.
TILE = 32768
#: Rows of a tile whose links are joined at once; rows and columns that are compared at once, few enough for a core's cache.
BLOCK, ROWS, COLUMNS = 64, 8, 4096
#: Bands of set sizes, of which so many lie between two sizes that are just alike enough.
BANDS = 4


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the space-joined runs of ``size`` words, repeats included; a text
    of fewer words is one shingle, one of none has no shingle. Only A-Z are
    lower-cased, and words end at ASCII white space."""
    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits from a hash (the finaliser of SplitMix64); lane 0 is the hash itself."""
    if not lane:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; as a signed number."""
    if not len(h):
        return 0
    letters = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(letters), 255):  # sums of bytes that cannot overflow
        counts += np.add.reduce(np.unpackbits(letters[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """doc_id, tag (a hash of the text) and the words f0, f1, ... of the fingerprint."""

    def kernel(texts: list[bytes]) -> dict:
        rows = []
        for text in texts:
            h = shingle_hashes(text, shingle)
            rows.append([majority(mixed(h, lane)) for lane in range(lanes)])
        return {f"f{i}": [r[i] for r in rows] for i in range(lanes)}

    schema = ", ".join(f"f{i} long" for i in range(lanes))
    return map_texts(docs, kernel, schema, {"doc_id": F.col("doc_id"), "tag": F.xxhash64("text")})


def local_roots(n: int, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` after joining the ends of the links a-b: least label of each group."""
    while True:
        least = np.minimum(labels[a], labels[b])
        if np.array_equal(least, labels[a]) and np.array_equal(least, labels[b]):
            return labels
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while not np.array_equal(labels, hop := labels[labels]):
            labels = hop


def first_places(nodes: np.ndarray) -> np.ndarray:
    """For each place, the first one with the same node."""
    _, first, of = np.unique(nodes, return_index=True, return_inverse=True)
    return first[of]


def forest(nodes: np.ndarray, own: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node that was joined to another one, to the least of its group."""
    moved = np.flatnonzero((own == np.arange(len(nodes))) & (labels != own))
    return nodes[moved], nodes[labels[moved]]


def relabelled(nodes: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Nodes, each by the one that a forest links it to."""
    out, order = nodes.copy(), np.argsort(u)
    if len(u):
        at = np.minimum(np.searchsorted(u[order], nodes), len(u) - 1)
        out = np.where(u[order][at] == nodes, v[order][at], nodes)
    return out


def near_pairs(a: np.ndarray, columns: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of ``a`` and places of ``columns`` whose words differ in at most ``radius`` bits."""
    left, right, n = [], [], len(columns[0])
    for at in range(0, len(a), ROWS):
        rows = a[at : at + ROWS]
        for start in range(0, n, COLUMNS):
            words = [c[start : start + COLUMNS] for c in columns]
            differing = np.empty((len(rows), len(words[0])), dtype=np.uint64)
            count, total = (np.empty(differing.shape, dtype=np.uint8) for _ in range(2))
            for w, word in enumerate(words):
                np.bitwise_xor(rows[:, w : w + 1], word, out=differing)
                np.bitwise_count(differing, out=count if w else total)
                if w:
                    np.add(total, count, out=total)
            hit = np.flatnonzero(total <= radius)
            if len(hit):
                i, j = np.divmod(hit, total.shape[1])
                left.append(i + at)
                right.append(j + start)
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    # a count of 256 bits is 0 in a byte
    near = sum(np.bitwise_count(a[i, w] ^ c[j]).astype(np.int64) for w, c in enumerate(columns)) <= radius
    return i[near], j[near]


def tile_forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, or within one that is given twice, reduced to a
    forest with the same components. Rows of a tile are (node, word 0, word 1,
    ...); rows of the same node are linked already."""
    nodes = np.concatenate([left[:, 0], right[:, 0]])
    own = first_places(nodes)
    labels, words = own.copy(), left.shape[1] - 1
    a = np.ascontiguousarray(left[:, 1:]).view(np.uint64)
    columns = [np.ascontiguousarray(right[:, 1 + w]).view(np.uint64) for w in range(words)]
    for at in range(0, len(a), BLOCK):
        first = at if left is right else 0  # the rows before met these already
        i, j = near_pairs(a[at : at + BLOCK], [c[first:] for c in columns], radius)
        if len(i):
            labels = local_roots(len(nodes), labels, i + at, j + first + len(a))
    return forest(nodes, own, labels)


def links(nodes: DataFrame, lanes: int, radius: int, parallel: int, similarity: float | None = None) -> DataFrame:
    """A forest (u, v) over fingerprints that differ in at most ``radius`` bits.

    A tile holds fingerprints of one population count over all words. It is
    linked within first, and its nodes take their group's name, so that two
    tiles add a link per pair of such groups, not one per node. Two tiles whose counts differ by more than the radius cannot hold a link and
    never meet; the others meet in one task per pair, as packed rows. Which
    tiles meet is a table of their numbers, found by a join.

    With ``similarity``, nodes are sets and have a size: a tile holds sets of
    one band of sizes instead, and meets those of the bands in which a set may
    have that Jaccard similarity, which the ratio of the sizes bounds.
    """
    if similarity is None:
        band, most, reach = sum((F.bit_count(f"f{i}") for i in range(1, lanes)), F.bit_count("f0")), 64 * lanes, radius
    else:
        # a little wider, so that rounding never puts sizes of just that ratio a band too far apart
        band, most, reach = F.floor(F.log(F.col("size").cast("double")) / (-math.log(similarity) / BANDS * (1 + 1e-9))), None, BANDS
    nodes = nodes.withColumn("pop", band.cast("int"))
    sizes = {r["pop"]: r["n"] for r in nodes.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    most = max(sizes, default=0) if most is None else most
    chunks = [-(-sizes.get(p, 0) // TILE) for p in range(most + 1)]
    count = F.element_at(F.array(*[F.lit(max(c, 1)) for c in chunks]), F.col("pop") + 1)
    packed = F.flatten(F.collect_list(F.array("node", *[f"f{i}" for i in range(lanes)])))
    tiles = nodes.groupBy("pop", F.pmod(F.xxhash64("node", F.lit(1)), count).cast("int").alias("chunk")).agg(packed.alias("rows"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        for batch in batches:
            for k in range(batch.num_rows):
                rows = np.array(batch.column(2)[k].values).astype(np.int64).reshape(-1, lanes + 1)
                u, v = tile_forest(rows, rows, radius)
                rows[:, 0] = relabelled(rows[:, 0], u, v)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(1)[k : k + 1], *(pa.array([x], pa.list_(pa.int64())) for x in (rows.ravel(), u, v))], names=["pop", "chunk", "rows", "u", "v"])

    tiles = staged(tiles.repartition(parallel, "pop", "chunk").mapInArrow(linked, "pop int, chunk int, rows array<long>, u array<long>, v array<long>"))
    within = tiles.select(F.explode(F.arrays_zip("u", "v")).alias("e")).select("e.u", "e.v")
    tiles = tiles.select("pop", "chunk", "rows")
    near = tiles.select(F.col("pop").alias("pop_a"), F.col("chunk").alias("chunk_a"), F.explode(F.sequence("pop", F.least(F.col("pop") + reach, F.lit(most)))).alias("pop"))
    meeting = near.join(tiles.select("pop", "chunk"), "pop").where("pop > pop_a or chunk > chunk_a")
    left = meeting.join(tiles.select(F.col("pop").alias("pop_a"), F.col("chunk").alias("chunk_a"), F.col("rows").alias("rows_a")), ["pop_a", "chunk_a"])
    left = left.select("rows_a", "pop", "chunk").repartition(parallel, "pop", "chunk")
    pairs = left.join(tiles.repartition(parallel, "pop", "chunk").hint("shuffle_hash"), ["pop", "chunk"]).select("rows_a", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[k].values).astype(np.int64).reshape(-1, lanes + 1) for c in (0, 1))
                u, v = tile_forest(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return within.unionByName(pairs.mapInArrow(run, "u long, v long"))


def near_dedup(docs: DataFrame, shingle: int = 3, lanes: int = 1, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, tag (a hash of the text), the fingerprint's
    64-bit words f0, f1, ..., and component_id, the least doc_id that links reach.

    Two documents are linked when their fingerprints of ``64 * lanes`` bits
    differ in at most ``radius``.  Null and empty texts, and those of white
    space, have the fingerprint zero and are linked like any other.  Equal
    fingerprints are one node, so a group of copies costs one row; rows that
    repeat a doc_id are joined only if their fingerprints are. A null doc_id
    gets the component of its fingerprint, null if no other is in it. Columns
    beyond doc_id and text are not looked at; an empty table gives no rows.
    All shingles of a text of any length count. The comparison is exact, so its time grows with the square of the number
    of distinct fingerprints, divided over tile pairs.
    """
    words = [f"f{i}" for i in range(lanes)]
    spark = docs.sparkSession
    narrow = staged(fingerprints(docs, shingle, lanes))
    nodes = narrow.groupBy(*words).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    nodes = staged(nodes.select((F.col("f0") if lanes == 1 else F.monotonically_increasing_id()).alias("node"), *words, "least_id", "n"))
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    roots = components(links(nodes, lanes, radius, parallel))
    labelled = staged(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    total = narrow.count()
    least = staged(labelled.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("held")))
    of_fingerprint = join_hot(labelled.select("root", *words, "n"), least, ["root"], "held", total)
    return join_hot(narrow, staged(of_fingerprint.select(*words, "component_id", "n")), words, "n", total).select("doc_id", "tag", *words, "component_id")


def without_dropped(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without those whose doc_id in ``found`` is not its component_id,
    and one of rows that repeat a kept doc_id and its text."""
    found = staged(found.select("doc_id", "tag", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
    repeated = found.where("kept").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
    return without_marked(docs, F.xxhash64("text"), found.where("not kept").distinct(), repeated)


def kept_rows(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group: that with the least doc_id.

    All columns stay, whatever their names. Of rows that repeat the least
    doc_id and its text one stays; rows of that doc_id with other texts of the
    group all do. An empty table stays empty.
    """
    return without_dropped(docs, near_dedup(docs, **how))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"), shingle=3, lanes=1, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
