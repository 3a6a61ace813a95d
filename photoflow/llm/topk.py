"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are dealt to ``parts`` nodes.  A node knows its
share of every score.  Phase 1 gathers each node's best entries per query and
takes as cutoff the k-th best whole score among them.  Phase 2 hands the
cutoff out; a node returns the entries of at least cutoff / parts, for a score
that reaches the cutoff has such a share in some node (Cao and Wang, 2004),
unless the lengths of what it does not see keep the score below the cutoff.
Phase 3 scores anew, tile by tile, the entries that some node has not returned
and whose bound reaches the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import staged, table

TOP = 5
PARTS = 2
#: Distinct vectors of one tile, and distinct query vectors of one, on average at most.
TILE = 8192
QUERY_TILE = 1024
#: Queries of a tile that are compared with a vector tile at once, and pairs scored at once.
BLOCK = 256
#: Entries of a query that phase 1 gathers from each node, about; more make the cutoff higher.
GATHERED = 128
#: Copies of a vector are first ranked in so many groups apart from one another.
SALTS = 64
#: Products of components and their sums are exact as doubles below this.
EXACT = float(1 << 53)


def whole_components(vector: Column) -> Column:
    """floor(256 * x) of each component; null unless all are finite numbers."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, scaled)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """node (a number), least (vec_id), key, v and ids: the ``most`` least vec_ids
    of the rows of each distinct vector, in order; a vec_id that repeats is there as often.

    No result needs more rows of a vector than that. Copies are ranked in
    groups before they meet, so a vector that a third of all rows share moves
    a bounded number of rows to one task.
    """
    salted = rows.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)))
    first = Window.partitionBy("key", "salt").orderBy("vec_id")
    second = Window.partitionBy("key").orderBy("vec_id")
    few = salted.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    few = few.withColumn("n", F.row_number().over(second)).where(F.col("n") <= most)
    found = few.groupBy("key").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("v").alias("v"))
    return found.withColumn("node", F.monotonically_increasing_id())


def length_up(x: Column) -> Column:
    """The length of a vector, rounded up to a whole number."""
    return F.ceil(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))).cast("long")


def tiled(vectors: DataFrame, parts: int, width: int, extra: list[str]) -> DataFrame:
    """(tile, part, packed, held): a part's components of all vectors of a tile,
    each vector as node, least, ``extra``, the length of its other parts, and
    the components; shorter vectors end in zeros."""
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    part = -(-width // parts)
    rows = vectors.withColumn("padded", padded)
    others = [F.concat(F.slice("padded", 1, p * part), F.slice("padded", (p + 1) * part + 1, width)) for p in range(parts)]
    cut = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), length_up(others[p]).alias("rest"), F.slice("padded", p * part + 1, part).alias("x")) for p in range(parts)]))
    rows = rows.select("node", "least", *extra, "tile", cut.alias("cut"))
    row = F.concat(F.array("node", "least", *extra, "cut.rest"), F.col("cut.x"))
    return rows.groupBy("tile", F.col("cut.part").alias("part")).agg(F.flatten(F.sort_array(F.collect_list(F.struct("least", row.alias("row"))))["row"]).alias("packed"), F.count("*").alias("held"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: as doubles where that is exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def met(query_tiles: DataFrame, vector_tiles: DataFrame, count: int) -> DataFrame:
    """Each query tile beside each vector tile of the same part, a row per pair."""
    to = query_tiles.select("part", F.col("packed").alias("q"), F.col("held").alias("q_held"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tile"))
    return to.join(vector_tiles.hint("shuffle_hash"), ["tile", "part"]).select("part", "q", "q_held", "packed", "held")


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, q, nq, v, nv = (batch.column(c)[k] for c in range(5))
            yield part.as_py(), np.asarray(q.values).reshape(nq.as_py(), -1), np.asarray(v.values).reshape(nv.as_py(), -1)


def largest(share: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest of each row; of equal ones the first."""
    width = share.shape[1]
    if width <= n:
        return np.broadcast_to(np.arange(width), share.shape)
    if float(np.abs(share).max(initial=0)) * width < EXACT:
        return np.argpartition(np.arange(width) - share * width, n - 1, axis=1)[:, :n]
    return np.argsort(-share, axis=1, kind="stable")[:, :n]


#: Columns of a packed row before the components, of a query and of a vector.
QUERY_HEAD, VECTOR_HEAD = 5, 3
ENTRY = "query long, node long, part int, share long"


def entries(query: np.ndarray, node: np.ndarray, part: int, share: np.ndarray) -> pa.RecordBatch:
    parts = np.full(len(query), part, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(node), pa.array(parts), pa.array(share)], names=["query", "node", "part", "share"])


def best_shares(pairs: DataFrame, most: int) -> DataFrame:
    """Phase 1: the ``most`` largest shares of each query in each tile and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q, v in pair_rows(batches):
            for start in range(0, len(q), BLOCK):
                block = q[start : start + BLOCK]
                share = products(block[:, QUERY_HEAD:], v[:, VECTOR_HEAD:])
                at = largest(share, most)
                yield entries(np.repeat(block[:, 0], at.shape[1]), v[at.ravel(), 0], part, np.take_along_axis(share, at, axis=1).ravel())

    return pairs.mapInArrow(run, ENTRY)


def sufficient_shares(pairs: DataFrame, parts: int) -> DataFrame:
    """Phase 2: shares of at least the query's cutoff / parts whose score can
    still beat the cutoff, or equal it with a vec_id that is not larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q, v in pair_rows(batches):
            for start in range(0, len(q), BLOCK):
                block = q[start : start + BLOCK]
                cutoff, last, rest = (block[:, c, None] for c in (2, 3, 4))
                share = products(block[:, QUERY_HEAD:], v[:, VECTOR_HEAD:])
                i, j = np.nonzero(share >= -(-cutoff // parts))  # whole shares: the cutoff's part, rounded up
                most = share[i, j].astype(np.float64) + rest[i, 0].astype(np.float64) * v[j, 2]
                most += 0.5 + np.abs(most) * 1e-12  # beyond rounding; scores are whole
                hit = (most >= cutoff[i, 0] + 1) | (most >= cutoff[i, 0]) & (v[j, 1] <= last[i, 0])
                i, j = i[hit], j[hit]
                yield entries(block[i, 0], v[j, 0], part, share[i, j])

    return pairs.mapInArrow(run, ENTRY)


def whole_scores(wanted: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, node) with their exact scores. The pairs of two tiles meet those
    tiles' whole vectors in one task, as packed rows."""
    placed = wanted.join(queries.select(F.col("node").alias("query"), F.col("tile").alias("q_tile")), "query").join(vectors.select("node", F.col("tile").alias("tile")), "node")
    pairs = placed.groupBy("q_tile", "tile").agg(F.collect_list("query").alias("query"), F.collect_list("node").alias("node"))

    def packed(rows: DataFrame, tile: str, name: str) -> DataFrame:
        return rows.groupBy(F.col("tile").alias(tile)).agg(F.collect_list("node").alias(f"{name}_node"), F.collect_list("v").alias(f"{name}_v"))

    both = pairs.join(packed(queries, "q_tile", "q").hint("shuffle_hash"), "q_tile").join(packed(vectors, "tile", "v").hint("shuffle_hash"), "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, node, q_node, q_v, v_node, v_v = (batch.column(c)[k].values for c in range(6))
                (q, a), (v, b) = in_order(q_node, q_v), in_order(v_node, v_v)
                width = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
                asked, node = np.asarray(asked), np.asarray(node)
                i, j = np.searchsorted(q, asked), np.searchsorted(v, node)
                score = np.concatenate([np.einsum("ij,ij->i", a[i[at : at + BLOCK]], b[j[at : at + BLOCK]]) for at in range(0, len(i), BLOCK)])
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(node), pa.array(score)], names=["query", "node", "score"])

    return both.select("query", "node", "q_node", "q_v", "v_node", "v_v").mapInArrow(run, "query long, node long, score long")


def in_order(nodes: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A tile's nodes in order, and their vectors as rows; shorter ones end in zeros."""
    names = np.asarray(nodes)
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten())
    whole = np.zeros((len(names), int(sizes.max(initial=0))), dtype=np.int64)
    whole[np.arange(whole.shape[1]) < sizes[:, None]] = flat
    order = np.argsort(names)
    return names[order], whole[order]


def best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least", "node")
    return scores.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, parts: int = PARTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of
    each row where ``is_query`` holds with every other row, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding, other columns are not looked at;
    components x count as floor(256 * x). Vectors that are null or hold a null
    or non-finite component, and rows of null vec_id, take no part; a shorter
    vector counts as if it ended in zeros, an empty one scores 0. Every row is
    a candidate of its own: rows that repeat a vec_id, with the same vector or
    another, are candidates of one another, and each that asks has a list of
    its own. Fewer rows than k give them all; an empty table gives none.
    Components must stay below 2^31 / 256 in size, so that scores are whole
    64-bit numbers.

    Equal vectors are one node, with their k + 1 least rows. The cutoff of each
    query travels inside its tile; nothing that grows is broadcast.
    """
    v = whole_components(F.col("embedding"))
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    rows = rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    nodes = staged(distinct_vectors(rows, k + 1))
    asking = staged(rows.where("asks").select("vec_id", "key", "row").join(nodes.select("key", "node"), "key").select("vec_id", "row", F.col("node").alias("query")))
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    count, width = max(1, -(-size["n"] // TILE)), max(1, size["width"] or 0)
    query_tiles = max(1, -(-asking.select("query").distinct().count() // QUERY_TILE))

    def dealt(rows: DataFrame, tiles: int) -> DataFrame:
        return rows.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(tiles)).cast("int"))

    nodes = dealt(nodes, count)
    queries = dealt(nodes.join(asking.select(F.col("query").alias("node")).distinct(), "node", "left_semi").drop("tile"), query_tiles)
    queries = staged(queries.select("node", "least", "v", "tile"))
    tiles = staged(tiled(nodes, parts, width, []))
    wanted = k + 1  # a query's own row is among the best, and goes later
    least = nodes.select("node", "least")

    unknown = queries.withColumns({"cutoff": F.lit(0).cast("long"), "last": F.lit(0).cast("long")})
    first = best_shares(met(tiled(unknown, parts, width, ["cutoff", "last"]), tiles, count), max(wanted, -(-GATHERED // count)))
    per_part = Window.partitionBy("query", "part").orderBy(F.desc("share"), "node")
    local = first.withColumn("n", F.row_number().over(per_part)).where(F.col("n") <= max(wanted, GATHERED)).select("query", "node").distinct()
    worst = F.max(F.struct((-F.col("score")).alias("score"), "least")).alias("worst")
    cutoff = best(whole_scores(local, queries, nodes).join(least, "node"), wanted).groupBy("query").agg(worst, F.count("*").alias("n"))
    # with fewer vectors than wanted, all were gathered, and none is kept out
    cutoff = cutoff.select(F.col("query").alias("node"), (-F.col("worst.score")).alias("cutoff"), F.col("worst.least").alias("last"))
    informed = staged(queries.join(cutoff, "node"))

    shares = sufficient_shares(met(tiled(informed, parts, width, ["cutoff", "last"]), tiles, count), parts)
    seen = shares.groupBy("query", "node").agg(F.sum("share").alias("score"), F.count("*").alias("parts_seen"))
    seen = seen.join(informed.select(F.col("node").alias("query"), "cutoff"), "query")
    # an unseen share is below cutoff / parts, or cannot lift the score to the cutoff
    hopeful = staged(seen.where(F.col("score") * parts + F.col("cutoff") * (parts - F.col("parts_seen")) >= F.col("cutoff") * parts))
    known = hopeful.where(F.col("parts_seen") == parts).select("query", "node", "score")
    resolved = known.unionByName(whole_scores(hopeful.where(F.col("parts_seen") < parts).select("query", "node"), queries, nodes))
    resolved = resolved.join(informed.select(F.col("node").alias("query"), "cutoff"), "query").where(F.col("score") >= F.col("cutoff")).join(least, "node")

    lists = best(resolved, wanted).select("query", "node", "score").join(nodes.select("node", "ids"), "node")
    lists = lists.select("query", "node", "score", F.explode("ids").alias("vec_id"))
    short = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "node")
    lists = lists.withColumn("n", F.row_number().over(short)).where(F.col("n") <= wanted).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "node"))).alias("list"))
    # one entry of the list is the asking row itself, unless enough rows of the same vector come first
    own = F.array_min(F.transform(F.filter("list", lambda e: (e["vec_id"] == F.col("vec_id")) & (e["node"] == F.col("query"))), lambda e: e["n"]))
    others = asking.join(lists, "query").withColumn("own", F.coalesce(own, F.lit(0)))
    others = others.select(F.col("vec_id").alias("query_id"), "own", F.explode(F.slice(F.filter("list", lambda e: e["n"] != F.col("own")), 1, k)).alias("e"))
    rank = F.col("e.n") - F.when((F.col("own") > 0) & (F.col("own") < F.col("e.n")), 1).otherwise(0)
    return others.select("query_id", rank.cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op2_topk": op2_topk}
ORACLE_SQL = {
    "op2_topk": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
