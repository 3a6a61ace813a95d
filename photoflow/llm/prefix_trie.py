"""The trie of conversations' prefixes, built one level at a time.

A level groups the live conversations by their node and their next turn; the
least conv_id names the new node.  A conversation alone in its node is a chain
from there on, written without further levels, so levels go as deep as
prefixes are shared.  Then, from the deepest level up, joins with the parent
add up children, leaves and savings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import join_hot, staged, table

#: Turns that a rebuilt conversation takes from the first of its block at most, less one; ids of a block.
HEADS, BLOCK = 6, 100
#: Rows of the sorted turns whose conversations make one piece of a node's list of ends.
PIECE = 1024
NOTHING = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; turns count as equal if it is. The role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, chars and at: the row's number (from 0) in the order of
    conv_id, turn (null first) and digest.

    Sorted ranges of rows, so that one conversation may fill many tasks; a
    range's first number is the sum of the sizes before it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(role, text).alias("digest"), F.length(text).alias("chars"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    by = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    numbered = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "digest", "chars", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("local")))
    sizes = numbered.groupBy("range").agg(F.count("*").alias("n"), F.min("local").alias("first")).orderBy("range").collect()
    offsets, before = [], 0
    for r in sizes:  # one row a partition
        offsets.append((r["range"], before - r["first"]))
        before += r["n"]
    shift = conversations.sparkSession.createDataFrame(offsets, "range int, shift long")
    return numbered.join(F.broadcast(shift), "range").select("conv_id", "digest", "chars", (F.col("local") + F.col("shift")).alias("at"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns, piece) of each rebuilt conversation, and its turns (conv_id, place, digest, chars).

    A conversation's first ``h`` turns are those of the first conversation of
    its block of ids, h a hash of its own id below HEADS; then come its own
    after the first h. piece numbers rising ranges of conv_id of PIECE at most.
    """
    rows = in_order(conversations)
    own = staged(rows.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("held"))
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    known = own.select("conv_id", "first", "n", h.alias("h"), base.alias("head")).join(heads, "head", "left")
    known = known.withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    known = staged(known.select("conv_id", "first", "n", "h", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"), F.floor(F.col("first") / PIECE).alias("piece")))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = staged(join_hot(rows, known.select("conv_id", "first", "h", "taken", F.col("n").alias("weight")), ["conv_id"], "weight", total).select("conv_id", "digest", "chars", "h", "taken", (F.col("at") - F.col("first") + 1).alias("place")))
    rest = places.where("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "digest", "chars")
    first = places.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < HEADS)).select(F.col("conv_id").alias("head"), "place", "digest", "chars")
    lent = known.select("conv_id", "head", "h").join(first, "head").where("place <= h").select("conv_id", "place", "digest", "chars")
    turns = staged(rest.unionByName(lent).repartitionByRange("place", "conv_id").sortWithinPartitions("place"))
    return known.select("conv_id", "n_turns", "piece"), turns


def joined_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256): the hash of the ids, ascending and
    comma-joined, of ``ends`` (depth, node, conv_id, piece).

    Ids of a piece are joined first. A hash runs through all pieces of a node in
    order, so one task reads them, a batch at a time.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "node", "piece").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) != now:
                    done += [(*now, state.hexdigest())] if now else []
                    now, state = (depth, node), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield rows_of(done)
        yield rows_of([(*now, state.hexdigest())] if now else [])

    def rows_of(found: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["depth", "node", "ends_sha256"])

    by = ["depth", "node"]
    return pieces.repartition(*by).sortWithinPartitions(*by, "piece").select(*by, "ids").mapInArrow(run, "depth long, node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node, all long but the last: conv_id (the least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    A node is a distinct sequence of first turns (role and text) of the rebuilt
    conversations (``rebuilt``), the root that of none. Turns are ordered by
    number, null first; rows that share one, repeated rows among them, by the
    hash of role and text. A null role or text is empty; rows without a conv_id
    belong to no conversation. Texts of any length are one hash and a count of
    code points. No conversation, no node: an empty table gives no rows.
    Columns beyond conv_id, turn, role and text are not looked at. There are as
    many levels as turns that two conversations share.
    """
    convs, turns = rebuilt(conversations)
    least, total = convs.agg(F.min("conv_id"), F.count("*")).first()
    spark = conversations.sparkSession
    child = "depth long, conv_id long, parent_conv_id long, n_convs long, chars long"
    levels = [spark.createDataFrame([(0, least, None, total, 0)] if total else [], child)]
    members = convs.withColumn("node", F.lit(least).cast("long"))
    ends, chains = [], []
    while True:
        depth = len(levels)
        ends.append(members.where(F.col("n_turns") == depth - 1).select(F.lit(depth - 1).cast("long").alias("depth"), "node", "conv_id", "piece"))
        live = members.where(F.col("n_turns") >= depth)
        step = staged(live.join(turns.where(F.col("place") == depth).select("conv_id", "digest", "chars"), "conv_id"))
        nodes = step.groupBy("node", "digest").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.min("chars").cast("long").alias("chars"), F.min("n_turns").alias("n_turns"))
        nodes = staged(nodes)
        chains.append(nodes.where("n = 1").select(F.col("child").alias("conv_id"), F.lit(depth).cast("long").alias("alone"), F.col("node").alias("parent"), "n_turns"))
        shared = nodes.where("n > 1")
        levels.append(shared.select(F.lit(depth).cast("long").alias("depth"), F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), "chars"))
        held = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not held:
            break
        members = staged(join_hot(step, shared.select("node", "digest", "child", F.col("n").alias("weight")), ["node", "digest"], "weight", held).select("conv_id", "n_turns", "piece", F.col("child").alias("node")))
    rolled = below = None
    for depth in range(len(levels) - 1, -1, -1):
        one = F.lit(1).cast("long")
        kids = [chains[depth].select("parent", one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))] if depth < len(chains) else []
        kids += [below.select(F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens")] if below is not None else []
        found = levels[depth].withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
        if kids:
            sums = reduce(DataFrame.unionByName, kids).groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("more"))
            found = found.join(sums, F.col("conv_id") == F.col("parent"), "left")
        else:
            found = found.withColumns({"n_children": F.lit(None).cast("long"), "n_leaves": F.lit(None).cast("long"), "more": F.lit(None).cast("long")})
        zero = F.lit(0).cast("long")
        below = staged(found.select("depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more", zero)).alias("saved_tokens")))
        rolled = below if rolled is None else rolled.unionByName(below)
    hashes = joined_hashes(reduce(DataFrame.unionByName, ends)).withColumnsRenamed({"depth": "d", "node": "v"})
    top = rolled.join(hashes, (F.col("depth") == F.col("d")) & (F.col("conv_id") == F.col("v")), "left").drop("d", "v")
    top = top.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return top.unionByName(chain_nodes(reduce(DataFrame.unionByName, chains), turns))


def chain_nodes(chains: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, alone, parent, n_turns) from the depth
    ``alone`` on, where each is the only member: a row per turn from there."""
    chains = staged(chains)
    total = chains.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0]
    rows = join_hot(turns.select("conv_id", "place"), chains.withColumn("weight", F.col("n_turns")), ["conv_id"], "weight", total).where("place >= alone")
    last, own = F.col("place") == F.col("n_turns"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return rows.select(
        F.col("place").cast("long").alias("depth"), "conv_id", F.when(F.col("place") == F.col("alone"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, own).otherwise(NOTHING).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of an id's digits, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || x)) AS p, r, x
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT c, own, {_CRC} % 6 AS h FROM (SELECT c, count(*) AS own FROM t GROUP BY c)),
built AS (
  SELECT i.c, b.p, b.r, b.x FROM ids i JOIN t b ON b.c = i.c - i.c % 100 AND b.p <= i.h
  UNION ALL
  SELECT i.c, least(i.h, coalesce(k.own, 0)) + o.p - i.h AS p, o.r, o.x FROM ids i JOIN t o ON o.c = i.c LEFT JOIN ids k ON k.c = i.c - i.c % 100 WHERE o.p > i.h),
paths AS (SELECT i.c, CASE WHEN count(b.p) = 0 THEN [] ELSE list({{'r': b.r, 'x': b.x}} ORDER BY b.p) END AS path FROM ids i LEFT JOIN built b ON b.c = i.c GROUP BY i.c),
held AS (SELECT c, len(path) AS n, u.d, path[1:u.d] AS node FROM paths, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d) u),
nodes AS (
  SELECT d, node, min(c) AS c, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ids,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(node[d].x) END AS own
  FROM held GROUP BY d, node),
linked AS (SELECT k.*, p.c AS parent FROM nodes k LEFT JOIN nodes p ON p.d = k.d - 1 AND p.node = k.node[1:k.d - 1]),
kids AS (SELECT d - 1 AS d, parent AS c, count(*) AS m FROM linked WHERE d > 0 GROUP BY ALL),
above AS (SELECT u.a, k.node[1:u.a] AS node, k.own, (q.m IS NULL)::INT AS leaf FROM linked k LEFT JOIN kids q ON q.d = k.d AND q.c = k.c, LATERAL (SELECT unnest(range(0, k.d + 1)) AS a) u),
sums AS (SELECT a, node, sum(own) AS saved, sum(leaf) AS leaves FROM above GROUP BY a, node)
SELECT k.c AS conv_id, k.d::BIGINT AS depth, k.parent AS parent_conv_id, k.n::BIGINT AS n_convs, coalesce(q.m, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(coalesce(k.ids, '')) AS ends_sha256
FROM linked k JOIN sums s ON s.a = k.d AND s.node = k.node LEFT JOIN kids q ON q.d = k.d AND q.c = k.c
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {"op13_prefix_trie": _SQL}
