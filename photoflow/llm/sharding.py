"""Sharding by balanced label propagation.

Documents of equal text are linked.  Every document starts in a shard of its
own id's hash; then, round by round, linked documents move to the shard that
holds most of their neighbours and still has room, within quotas per shard.
Documents without links fill what is left, so that row counts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ROWS_PER_BUCKET, buckets_for, each_copy, running_sum, staged, table

SHARDS = 24
#: Parts of a shard's start that move apart from one another, so that a group
#: with a third of all rows is many small cells: so many at least, and as many
#: as keep a shard's part small.
LEAST_PARTS = 16
#: Steps in which a shard's arrivals are admitted.
STEPS = 256
#: During propagation a shard may hold this share above its quota.
SLACK = 0.1
ROUNDS = 8
#: A shard with less room than this part of its quota takes no more.
FULL = 50


def at(values: list[int], index: Column) -> Column:
    """The value at an index that is not null (guard others: element_at of a
    null index makes a whole CASE null)."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def loads(df: DataFrame, key: str, value: Column, shards: int) -> list[int]:
    """Sums per shard: as many numbers as there are shards."""
    found = {r[key]: r["n"] for r in df.groupBy(key).agg(F.sum(value).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(cells: DataFrame, quotas: list[int], slack: float, rounds: int) -> DataFrame:
    """``cells`` (gid, sub, rows, shard) after moving towards their neighbours.

    A round joins each group's rows per shard with its cells. The wish of a
    cell is the shard with most of the group's rows among those with room; it
    moves if that is more than it has around it (equal counts: by a hash, so
    that two halves do not change places). A shard admits arrivals in the
    order of a hash until its room is used up.
    """
    limits = [int(q * (1 + slack)) for q in quotas]
    for number in range(rounds):
        free = [m - n for m, n in zip(limits, loads(cells, "shard", F.col("rows"), len(quotas)), strict=True)]
        room = [f if f > q // FULL else 0 for f, q in zip(free, quotas, strict=True)]
        around = cells.groupBy("gid", "shard").agg(F.sum("rows").alias("n"))
        rank = F.struct(F.col("n"), F.xxhash64("gid", "shard").alias("tie"))
        wishes = around.where(at(room, F.col("shard")) > 0).groupBy("gid").agg(F.max(F.struct(rank.alias("rank"), F.col("shard"))).alias("best"))
        mine = around.select("gid", "shard", rank.alias("mine"))
        wanting = cells.join(mine, ["gid", "shard"]).join(wishes, "gid", "left")
        moves = (F.col("best.shard") != F.col("shard")) & (F.col("best.rank") > F.col("mine"))
        wanting = staged(
            wanting.select(
                "gid", "sub", "rows", "shard",
                F.when(moves, F.col("best.shard")).alias("wish"),
                F.pmod(F.xxhash64("gid", "sub", F.lit(number)), F.lit(STEPS)).cast("int").alias("step"),
            )
        )
        asked: list[list[int]] = [[0] * STEPS for _ in quotas]
        for r in wanting.where("wish is not null").groupBy("wish", "step").agg(F.sum("rows").alias("n")).collect():
            asked[r["wish"]][r["step"]] = r["n"]
        admitted, moved = [], 0
        for shard, steps in enumerate(asked):
            used = step = 0
            while step < STEPS and used + steps[step] <= room[shard]:
                used, step = used + steps[step], step + 1
            admitted.append(step)
            moved += used
        if not moved:
            return cells
        cells = wanting.select("gid", "sub", "rows", F.when(F.col("wish").isNotNull() & (F.col("step") < at(admitted, F.col("wish"))), F.col("wish")).otherwise(F.col("shard")).alias("shard"))
    return cells


def shards_of(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard, group_id (the text's MD5) and first_shard, where it started.

    The law is ``rows``: counts of shards differ by one at most, and slots of a
    shard run from 0 without gaps; grown_shard is null. Size is the text's
    UTF-8 bytes plus 8; a null text has none and is linked with empty ones.
    Rows that repeat are documents of their own, linked by their text; doc_id
    may be null or of any type. A group larger than a shard fills several. An
    empty table gives no rows; other columns are not looked at. A text of any
    length counts whole and goes to one shard.

    Collected are numbers per shard and admission step only. Rows that repeat
    both doc_id and text are one entry with a count. Ranks come from two-level
    sums over buckets of the group's hash and of the rows' own, so that even
    a shard which one group fills is many buckets.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("gid"))
    narrow = staged(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")))
    rows = narrow.agg(F.sum("copies")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-rows // (shards * ROWS_PER_BUCKET)), min(256, rows // (shards * 256)))
    h = F.xxhash64("doc_id", "gid", F.lit(5))
    narrow = narrow.withColumn("h", h).withColumn("sub", F.pmod("h", F.lit(shards * parts)).cast("int"))
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]

    cells = narrow.groupBy("gid", "sub").agg(F.sum("copies").alias("rows"))
    linked = cells.groupBy("gid").agg(F.sum("rows").alias("all")).where("all > 1").select("gid")
    cells = staged(cells.join(linked, "gid").withColumn("shard", F.floor(F.col("sub") / parts).cast("int")))
    cells = propagate(cells, quotas, slack, rounds)

    placed = narrow.join(cells.select("gid", "sub", "shard"), ["gid", "sub"], "left").withColumn("shard", F.coalesce("shard", F.lit(shards)))
    share = F.conv(F.substring("gid", 1, 8), 16, 10).cast("double") / float(1 << 32)
    bucket = F.floor(share * (buckets_for(rows) // parts + 1)) * parts + F.pmod("sub", F.lit(parts))
    ranked = running_sum(placed.withColumn("bucket", bucket.cast("long")), ["shard"], "bucket", [F.col("gid"), F.col("h"), F.col("doc_id")], F.col("copies"), "upto")
    ranked = each_copy(ranked, narrow, ["gid", "h"]).withColumn("rank", F.col("upto") - F.col("copies") + F.col("copy"))

    held = loads(cells, "shard", F.col("rows"), shards)
    stay = [min(n, q) for n, q in zip(held, quotas, strict=True)]
    over = [n - s for n, s in zip(held, stay, strict=True)]
    starts = [sum(over[:s]) for s in range(shards + 1)]  # of each shard's surplus, then of the documents without links
    filled = [sum(q - k for q, k in zip(quotas[:s], stay[:s], strict=True)) for s in range(shards + 1)]
    rank = F.col("rank") - 1
    stays = rank < at([*stay, 0], F.col("shard"))
    order = at(starts, F.col("shard")) + rank - at([*stay, 0], F.col("shard"))
    target = sum(((order >= F.lit(f)).cast("int") for f in filled[1:shards]), F.lit(0))
    final = ranked.withColumn("stays", stays).withColumn("order", order).withColumn("to", F.when(F.col("stays"), F.col("shard")).otherwise(target))
    slot = F.when(F.col("stays"), rank).otherwise(at(stay, F.col("to")) + F.col("order") - at(filled, F.col("to")))
    return final.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("gid").alias("group_id"), F.floor(F.col("sub") / parts).cast("int").alias("first_shard"),
    )


def link_counts(sharded: DataFrame) -> DataFrame:
    """One row about the result of ``shards_of``: how many links there are
    (pairs of documents of equal text), and how many were, and are, between
    documents of different shards. Null ids count like others, rows that repeat
    are linked, and an empty table has no links."""

    def within(shard: str) -> DataFrame:
        cells = sharded.groupBy("group_id", shard).agg(F.count("*").cast("decimal(38,0)").alias("n"))
        return cells.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("decimal(38,0)").alias("n"))

    groups = sharded.groupBy("group_id").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    links = groups.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("decimal(38,0)").alias("links"))
    first, last = within("first_shard").withColumnRenamed("n", "first"), within("shard").withColumnRenamed("n", "last")
    return links.join(first).join(last).select("links", (F.col("links") - F.col("first")).alias("cut_at_first"), (F.col("links") - F.col("last")).alias("cut"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_of(table(spark, sf_dir, "documents")).drop("first_shard")


QUERIES = {"op5_sharding": op5_sharding}
ORACLE_SQL: dict[str, str] = {}
