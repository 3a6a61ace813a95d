"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to a
number of rounds.  A document's virtual finish time is the number of its
source's words up to and with it, divided by the source's target.  All entries
are put in the order of their finish times, over ranges of equal width, and
the order is cut where the total budget is used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD_PATTERN, buckets_for, each_copy, fraction_bucket, hash52, packed, running_sum, staged, table, unpacked

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
ROUNDS = 2


def targets(sources: DataFrame, weights: tuple[int, ...], budget: float, rounds: int) -> DataFrame:
    """``sources`` (skey, source_size) with rank and target.

    Water level: sources in the order of cap / weight, where the cap is
    ``rounds`` times the size; the level is the largest share per unit of
    weight that leaves its own source under the cap. One row per source.
    """
    by_key = Window.orderBy("skey")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("rank", F.row_number().over(by_key)).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", (F.col("source_size") * rounds).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "rank")
    capped = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(budget)
    levels = ranked.withColumn("level", (total - capped) / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(Window.partitionBy())
    target = F.when(level < F.col("fill"), level * F.col("weight")).otherwise(F.col("cap"))
    return levels.select("skey", "source_size", "rank", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, source, tag (the MD5 of the text), copy,
    copies, size, source_size, target and repeats, the times the mix takes it.

    Size is the number of words, 0 for a null text. Sources are ranked by code
    point, null last, and weigh ``weights`` in turn. Together they share
    ``budget`` times all words; a source gets ``rounds`` times its words at
    most, and what it cannot use is shared by the others. Documents without
    words are taken 0 times. Rows that repeat source, doc_id and text are
    documents of their own, told apart by ``copy``, 1 to ``copies``. An empty table
    gives no rows; other columns are not looked at, and doc_id may have any
    type that can be ordered.

    The order of a queue is a hash of doc_id and text. The running sums have
    two levels (``running_sum``), so a source with any share of the rows is
    spread over all tasks, and rows that repeat are one entry with a count; the
    cut is found from sums over ranges of finish time and one range's rows.
    Only the cut itself, one row, reaches the driver.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    tag = F.md5(text.cast("binary"))
    h = hash52(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("tag")))
    narrow = docs.select("doc_id", "source", skey.alias("skey"), tag.alias("tag"), size.alias("size")).withColumn("h", h)
    narrow = staged(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")))
    rows = narrow.agg(F.sum("copies")).first()[0] or 0
    buckets = buckets_for(rows)
    narrow = narrow.withColumn("bucket", fraction_bucket("h", buckets))
    words = F.col("size") * F.col("copies")
    # source figures go to every (source, bucket), which no document group exceeds
    per_bucket = narrow.groupBy("skey", "bucket").agg(F.sum(words).alias("bucket_size"))
    sources = staged(targets(per_bucket.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, budget, rounds))
    cells = per_bucket.select("skey", "bucket").join(sources, "skey")
    queued = running_sum(narrow, ["skey"], "bucket", [F.col("h"), F.col("doc_id"), F.col("tag")], words, "upto").join(cells, ["skey", "bucket"])
    queued = each_copy(queued, narrow, ["skey", "h"])
    queued = queued.withColumn("upto", F.col("upto") - F.col("size") * (F.col("copies") - F.col("copy")))
    finish = [F.when(F.col("size") > 0, (F.col("upto") + F.col("source_size") * r) / F.col("target")) for r in range(rounds)]
    queued = staged(queued.select("doc_id", "source", "tag", "copy", "copies", "h", "size", "source_size", "target", "rank", F.array(*finish).alias("finish")))

    order = ["at", "rank", "round", "h", "doc_id", "tag", "copy"]
    entries = queued.select("rank", "h", "doc_id", "tag", "copy", "size", F.posexplode("finish").alias("round", "at")).where("at is not null")
    entries = entries.withColumn("slot", F.floor(F.col("at") * buckets))
    words = staged(entries.groupBy("slot").agg(F.sum("size").alias("words")))
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    ahead = words.withColumn("upto", F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    edge = ahead.where(F.col("upto") > total).orderBy("slot").limit(1).first()
    if edge is None:
        taken = [f.isNotNull() for f in finish_columns(rounds)]
    else:
        in_edge = entries.where(F.col("slot") == edge["slot"])
        run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + (edge["upto"] - edge["words"])
        last = in_edge.withColumn("run", run).where(F.col("run") <= total).orderBy(*[F.col(c).desc() for c in order]).limit(1).first()
        taken = []
        for r, at in enumerate(finish_columns(rounds)):
            early = F.floor(at * buckets) < edge["slot"]
            if last is not None:
                here = {"at": at, "round": F.lit(r)}
                key = F.struct(*[here.get(c, F.col(c)).alias(c) for c in order])
                kinds = {f.name: f.dataType for f in in_edge.schema.fields}
                cut = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in order])
                early = early | ((F.floor(at * buckets) == edge["slot"]) & (key <= cut))
            taken.append(F.coalesce(early, F.lit(False)))
    repeats = sum((t.cast("int") for t in taken), F.lit(0))
    return queued.select("doc_id", "source", "tag", "copy", "copies", "size", "source_size", "target", repeats.alias("repeats"))


def finish_columns(rounds: int) -> list:
    return [F.col("finish")[r] for r in range(rounds)]


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; all columns
    stay, whatever their names.

    Rows that repeat source, doc_id and text are counted off: each takes the
    place of one copy, so that the mix keeps to its target. Null and empty texts,
    and those of white space, are not in the mix; a text of any length is in it
    whole or not at all. An empty table stays empty.
    """
    taken = mixed(docs, **how).select(F.col("doc_id").alias("id"), F.col("source").alias("origin"), F.col("tag").alias("mark"), F.col("copy").alias("number"), "copies", "repeats")
    taken = staged(taken.where("repeats > 0 or copies > 1"))
    tag = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), tag=tag)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("origin")) & (F.col("tag") == F.col("mark"))
    times = F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("time")
    once = rows.join(taken.where("copies = 1"), same).select("row", times)
    repeated = taken.where("copies > 1 and number = 1").select("id", "origin", "mark")
    if repeated.isEmpty():
        return unpacked(once)
    # copies are counted off over the partitions that hold them, so that they never all meet
    placed = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), tag=tag, place=F.spark_partition_id())
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"{c}_key") for c in ("doc_id", "source")]
    again = staged(placed.join(repeated, same, "left_semi").select("*", *keys))
    again = running_sum(again, ["doc_id_key", "source_key", "tag"], "place", [F.sha2(F.to_json("row"), 256)], F.lit(1), "count")
    again = again.join(taken.where("copies > 1 and repeats > 0"), same & (F.col("count") == F.col("number"))).select("row", times)
    return unpacked(once.unionByName(again))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("repeats")).alias("taken"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {
    "op3_mixing": r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(coalesce(text, '')) AS tag,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h
      FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
    w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                 (source_size * 2)::DOUBLE AS cap FROM r),
    f AS (SELECT *, cap / weight AS fill, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total FROM w),
    l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
    v AS (SELECT max(level) AS water FROM l WHERE level <= fill),
    t AS (SELECT source, source_size, rank, CASE WHEN water < fill THEN water * weight ELSE cap END AS target FROM l, v),
    q AS (SELECT d.*, t.source_size, t.rank, t.target,
                 sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, tag ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT doc_id, h, rank, size, round, (upto + source_size * round)::DOUBLE / target AS finish
          FROM q, (VALUES (0), (1)) AS rounds(round) WHERE size > 0),
    c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank, round, h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
    k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE run <= (SELECT sum(target) FROM t) GROUP BY doc_id)
    SELECT q.doc_id, q.size, q.source_size, round(q.target, 6) AS target, coalesce(k.taken, 0)::BIGINT AS taken
    FROM q LEFT JOIN k USING (doc_id)"""
}
