"""URL filters: fixed rules, then association rules mined from labels.

The tokens of labelled URLs and their label are transactions.  Spark's
FP-growth finds the frequent combinations; those that imply the label often
enough, and more often than chance and than any part of them does, are rules.
Where a URL has so many frequent tokens that all its subsets are too many, the
same rules are found level by level from sets of which every part has more URLs.
An inverted index holds each rule under its rarest token, so a URL meets only
rules whose rarest token it has.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import staged, table

#: (verdict, host, start of the path): fixed values.
FIXED_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A rule's tokens occur together in so many labelled URLs at least, and in this part of them.
LEAST_URLS, LEAST_SUPPORT = 10, 0.001
#: So many of the URLs that have a rule's tokens must be bad, and so many
#: deviations more than the rate of all labelled URLs leads one to expect.
LEAST_CONFIDENCE, LEAST_DEVIATIONS = 0.5, 4.0
#: If a labelled URL has more frequent tokens than these, the rules are mined level by level.
MOST_SUBSETS_OF = 16
#: The item that says that a URL is bad; no token begins like this.
BAD = "=bad"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits, as text, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct words of the whole URL, each with the part it stands in, and the host."""

    def words(part: str, text: Column) -> Column:
        return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(f"{part}:"), w))

    lead = F.coalesce(F.regexp_extract(url, r"^(.*?)://", 1), F.lit(""))
    behind = F.coalesce(F.regexp_extract(url, r"^[^?#]*(.*)", 1), F.lit(""))
    site = F.when(host != "", F.array(F.concat(F.lit("site:"), host))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words("scheme", lead), site, words("host", host), words("path", path), words("behind", behind)))


def labelled_urls(pages: DataFrame, bad: DataFrame) -> DataFrame:
    """url, bad: each distinct URL with labelled pages once, bad if at least half of them are.

    ``bad``: page_id and bad, 0 or 1; the largest counts if a page has several.
    """
    label = bad.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.where("url is not null").select("page_id", "url").join(label, "page_id")
    return rows.groupBy("url").agg((F.avg("bad") >= 0.5).cast("int").alias("bad"))


def frequent_items(urls: DataFrame, least: int, total: int) -> DataFrame:
    """key, bad and held (structs n, token, the rarest first) of each labelled URL
    (key, bad, tokens): its frequent tokens, and how many URLs have each.

    Tokens that the very same URLs have are one item (the first of them), and
    those that all have are none, as neither tells URLs apart. URLs with equal
    coverage are recognised by a count and a sum of hashes.
    """
    each = staged(urls.select("key", F.explode("tokens").alias("token")))
    cover = F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)"))
    kept = each.groupBy("token").agg(F.count("*").alias("n"), cover.alias("cover")).where((F.col("n") >= least) & (F.col("n") < total))
    items = kept.groupBy("n", "cover").agg(F.min("token").alias("token")).select("token", "n")
    held = each.join(items, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    return urls.select("key", "bad").join(held, "key", "left")


def frequent_sets(held: DataFrame, least: float, total: int) -> DataFrame:
    """items, support and hits of the sets that FP-growth finds with BAD."""
    tokens = F.coalesce(F.col("held.token"), F.array().cast("array<string>"))
    rows = held.select(F.concat(tokens, F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    miner = FPGrowth(itemsCol="items", minSupport=max(1, least) / total, numPartitions=held.sparkSession.sparkContext.defaultParallelism)
    sets = staged(miner.fit(staged(rows)).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support")))
    hits = sets.where(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("items"), F.col("support").alias("hits")).where(F.size("items") > 0)
    return hits.join(sets, "items")


def minimal_sets(held: DataFrame, least: int, least_hits: float) -> DataFrame:
    """items, support and hits of the sets of tokens with so many URLs and bad ones
    at least, of which every part has more URLs and some that are not bad.

    No other set is a rule: a part with the same URLs, or with bad ones alone, is
    as sure. Parts of such sets are such sets, so each level grows from the one
    before: two sets of a URL that differ in their last token make a larger one.
    """
    levels: list[DataFrame] = []
    rows = staged(held.where("held is not null").select(F.monotonically_increasing_id().alias("id"), "bad", "held.token"))
    grown = rows.select("id", "bad", F.explode("token").alias("last")).select("id", "bad", F.array().cast("array<string>").alias("first"), "last")
    while True:
        items = F.concat("first", F.array("last"))
        found = grown.groupBy(items.alias("items")).agg(F.count("*").alias("support"), F.sum("bad").alias("hits")).where((F.col("support") >= least) & (F.col("hits") >= least_hits))
        if levels:
            size = len(levels) + 1
            drop = [F.concat(F.slice("items", 1, i), F.slice("items", i + 2, size)) for i in range(size)]
            parts = found.select("items", "support", F.explode(F.array(*drop)).alias("part"))
            known = levels[-1].where("hits < support").select(F.col("items").alias("part"), F.col("support").alias("wider"))
            whole = parts.join(known, "part").where("wider > support").groupBy("items").agg(F.count("*").alias("parts")).where(F.col("parts") == size)
            found = found.join(whole.select("items"), "items")
        levels.append(staged(found))
        if levels[-1].where("hits < support").isEmpty():
            break
        open_sets = levels[-1].where("hits < support").select("items")
        here = staged(grown.withColumn("items", items).join(open_sets, "items").select("id", "bad", "first", "last"))
        other = here.select("id", "first", F.col("last").alias("next"))
        grown = here.join(other, ["id", "first"]).where("last < next").select("id", "bad", F.concat("first", F.array("last")).alias("first"), F.col("next").alias("last"))
    return reduce(DataFrame.unionByName, levels)


def mined_rules(urls: DataFrame, least_urls: int = LEAST_URLS, least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """rule (tokens joined by ' & '), items, support, confidence and anchor (the
    rarest token) of the rules that labelled URLs (key, bad, tokens) give.

    A rule is left out if a part of it is a rule of the same confidence or
    more. Without bad URLs there is no rule.
    """
    spark, schema = urls.sparkSession, "rule string, items array<string>, support long, confidence double, anchor string"
    total, bad = urls.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(least_urls, -int(-least_support * total // 1))
    if not bad or total < least:
        return spark.createDataFrame([], schema)
    rate, least_hits = bad / total, least * least_confidence
    held = staged(frequent_items(urls, least, total))
    if held.where(F.size("held") > MOST_SUBSETS_OF).isEmpty():
        sets = frequent_sets(held, least_hits, total)
    else:
        sets = minimal_sets(held, least, least_hits)
    likely = F.lit(rate) * F.col("support") + LEAST_DEVIATIONS * F.sqrt(F.lit(rate * (1 - rate)) * F.col("support"))
    good = sets.where((F.col("support") >= least) & (F.col("hits") >= least_confidence * F.col("support")) & (F.col("hits") >= likely))
    good = staged(good.withColumn("items", F.array_sort("items")).select(F.array_join("items", " & ").alias("rule"), "items", "support", (F.col("hits") / F.col("support")).alias("confidence")))
    alone = held.select(F.explode("held").alias("e")).select(F.col("e.token").alias("item"), F.col("e.n").alias("n")).distinct()
    anchors = good.select("rule", F.explode("items").alias("item")).join(alone, "item").groupBy("rule").agg(F.min(F.struct("n", "item")).alias("rarest"))
    rules = staged(good.join(anchors.select("rule", F.col("rarest.item").alias("anchor")), "rule"))
    wider = matches(rules.select(F.col("rule").alias("key"), F.col("items").alias("tokens"), F.col("confidence").alias("own")), rules, "own")
    weak = wider.where((F.col("rule") != F.col("key")) & (F.col("confidence") >= F.col("own"))).select(F.col("key").alias("rule")).distinct()
    return staged(rules.join(weak, "rule", "left_anti"))


def matches(urls: DataFrame, rules: DataFrame, *carried: str) -> DataFrame:
    """(key, ``carried``, rule, support, confidence) of each rule whose tokens a URL (key, tokens) all has.

    Only tokens that rules name leave a URL, so that a very long one is small.
    """
    names = rules.select(F.explode("items").alias("token")).distinct()
    known = urls.select("key", *carried, F.explode("tokens").alias("token")).join(names, "token").groupBy("key", *carried).agg(F.collect_set("token").alias("known"))
    index = rules.withColumnRenamed("anchor", "token")
    met = known.withColumn("token", F.explode("known")).join(index, "token")
    return met.where(F.size(F.array_except("items", "known")) == 0).select("key", *carried, "rule", "support", "confidence")


def keyed(urls: DataFrame, *more: str) -> DataFrame:
    """key (SHA-256 of the url) and tokens, for each row of ``urls``."""
    host, path = url_parts(F.col("url"))
    return urls.select(F.sha2(F.col("url").cast("binary"), 256).alias("key"), *more, url_tokens(F.col("url"), host, path).alias("tokens"))


def judged(pages: DataFrame, bad: DataFrame, **how) -> DataFrame:
    """One row per page: page_id, host, path, rule (the longest fixed rule that
    fits, else null), verdict (allow or block), and mined_rule and confidence of
    the mined rule that blocks it, if no fixed one fits.

    ``bad``: page_id and bad (0 or 1, null unknown), what the rules are mined
    from. A page that neither kind of rule fits is allowed; of several mined
    rules the surest is named, of equal ones that with more URLs, then the first
    by text. A null url, and one without ``://``, has an empty host and path and
    only the tokens left. Rows that repeat are judged each; URLs of any length
    count whole; an empty table gives no rows; other columns are not looked at.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", F.sha2(F.col("url").cast("binary"), 256).alias("key"), "url", "host", "path", rule.alias("rule"), verdict.alias("fixed"))
    rules = mined_rules(staged(keyed(labelled_urls(pages, bad), "bad")), **how)
    if rules.isEmpty():
        hit = rows.select("*", F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"))
    else:
        left = keyed(rows.where("rule is null and url is not null").select("url").distinct())
        found = matches(left, rules).groupBy("key").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "rule")).alias("best"))
        found = found.select("key", F.col("best.rule").alias("mined"), (-F.col("best.c")).alias("sure"))
        free = F.col("rule").isNull()
        hit = rows.join(found, "key", "left").select(*rows.columns, F.when(free, F.col("mined")).alias("mined_rule"), F.when(free, F.col("sure")).alias("confidence"))
    verdict = F.coalesce("fixed", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return hit.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "confidence")


def bad_documents(labels: DataFrame) -> DataFrame:
    """page_id and bad of labelled documents: whether the quality is 0 or the text toxic.
    Pages and documents number the same crawl, so a page has its document's labels."""
    known = F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)) + F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))
    return labels.where("quality is not null or toxic is not null").select(F.col("doc_id").alias("page_id"), F.least(known, F.lit(1)).alias("bad"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), bad_documents(table(spark, sf_dir, "labels")))


QUERIES = {"op11_url_rules": op11_url_rules}
ORACLE_SQL: dict[str, str] = {}
