"""The pipeline's stages on awkward tables, and the whole of it against a plain rewrite."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from photoflow.llm import base, exact_dedup, mixing, pieces, sharding, toxicity

from .test_near_copies import plain_components

DATA = "/root/testdata/sf0.001"
#: Names that a stage could use for itself, and names that need quoting.
CLASHING = [
    "id", "mark", "origin", "number", "row", "tag", "kept", "place", "copy", "copies", "repeats", "time", "count", "size", "h", "n", "set", "root", "id__", "tag__", "sha__", "text__", "time__",
    "repeats__", "n_tokens", "ids", "decoded", "round_trip", "text_crc32", "score", "c0", "key 0", "component_id", "keep_id", "doc_id_key", "a.b", "c`d", "e f",
]
LONG = " ".join(f"w{i * i % 977}" for i in range(60_000))
TEXTS = [None, "", " \n", "one", "two words", "Same text of seven words in all", "Same text of seven words in all", LONG, LONG + " end"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = []
    for i, text in enumerate(TEXTS * 2):
        rows += [(None if i == 4 else i, text, [None, "a", "b"][i % 3], *[f"{c}-{i}" for c in CLASHING])] * (3 if i in (2, 6, 7) else 1)
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()), *[StructField(c, StringType()) for c in CLASHING]])
    return spark.createDataFrame(rows, schema).cache()


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("place", range(4))
def test_columns_rows_and_empty_tables(spark, awkward, place):
    name, stage = corpus_pipeline.STAGES[place]
    found = stage(spark, awkward, DATA)
    assert found.schema == awkward.schema
    rows, raw = plain(found), Counter(plain(awkward))
    assert set(rows) <= set(raw)
    if name == "toxicity":
        assert Counter(rows) == raw
    if name == "exact_dedup":
        texts = {r[1] or "" for r in raw}
        assert len(rows) == len(texts) == len({r[1] or "" for r in rows})
        assert all(r[0] == max(q[0] for q in raw if q[0] is not None and (q[1] or "") == (r[1] or "")) for r in rows)
    if name == "simhash_near_dedup":
        assert Counter((r[1] or "").strip()[-3:] for r in rows) == Counter(["", "one", "rds", "all", LONG[-3:]])
    assert stage(spark, awkward.limit(0), DATA).count() == 0


def test_last_stage_keeps_columns_beside_its_own(spark, awkward):
    found = corpus_pipeline.coded(spark, awkward, DATA)
    keys = [c for c in awkward.columns if c != "text"]
    assert found.columns == [*keys, "n_tokens_", "ids_", "text", "round_trip_"]
    assert Counter((*[r[i] for i in range(len(keys))], r["text"], r["round_trip_"]) for r in found.collect()) == Counter((*[r[c] for c in keys], r["text"] or "", True) for r in awkward.collect())
    assert corpus_pipeline.coded(spark, awkward.limit(0), DATA).count() == 0


def plain_mix(rows, weights=(5, 2, 1), budget=1.5, rounds=2):
    """How often each row (doc_id, source, text) is taken, and each source's target."""
    size = [len((t or "").split()) for _, _, t in rows]
    by_source = defaultdict(int)
    for (_, s, _), n in zip(rows, size, strict=True):
        by_source[s] += n
    ranked = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(ranked)}
    target, free, left = {}, set(ranked), budget * sum(size)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = [s for s in free if level * weight[s] > rounds * by_source[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(rounds * by_source[s])
            free.discard(s)
            left -= target[s]
    order = []
    for i, (d, s, t) in enumerate(rows):
        tag = hashlib.md5((t or "").encode()).hexdigest()
        order.append((s is None, s or "", int(hashlib.md5(f"{'' if d is None else d}:{tag}".encode()).hexdigest()[:13], 16), -1 if d is None else d, tag, i))
    upto, entries = defaultdict(int), []
    for *_, h, d, tag, i in sorted(order):
        s = rows[i][1]
        upto[s] += size[i]
        if size[i]:
            entries += [((upto[s] + by_source[s] * r) / target[s], ranked.index(s), r, h, d, tag, i) for r in range(rounds)]
    taken, run = Counter(), 0
    for *_, i in sorted(entries):
        run += size[i]
        if run > sum(target.values()):
            break
        taken[i] += 1
    return taken, target, by_source


def test_mix_of_repeated_rows(spark):
    rows = [(i % 7 or None, "abc"[i % 3] if i % 5 else None, " ".join(["w"] * (i % 11))) for i in range(300)] + [(500, "a", "x y z")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, target, _ = plain_mix(rows)
    found = mixing.mixed_rows(docs)
    wanted = Counter()
    for i, n in taken.items():
        wanted[rows[i]] += n
    assert Counter(map(tuple, found.collect())) == wanted
    assert {r.source: pytest.approx(r.target) for r in mixing.mixed(docs).select("source", "target").distinct().collect()} == target
    text_ids = mixing.mixed_rows(docs.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce("doc_id", F.lit(0)))))
    assert text_ids.count() > 0


def test_pipeline_against_a_plain_rewrite(spark):
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held_out = toxicity.fold(F.col("doc_id"), 5) == 0
    scorer = toxicity.Scorer(toxicity.train(raw, labels, held_out))
    rows = [(r.doc_id, r.source, r.text) for r in raw.collect()]
    rows = [r for r in rows if scorer.score((r[2] or "").encode()) < 0.5]
    largest = {}
    for d, _, t in rows:
        largest[t or ""] = max(d, largest.get(t or "", d))
    rows = [r for r in rows if largest[r[2] or ""] == r[0]]
    least = plain_components([(d, t) for d, _, t in rows])
    rows = [r for r in rows if least[r[0]] == r[0]]
    taken, _, _ = plain_mix(rows)
    wanted = Counter({(rows[i][0], rows[i][2] or ""): n for i, n in taken.items()})
    mark = base.written()
    found = corpus_pipeline.run(spark, DATA)
    assert base.written() == mark
    assert Counter((r.doc_id, r.text) for r in found.collect()) == wanted
    assert found.where("not round_trip").count() == 0
    encoder = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model())
    assert all(list(r.ids) == encoder.encode(r.text) for r in found.select("ids", "text").limit(40).collect())
    assert len(corpus_pipeline.STAGES) == 5


def test_hot_keys_join_alike(spark, monkeypatch):
    monkeypatch.setattr(base, "ROWS_PER_BUCKET", 5)
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id % 97) AS k", "id")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    found = base.join_hot(rows, values, ["k"], "n", 1000)
    assert Counter(plain(found.select("k", "id", "m"))) == Counter(plain(rows.join(values.drop("n"), "k").select("k", "id", "m")))


def test_parts_of_huge_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HUGE", 50_000)
    monkeypatch.setattr(exact_dedup, "BLOCK", 7_000)
    other = LONG[:150_000] + "#" + LONG[150_001:]
    rows = [(1, LONG), (2, LONG), (3, other), (4, "x"), (5, None), (6, "é" * 40_000), (7, "é" * 40_000), (7, "é" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.n_bytes, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True), (6, 7, 3, False), (7, 7, 3, True)}
    texts = dict(rows)
    assert found == {(d, k, n, kept, len((texts[d] or "").encode()), sha(texts[d])) for d, k, n, kept in wanted}
    assert sorted(r.doc_id for r in exact_dedup.kept_rows(docs).collect()) == [2, 3, 4, 5, 7]
    made = {r.n_bytes: (r.fp_a, r.fp_b) for r in exact_dedup.described(docs.where("doc_id in (2, 6)")).collect()}
    assert made == {len(t.encode()): exact_dedup.fingerprint(t.encode()) for t in (LONG, "é" * 40_000)}


def test_fingerprint_of_a_long_text_in_little_memory():
    import tracemalloc

    data = bytes(range(256)) * (50 << 12)  # 50 MB
    tracemalloc.start()
    exact_dedup.fingerprint(data)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert exact_dedup.fingerprint(data[: 3 << 20]) == exact_dedup.combine(exact_dedup.fingerprint(data[:1000]), exact_dedup.fingerprint(data[1000 : 3 << 20]), (3 << 20) - 1000)


def test_crc_folds_are_those_of_the_text(spark):
    ids = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in ids.select("doc_id", toxicity.fold(F.col("doc_id"), 5).alias("f")).collect())


def test_many_copies_are_dealt_over_tasks(spark):
    rows = spark.createDataFrame([("a", 25_001), ("b", 1), ("c", 5_000)], "skey string, copies long")
    found = base.each_copy(rows, rows, ["skey"], part=5_000)
    got = found.groupBy("skey").agg(F.count("*").alias("n"), F.sum("copy").alias("s"), F.min("copy").alias("a"), F.max("copy").alias("b")).collect()
    assert {r.skey: (r.n, r.s, r.a, r.b) for r in got} == {k: (n, n * (n + 1) // 2, 1, n) for k, n in (("a", 25_001), ("b", 1), ("c", 5_000))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    same = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("s").alias("source"))
    for made in (mixing.mixed(same), sharding.shards_of(same)):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 60_000 and len(sizes) > 2 and max(sizes) <= 40_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_row_stands_for_a_labelled_id(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 7}") for i in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 20)
    assert sample.count() == 20 and sample.select("doc_id").distinct().count() == 20
    again = toxicity.labelled_sample(docs.repartition(9), labels, "toxic", F.lit(True), 20)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.collect()))
