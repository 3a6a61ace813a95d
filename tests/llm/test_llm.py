"""The operators on small tables with awkward rows, against plain rewrites."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from photoflow.llm import exact_dedup, mixing, pieces, pii, piece_coding, quality, sharding, simhash, token_counts, topk, toxicity

TEXTS = [
    None, "", " ", "\n\t", "word", "two words", "The same text here", "The same text here", "THE SAME TEXT HERE", "héllo wörld ☃ 日本語 😀",
    "</s> <s> <unk> [INST]", "a" * 3000, "ab " * 4000, "mail a.b@c.example.org or +1 (900) 555-2077, 10.0.0.1; 4111 1111 1111 1111", "x  y   z q", "é é",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", [None, "a", "b", "é"][i % 4], 0, "extra") for i, t in enumerate(TEXTS * 3)] + [(0, None, "en", "a", 0, "extra"), (12, "word", None, "b", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def machine():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_token_counts_and_prefixes(docs, empty):
    sp, path = machine(), pieces.default_model()
    found = token_counts.token_counts(docs, path, limit=50)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in found.collect():
        assert r.n_tokens in [len(sp.encode(t)) for t in texts[r.doc_id]]
        assert r.over_limit == (r.n_tokens > 50)
    steps = token_counts.Counter(pieces.Pieces(open(path, "rb").read()))
    text = "The same, text here ☃ and 3.14 more wörds"
    counts = token_counts.counts_at(steps.of_text(text))
    assert counts.tolist() == [len(sp.encode(text[: i + 1])) for i in range(len(text))]
    assert token_counts.longest_prefixes(found, 3).count() == docs.count()
    assert token_counts.token_counts(empty, path).count() == 0


def test_sentencepiece_round_trip(docs, empty):
    sp, path = machine(), pieces.default_model()
    wanted = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in docs.collect())
    found = piece_coding.round_trip(docs, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == wanted and all(r.round_trip for r in found)
    both = piece_coding.decode(piece_coding.encode(docs, path), path)
    assert Counter((r.doc_id, r.decoded) for r in both.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert piece_coding.round_trip(empty, path).count() == 0


def brute_top(vectors, k):
    whole = [(i, np.floor(256 * np.array(x, dtype=float)).astype(int)) for i, x in vectors if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    rows = []
    for at, (q, v) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for other, (c, w) in enumerate(whole) if other != at)[:k]
            rows += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return sorted(rows)


@pytest.mark.parametrize(("parts", "tile", "gathered"), [(1, 8192, 128), (2, 8192, 1), (2, 50, 128), (4, 90, 1)])
def test_top_k(spark, monkeypatch, parts, tile, gathered):
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "GATHERED", gathered)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(60)]
    rows += [(400, None), (450, [1.0] * 7 + [float("nan")]), (500, [None] + [1.0] * 7), (550, [float("inf")] + [1.0] * 7)]
    # rows that repeat a vec_id: with the same vector, another one, and one of zeros, all of whose scores are ties
    rows += [(50, rows[50][1]), (100, [9.0] * 8), (100, [9.0] * 8), (7, rows[8][1]), (600, [0.0] * 8), (650, [-1.0] * 8), (650, [0.0] * 8), (300, [0.5] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, node string, score int")
    rows = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, parts)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 5)


def test_top_k_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (50, [])], "vec_id long, embedding array<double>")
    found = topk.top_k(few, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 1, 65536), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(r.repeats <= 2 for r in rows)
    total = sum(r["size"] for r in rows)
    taken, largest = defaultdict(int), max(r["size"] for r in rows)
    for r in rows:
        taken[r.source, r.target] += r["size"] * r.repeats
    assert all(abs(n - target) <= largest for (_, target), n in taken.items())
    assert sum(t for _, t in taken) == pytest.approx(1.5 * total)
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mixed(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shards_of(docs, shards=4).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    assert sharding.shards_of(empty).count() == 0


def test_quality_and_toxicity(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = "ab cd efg hij klm nop qrst uvw xyz".split()
    rows = [(i, ("VILE " if i % 3 == 0 else "") + " ".join(rng.choice(words, 30)) + ("!!" * 40 if i % 2 else ".")) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = texts.select("doc_id", F.when(F.col("text").endswith("!"), 0).otherwise(1).alias("quality"), F.col("text").startswith("VILE").cast("int").alias("toxic"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5000, 1, None)], labels.schema))
    for found, name in ((quality.quality(texts, labels), "quality"), (toxicity.toxicity(texts, labels), "toxic")):
        judged = found.join(labels, "doc_id").where("held_out")
        assert judged.count() > 50 and judged.where(f"predicted != {name}").count() == 0
    assert quality.quality(docs, labels).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.quality(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality(empty, labels).count() == 0 and toxicity.toxicity(empty, labels).count() == 0


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = docs.collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    root = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    least = {x: min(prints[i][0] for i in range(len(root)) if root[i] == x) for x in root}
    wanted = Counter((d, f"{p:016x}", least[root[i]]) for i, (d, p) in enumerate(prints))
    found = simhash.near_dedup(docs).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0"), "component_id").collect()
    assert Counter(map(tuple, found)) == wanted
    assert simhash.near_dedup(empty).count() == 0


def test_near_copies_of_several_words(spark):
    rng = np.random.default_rng(5)
    base = [f"w{n}" for n in rng.integers(0, 10**6, 300)]
    near = [*base[:150], "other", *base[151:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"v{n}" for n in rng.integers(0, 10**6, 300))), (4, " ".join(base[:60] + [f"u{n}" for n in range(240)]))]
    kept = simhash.kept_rows(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, lanes=4, radius=44)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def plain_spans(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(docs, empty):
    rng = np.random.default_rng(2)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "@", ".", "1", "255", "+", "-", " ", "(", "4111", "b.c", "\n", "é"], rng.integers(1, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    rows = pii.personal_data(docs).collect()
    sha = lambda t: hashlib.sha256(pii.joined(plain_spans(t or "")).encode()).hexdigest()
    assert Counter((r.doc_id, r.base_sha256) for r in rows) == Counter((r.doc_id, sha(r.text)) for r in docs.collect())
    assert any("[EMAIL]" in r.redacted and "[PHONE]" in r.redacted and "[IP]" in r.redacted and "[CARD]" in r.redacted for r in rows)
    added = pii.all_spans(["call (212) 555-0199", "in 2019-2021 and 1.2.3"], *pii.trained())
    assert [pii.joined(every) for _, every in added] == ["phone:5:19", ""]
    assert pii.personal_data(empty).count() == 0


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    wanted = Counter((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    found = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, found)) == wanted
    data = bytes(range(256)) * 9
    left, right = data[:700], data[700:]
    assert exact_dedup.combine(exact_dedup.fingerprint(left), exact_dedup.fingerprint(right), len(right)) == exact_dedup.fingerprint(data)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    raw = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.where("not round_trip").count() == 0
    assert found.select("doc_id", "text").exceptAll(raw.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).crossJoin(spark.range(2)).drop("id")).count() == 0
    assert len(corpus_pipeline.STAGES) == 5
