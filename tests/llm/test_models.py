"""Classifiers scored again in plain Python, other kinds of SentencePiece models,
shards against SQL-like rewrites, and long inputs."""

import random
import time
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from photoflow.llm import piece_coding, pieces, pii, quality, sharding, simhash, token_counts, toxicity

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    return docs.join(labels.select("doc_id"), "doc_id").cache(), labels.cache()


def check(found, labels, name, parts, held, scores):
    """Folds, ranges and plain scores of each row; returns held-out (label, predicted) pairs."""
    truth = {r.doc_id: r[name] for r in labels.collect()}
    pairs = []
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
        assert r.score == pytest.approx(scores[r.doc_id], abs=1e-9) and 0 <= r.score <= 1
        if r.held_out and truth[r.doc_id] is not None:
            pairs.append((truth[r.doc_id], r.predicted))
    return Counter(pairs)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_quality_again_in_plain_python(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels, toxicity.fold(F.col("doc_id"), 4) == 2)
    scores = {}
    for r in docs.collect():
        x = quality.features((r.text or "").encode())
        bins = [bisect_right(list(c), v) for c, v in zip(model.cuts, x, strict=True)]
        margin = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        margin += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        scores[r.doc_id] = sigmoid(margin)
    found = check(quality.quality(docs, labels), labels, "quality", 4, 2, scores)
    assert (found[0, 0] + found[1, 1]) / sum(found.values()) > 0.95


def test_toxicity_again_in_plain_python(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, toxicity.fold(F.col("doc_id"), 5) == 0)
    assert len(model.weights) > 600
    scores = {}
    for r in docs.collect():
        text = (r.text or "").lower()
        padded = {f"<{w}>" for w in "".join(c if c.isalpha() else " " for c in text).split()}
        grams = {w[i : i + n] for w in padded for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)}
        scores[r.doc_id] = sigmoid(model.bias + sum(model.weights.get(g, 0.0) for g in grams))
    found = check(toxicity.toxicity(docs, labels), labels, "toxic", 5, 0, scores)
    assert found[1, 1] / (found[1, 1] + found[1, 0]) >= 0.9 and found[0, 1] <= 0.01 * (found[0, 0] + found[0, 1])


def test_ties_and_repeated_rows_of_classifiers(spark):
    rows = [(i % 40, "vile " * (i % 2) + "words here", "x") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    for found in (quality.quality(docs, labels), toxicity.toxicity(docs, labels)):
        rows = [(r.doc_id, r.score) for r in found.collect()]
        assert len(rows) == 160 and len(set(rows)) == 40


def changed(**how):
    spec = proto.ModelProto()
    spec.ParseFromString(open(pieces.default_model(), "rb").read())
    for part, values in how.items():
        for k, v in values.items():
            setattr(getattr(spec, part), k, v)
    return spec


def charsmap(rule):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = proto.ModelProto()
    spec.ParseFromString(normaliser.serialized_model_proto())
    return spec.normalizer_spec.precompiled_charsmap


def with_user_pieces(spec, *texts):
    for text in texts:
        spec.pieces.add(piece=text, score=0.0, type=proto.ModelProto.SentencePiece.USER_DEFINED)
    return spec


def unigram(bytes_too):
    spec = proto.ModelProto()
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    spec.trainer_spec.byte_fallback = bytes_too
    spec.normalizer_spec.remove_extra_whitespaces = False
    kind = proto.ModelProto.SentencePiece
    spec.pieces.add(piece="<unk>", score=0.0, type=kind.UNKNOWN)
    spec.pieces.add(piece="<s>", score=0.0, type=kind.CONTROL)
    for b in range(256) if bytes_too else ():
        spec.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=kind.BYTE)
    rng = random.Random(3)
    words = {"▁", *"abcdehlort", *("".join(rng.choice("▁abcdehlort") for _ in range(rng.randrange(2, 5))) for _ in range(300))}
    for word in sorted(words):
        spec.pieces.add(piece=word, score=-round(rng.uniform(1, 9), 3), type=kind.NORMAL)
    return spec


MODELS = {
    "nfkc": lambda: changed(normalizer_spec={"precompiled_charsmap": charsmap("nfkc"), "remove_extra_whitespaces": True}),
    "nmt_nfkc_cf": lambda: changed(normalizer_spec={"precompiled_charsmap": charsmap("nmt_nfkc_cf")}),
    "no space in front": lambda: changed(normalizer_spec={"add_dummy_prefix": False}),
    "user-defined": lambda: with_user_pieces(changed(), "abct", "<sep>", "qzthe", "henabc"),
    "unigram": lambda: unigram(True),
    "unigram without bytes": lambda: unigram(False),
    "unigram with user-defined": lambda: with_user_pieces(unigram(True), "hell", "<sep>"),
}


@pytest.mark.parametrize("name", MODELS)
def test_other_models_as_the_library_reads_them(name):
    data = MODELS[name]().SerializeToString()
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=data), piece_coding.Transducer(pieces.Pieces(data))
    rng = random.Random(5)
    texts = ["", " ", "  two  spaces ", "ﬁne ﬀ Ａｂｃ ½ ㌀ é  x", "abcthen<sep>theabc", "hello world", "日本語 ☃☃ 😀", "tab\tand\nline", "ÀÉ", "x" * 300, "the​then"]
    texts += ["".join(rng.choice(" abcdehlort☃é<sep>\n") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    packed = [machine.encode(t) for t in texts]
    wanted = [library.encode(t) for t in texts]
    assert [np.frombuffer(p, dtype="<i4").tolist() for p in packed] == wanted
    offsets = np.cumsum([0, *(len(w) for w in wanted)])
    decoded = machine.decode(np.concatenate([np.array(w, dtype=np.int64) for w in wanted]), offsets)
    assert [d.decode("utf-8", "replace") for d in decoded] == library.decode(wanted)


def test_counts_need_a_plain_model():
    with pytest.raises(ValueError):
        token_counts.Counter(pieces.Pieces(MODELS["nfkc"]().SerializeToString()))


def test_tables_stay_within_their_bytes():
    held = pieces.Bounded(lambda k: k * 2, most=10_000)
    for i in range(1000):
        assert held[f"key {i % 300}"] == f"key {i % 300}" * 2
    assert sum(pieces.ENTRY_BYTES + 3 * len(k) for t in (held, held.older) for k in t) <= 20_500
    assert held["k" * 5000] == "k" * 10_000 and "k" * 5000 not in held


def test_shards_against_a_plain_rewrite(spark):
    rng = np.random.default_rng(4)
    texts = [None, ""] + [f"text {n} é" for n in rng.integers(0, 400, 900)] + ["huge group"] * 400 + ["other group"] * 60
    rows = [(None if i == 5 else i, t, "x") for i, t in enumerate(texts)] + [(2000, "huge group", "y")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    placed = sharding.shards_of(docs, shards=8)
    found = placed.collect()
    known = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == known
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    slots, groups, first = defaultdict(list), defaultdict(Counter), defaultdict(Counter)
    for r in found:
        slots[r.shard].append(r.slot)
        groups[r.group_id][r.shard] += 1
        first[r.group_id][r.first_shard] += 1
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    quota = len(rows) // 8
    small = [g for g in groups.values() if sum(g.values()) <= quota // 10]
    assert len(small) > 300 and sum(len(g) == 1 for g in small) >= 0.8 * len(small)
    pairs = lambda c: sum(n * (n - 1) // 2 for n in c.values())
    report = sharding.link_counts(placed).first()
    links = sum(sum(g.values()) * (sum(g.values()) - 1) // 2 for g in groups.values())
    assert (int(report.links), int(report.cut_at_first), int(report.cut)) == (links, links - sum(map(pairs, first.values())), links - sum(map(pairs, groups.values())))
    assert report.cut < report.cut_at_first
    assert sharding.link_counts(sharding.shards_of(docs.limit(0))).first().links == 0


def test_many_spans_in_one_text():
    text = " ".join(f"call (212) 555-{i % 10_000:04d} or a{i} [at] host [dot] com" for i in range(25_000))
    began = time.perf_counter()
    (_, every), = pii.all_spans([text], *pii.trained())
    assert time.perf_counter() - began < 120 and len(every) >= 25_000
    rng, spans = random.Random(1), []
    for _ in range(400):
        start = rng.randrange(1000)
        spans.append((rng.choice([0.5, 0.6, 0.7, rng.random()]), (start, rng.randrange(4), start + rng.randrange(1, 12))))
    plain = []
    for _, s in sorted(spans, key=lambda e: (-e[0], e[1])):
        if all(s[2] <= t[0] or t[2] <= s[0] for t in plain):
            plain.append(s)
    assert sorted(pii.chosen(spans)) == sorted(plain)
    began = time.perf_counter()
    pii.chosen([(random.Random(i).random(), (i * 7 % 999_983, 1, i * 7 % 999_983 + 9)) for i in range(100_000)])
    assert time.perf_counter() - began < 20


def test_long_texts_of_one_word():
    assert simhash.majority(np.arange(100_000, dtype=np.uint64)) == simhash.majority(np.arange(100_000, dtype=np.uint64)[::-1].copy())
    machine, library = piece_coding.Transducer(pieces.Pieces(open(pieces.default_model(), "rb").read())), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    text = "".join(random.Random(2).choice("abcdefgh0123456789") for _ in range(200_000))
    assert np.frombuffer(machine.encode(text), dtype="<i4").tolist() == library.encode(text)
    assert len(machine.paths) == 0


def test_op7_keeps_more_paths_than_the_pipeline():
    with open(pieces.default_model(), "rb") as file:
        model = file.read()
    machine = piece_coding.transducer_of(model, piece_coding.ALONE_BYTES)
    assert machine.paths.most == machine.model.apart.most == piece_coding.ALONE_BYTES > piece_coding.transducer_of(model).paths.most
