"""Near-duplicates of the pipeline against all pairs compared plainly."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from photoflow.llm import near_copies


def plain_set(text, size=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


def plain_components(rows, similarity=0.8):
    """doc_id -> least doc_id of its group."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    return {rows[i][0]: least[root[i]] for i in range(len(rows))}


def words(rng, n, mark="w"):
    return [f"{mark}{k}" for k in rng.integers(0, 10**9, n)]


def near_texts():
    rng, texts = np.random.default_rng(8), []
    for n in (300, 60, 40):
        for changed in range(1, 13):  # each word takes five shingles with it
            base = words(rng, n)
            other = list(base)
            for k in range(changed):
                other[(2 * k + 1) * n // 26] = f"x{k}"
            texts += [base, other]
    for _ in range(20):  # 4 shingles of 5 are 0.8
        base = words(rng, 9)
        texts += [base, base[:8]]
    line = words(rng, 12)  # a repeated line is the same few shingles in unlike texts
    texts += [words(rng, 104) + line * 40, words(rng, 104) + line * 40]
    base = words(rng, 300)  # a chain: the neighbours are alike, the ends are not
    texts += [base[20 * k : 20 * k + 200] for k in range(5)]
    texts += [words(rng, n) for n in (1, 2, 5, 6, 6, 7, 8, 8)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, " \n"), (902, None), (903, "Two words"), (904, "two  WORDS")]


def test_groups_are_those_of_all_pairs(spark):
    rows = near_texts()
    wanted = plain_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    how = dict(shingle=5, lanes=4, radius=corpus_pipeline.RADIUS, similarity=0.8)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs, **how).collect()} == wanted
    kept = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter(r for r in rows if wanted[r[0]] == r[0])
    assert near_copies.near_copies(docs.limit(0), **how).count() == 0


@pytest.mark.parametrize("most", [3, 50])
def test_large_group_in_tiles(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "TILE_SETS", most)
    rng = np.random.default_rng(9)
    base = words(rng, 200)
    rows = []
    for i in range(40):
        other = list(base)
        for k in rng.choice(40, int(rng.integers(0, 8)), replace=False):
            other[5 * k] = f"y{i}-{k}"
        rows.append((i, " ".join(other)))
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, corpus_pipeline.RADIUS, 0.8)
    assert {r.doc_id: r.component_id for r in found.collect()} == plain_components(rows)


def test_tiles_of_a_group_add_few_links(spark, monkeypatch):
    """Links of a large group are about as many as its sets, not times its tiles."""
    monkeypatch.setattr(near_copies, "TILE_SETS", 20)
    counted = []
    run = near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda edges: counted.append(edges.count()) or run(edges))
    rng = np.random.default_rng(10)
    base = words(rng, 300)
    rows = [(i, " ".join([*base[: 1 + i % 290], f"z{i}", *base[2 + i % 290 :]])) for i in range(200)]
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, corpus_pipeline.RADIUS, 0.8)
    assert {r.component_id for r in found.collect()} == {0}
    assert counted[1] <= 200 + 15 * 15 and counted[0] < 1000


def test_sets_of_unlike_sizes_never_meet(spark, monkeypatch):
    """Fingerprints are compared where sizes allow the similarity: the pairs of sizes of 0.8 all, and few others."""
    sizes = [4, 5, 8, 10, 16, 20, 100, 125, 1000, 1250, 8000, 10000]
    rows = [(k, n, *map(int, np.random.default_rng(k).integers(-(2**62), 2**62, 4))) for k, n in enumerate(sizes)]
    equal = [(100 + k, n, 1, 2, 3, 4) for k, n in enumerate(sizes)]
    nodes = spark.createDataFrame(rows + equal, "node long, size int, f0 long, f1 long, f2 long, f3 long")
    found = {frozenset((r.u, r.v)) for r in near_copies.links(nodes, 4, 72, 4, 0.8).collect()}
    sized = dict(zip(range(100, 112), sizes))
    assert {frozenset((100 + k, 101 + k)) for k in range(0, 12, 2)} <= found
    assert all(min(sized[i] for i in e) / max(sized[i] for i in e) > 0.7 for e in found)


def test_tile_pairs_by_plain_loops():
    from photoflow.llm import simhash

    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, (150, 4)).astype(np.uint64)
    b = np.concatenate([a[:100] ^ (np.uint64(1) << rng.integers(0, 64, (100, 4)).astype(np.uint64)), ~a[100:], a[:9]])
    i, j = simhash.near_pairs(a, [np.ascontiguousarray(b[:, w]) for w in range(4)], 100)
    counts = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(p, q, strict=True)) for q in b] for p in a])
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(counts <= 100)), strict=True))
