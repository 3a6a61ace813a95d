"""URL rules, whitening and the prefix trie against plain rewrites, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from photoflow.llm import prefix_trie, url_rules, whitening

DATA = "/root/testdata/sf0.01"
FIXED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_tokens(url):
    host, path = plain_parts(url)
    lead = url.split("://", 1)[0] if "://" in url else ""
    behind = re.search(r"[?#]", url)
    parts = {"scheme": lead, "host": host, "path": path, "behind": url[behind.start() :] if behind else ""}
    found = {f"{k}:{w}" for k, text in parts.items() for w in re.findall(r"[^\W_]+", text.lower())}
    return found | ({f"site:{host}"} if host else set())


def plain_mined(urls, least=10, share=0.001, confidence=0.5, deviations=4.0):
    """All subsets of each URL's kept tokens, counted one by one."""
    total, bad = len(urls), sum(b for _, b in urls)
    least = max(least, math.ceil(share * total))
    cover = defaultdict(set)
    for i, (url, _) in enumerate(urls):
        for t in plain_tokens(url):
            cover[t].add(i)
    classes = defaultdict(list)
    for t, held in cover.items():
        if least <= len(held) < total:
            classes[frozenset(held)].append(t)
    items = {min(ts): held for held, ts in classes.items()}
    support, hits = defaultdict(int), defaultdict(int)
    for i, (_, label) in enumerate(urls):
        own = sorted((len(held), t) for t, held in items.items() if i in held)[:16]
        for n in range(1, len(own) + 1):
            for c in combinations(sorted(t for _, t in own), n):
                support[c] += 1
                hits[c] += label
    rate = bad / total
    good = {c: hits[c] / n for c, n in support.items() if n >= least and hits[c] >= confidence * n and hits[c] >= rate * n + deviations * math.sqrt(rate * (1 - rate) * n)}
    return {c: x for c, x in good.items() if not any(set(d) < set(c) and y >= x for d, y in good.items())}


def url_pages():
    rng = random.Random(5)
    pages, bad = [], []
    for i in range(1200):
        words = [rng.choice(["blog", "www", "m"]), rng.choice(["cheap", "good", "old"]), rng.choice(["pills", "books"])]
        url = f"{rng.choice(['http', 'https'])}://{words[0]}.{words[1]}-{words[2]}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'fr', 'es'])}/{rng.randrange(1000)}{rng.choice(['', '?page=2&ref=x'])}"
        pages.append((i, url))
        if i % 3:
            spam = words[1:] == ["cheap", "pills"]
            bad.append((i, int(rng.random() < (0.9 if spam else 0.15))))
    return pages, bad


def test_mined_rules_are_those_of_counting_all_subsets(spark):
    pages, bad = url_pages()
    found = url_rules.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()
    label, by_url = dict(bad), defaultdict(list)
    for i, url in pages:
        if i in label:
            by_url[url].append(label[i])
    rules = plain_mined([(u, int(sum(b) / len(b) >= 0.5)) for u, b in by_url.items()])
    assert any({"host:cheap", "host:pills"} <= set(r) or "site" in r[0] for r in rules)
    urls, blocked = dict(pages), 0
    for r in found:
        host, path = plain_parts(urls[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        hits = [(-c, " & ".join(t)) for t, c in rules.items() if set(t) <= plain_tokens(urls[r.page_id])]
        assert r.verdict == (verdict or ("block" if hits else "allow"))
        if not rule and hits:
            assert r.confidence == pytest.approx(-min(hits)[0])
            assert r.mined_rule in {t for c, t in hits if c == min(hits)[0]}
            blocked += 1
    assert len(found) == len(pages) and blocked > 20


def test_rules_of_urls_with_many_tokens(spark):
    """A pair that says bad stands beside 20 rarer tokens of the same URLs."""
    rng = random.Random(6)
    pages, bad = [], []
    for i in range(1200):
        spam = i % 6 == 0
        rare = [f"r{k}" for k in rng.sample(range(60), 20)]
        common = ["cheap", "pills"] if spam else rng.choice([["cheap"], ["pills"], ["books"]])
        pages.append((i, f"http://a.net/{'/'.join(rare + common)}/{i}"))
        bad.append((i, int(rng.random() < (0.9 if spam else 0.2))))
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")
    found = url_rules.judged(*frames, least_support=0.07).where("mined_rule is not null").collect()
    assert {r.page_id for r in found if r.mined_rule == "path:cheap & path:pills"} and {r.page_id for r in found} >= {i for i, _ in pages if i % 6 == 0}


def test_both_ways_of_mining_agree(spark, monkeypatch):
    pages, bad = url_pages()
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")
    wanted = Counter(map(tuple, url_rules.judged(*frames).collect()))
    monkeypatch.setattr(url_rules, "MOST_SUBSETS_OF", 3)
    assert Counter(map(tuple, url_rules.judged(*frames).collect())) == wanted


AWKWARD_URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG/", "http://org", "HTTP://Example.ORG/es/1", "http://x.example.org/en/19", "http://badexample.org/es/", "http://a.com/fr/?x=http://b/", "a://b://c.com/de/#f",
    "http://a.com?/de/", "http://com/de", "http://ÄB.com/de/x", "http://" + "a." * 3000 + "org/" + "x/" * 20_000, "http://user@example.org:80/es/", "x\n://o.org/\n", "http://org/", "http://org/",
]


def test_fixed_rules_on_awkward_urls(spark):
    rows = [(i if i != 3 else None, u, "x", "y") for i, u in enumerate(AWKWARD_URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([(1, None), (None, 1)], "page_id long, bad int")
    for bad in (none, spark.createDataFrame([(i, i % 2) for i in range(20)] * 2, "page_id long, bad int")):
        found = url_rules.judged(pages, bad).collect()
        want = sorted((str(i), *plain_parts(u), str(plain_rule(*plain_parts(u))[0])) for i, u, *_ in rows)
        assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in found) == want
        assert all(r.verdict == plain_rule(r.host, r.path)[1] for r in found if r.rule)
    assert url_rules.judged(pages.limit(0), none).count() == 0


def test_whitening_against_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = defaultdict(dict)
    for r in whitening.op12_whitening(spark, DATA).collect():
        found[r.vec_id][r.component] = r
    table = sorted((r.vec_id, r.embedding) for r in rows.collect())
    x = np.floor(np.array([v for _, v in table], dtype=np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum(int(d) ** 2 for d in n * row - s) for row in x]
    made = np.array([[found[i][k].whitened for k in range(1, 9)] for i, _ in table])
    for k in range(8):
        e, v = values[-1 - k], directions[:, -1 - k]
        want = centred @ v / math.sqrt(e)
        assert min(np.abs(made[:, k] - want).max(), np.abs(made[:, k] + want).max()) < 1e-9
        assert found[table[0][0]][k + 1].explained == pytest.approx(e / values.sum(), rel=1e-9)
    assert [found[i][1].deviation for i, _ in table] == deviation and found[0][1].n == n
    error = np.abs(np.cov(made.T, bias=True) - np.eye(8)).max()
    assert found[0][3].identity_error == pytest.approx(error, abs=1e-12) and error < 1e-9


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0), (2, [2.0, 1.0], 0), (None, [0.5], 0), (4, None, 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [1.0, -inf], 0), (8, [], 0), (9, [1e30, 0.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    found = whitening.whitened(vectors).collect()
    x = np.array([[1, 2], [2, 1], [2, 1], [0.5, 0], [0, 0]]) * 1024 + 100_000
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    assert sorted((r.vec_id or 0, r.component) for r in found) == sorted((i, k) for i in (1, 2, 2, 0, 8) for k in (1, 2))
    assert all(r.n == 5 for r in found)
    for i, row in ((1, x[0]), (2, x[1]), (8, x[4])):
        for k in (1, 2):
            got = next(r for r in found if r.vec_id == i and r.component == k)
            assert abs(got.whitened) == pytest.approx(abs((row - x.mean(axis=0)) @ directions[:, -k] / math.sqrt(values[-k])), abs=1e-9)
            assert got.deviation == int(((5 * row - x.sum(axis=0)) ** 2).sum())
    for few in (rows[4:8], rows[:1], rows[1:3]):
        assert whitening.whitened(spark.createDataFrame(few, vectors.schema)).count() == 0


def test_wide_vectors_take_several_aggregations(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=12)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(vectors).collect()}
    monkeypatch.setattr(whitening, "MOST_SUMS", 7)
    assert {(r.vec_id, r.component): r.whitened for r in whitening.whitened(vectors).collect()} == pytest.approx(once, abs=1e-9)


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    result = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        result.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=str)


def trie_rows(found):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"


def awkward_conversations():
    rng, rows = random.Random(2), []
    for c in [*range(-130, 130, 7), *range(100, 140), *range(400, 408), *range(5, 1005, 100), *range(900, 960)]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "añ😀", "b" * 50]), 0, "x"))
    same = [(c, t, "user", f"turn {t}", 0, "x") for c in range(7000, 7060) for t in range(8)]
    long = [(200, t, "user", str(t % 3), 0, "x") for t in range(2500)] + [(201, 0, "user", "z" * 2_000_000, 0, "x")]
    return rows + rows[:20] + same + long + [(None, 0, "user", "lost", 0, "x")] + [(300, 1, "user", "same", 0, "x")] * 500


def test_trie_against_a_plain_rewrite(spark, monkeypatch):
    rows = awkward_conversations()
    want = plain_trie([r[:4] for r in rows])
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert trie_rows(prefix_trie.prefix_trie(table)) == want
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    assert trie_rows(prefix_trie.prefix_trie(table)) == want


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x", 0, "x")], [(5, None, None, None, 0, "x")], [(3, 0, "user", "a", 0, "x"), (3, 0, "user", "a", 0, "x")]])
def test_small_tries(spark, rows):
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie([r[:4] for r in rows])
