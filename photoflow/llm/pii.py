"""Personal data: patterns with fixed rules, and candidates that boosted trees judge.

Generators of high recall propose spans that may overlap: numbers in groups,
written-out or spaced addresses, defanged and long host numbers.  Trees score
each from its format and the words around it; thresholds per kind, calibrated
for precision on documents and lines that were held out, select what is added.

Labels are weak.  A span of the fixed rules is personal data; written in a way
that those rules do not know (its decisive character masked), in its own
context, it is an example of what they miss.  A candidate of the same documents
that no fixed span touches counts as none.  Invented lines stand for formats
that the documents lack.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import free_worker_table, hash52, map_texts, running_sum, staged, table
from .boosting import UNIT, Growing, Trees, binned, boosted, edges_of, first_bias, grown_trees, least_threshold, slope_sums

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

# The patterns of the four kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
NUMBERS = re.compile(r"(?:\+ ?)?[(]?[0-9](?:[ ().\-/]{0,3}[0-9])+")
AT_WORD = re.compile(r" ?[\[(]at[\])] ?| at | ?@ ", re.IGNORECASE)
DOTTED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
HOSTS = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])|(?<![\w.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}| ?\. ?[0-9]{1,3}|\.[0-9]{1,3}){3}(?![\w.])")
#: Candidates that are described and scored at once.
BLOCK = 1 << 14
#: Context looked at before and after a candidate, in characters.
AROUND = 28
#: All candidates of documents count; those of one kind and label together as
#: much as so many invented lines at most, so that the lines' formats stay known.
MOST_WEIGHT = 2000
#: The precision that thresholds reach on held-out documents and lines.
PRECISION = 0.995
CUES = tuple(
    re.compile(rf"\b(?:{w})", re.IGNORECASE)
    for w in (
        r"e-?mail|mail|contact|write to|reach|correo|courriel",
        r"ip\b|host|server|addr|client|login from|node|dns",
        r"card|visa|mastercard|amex|credit|debit|payment|tarjeta|carte|karte",
        r"phone|tel|call|mobile|cell|fax|whatsapp|dial|contact|reach|telefon",
        r"order|invoice|isbn|version|serial|part|item|ref|id\b|no\b|page|date|year|copyright|price|total|population",
    )
)
TOP_LEVEL = frozenset("com org net edu gov io info biz de fr es uk eu us ca ch at be nl it".split())


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches without overlap. A match has one @, so each @ is looked
    at once: what stands before it and whether a domain follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, 0, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed rules; a match that fails its rule is dropped."""
    spans = list(emails(text))
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(spans)


def number_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digit groups of 7 to 19 digits, with a plus or bracket in front; of
    runs of more than 12 digits, also all sub-runs of whole groups, as several numbers may stand together."""
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m[0])]
        total = sum(b - a for a, b in groups)
        if total <= 19:
            yield m.start(), m.end()
        if total <= 12:
            continue
        for i, (start, _) in enumerate(groups):
            while start > m.start() and text[start - 1] in "+(":
                start -= 1
            held = 0
            for a, b in groups[i:]:
                held += b - a
                if held > 19:
                    break
                if held >= 7 and (start, b) != (m.start(), m.end()):
                    yield start, b


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal data though the fixed rules do not say so."""
    if DIGIT.search(text):
        for start, end in number_runs(text):
            n = len(digits_of(text[start:end]))
            if 7 <= n <= 15:
                yield start, 3, end
            if 12 <= n <= 19:
                yield start, 2, end
    if ":" in text or DIGIT.search(text):
        for m in HOSTS.finditer(text):
            if m.end() - m.start() > 4:
                yield m.start(), 1, m.end()
    for m in AT_WORD.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in LOCAL:
            start -= 1
        domain = DOTTED.match(text, m.end())
        if start < m.start() and domain:
            yield start, 0, domain.end()


def described(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, as numbers."""
    start, kind, end = span
    body, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + 2]
    groups = re.findall("[0-9]+", body)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    last = re.split(r"[^A-Za-z0-9]+", body.lower())[-1]
    near = before[-1:]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), end - start,
        *(body.count(c) for c in "+(-./ :[@"),
        float(bool(digits) and luhn(digits)), float(digits[:1] in "3456" and bool(digits)), float(digits[:1] == "0"),
        float("www." in body.lower()), float(body.count("::")), float(body[:1] == "+"), float(body[:2] == "00"), float(sizes in ([2, 2, 2, 2, 2], [3, 2, 2, 2], [3, 4, 4], [2, 4, 4], [3, 3, 3], [4, 2, 7])), float(before[-4:].lower().endswith(("p: ", "e: ", "l: ", "x: ", "l. ", "to: "))),
        float(len(set(digits))), float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)), float(sizes == [3, 3, 4]),
        float(len(set(sizes[:-1])) == 1 and len(sizes) > 2), max((int(g) for g in groups if len(g) < 5), default=0),
        float(last in TOP_LEVEL), float(bool(re.search(r"[\[(](?:at|dot)[\])]", body, re.IGNORECASE))), float(" dot " in body), sum(c.isalpha() for c in body),
        *(float(bool(cue.search(before))) for cue in CUES),
        float(near.isalnum()), float(near in "$€£#" and bool(near)), float(near in "-./_"  and bool(near)), float(after[:1].isalnum()), float(after[:1] in "%-_/" and bool(after)), float(after[:1] == "." and after[1:].isdigit()),
    ]


# --- examples from which the trees are trained -------------------------------------

_WORDS = "the of and report from over last which they then was house river green made with under light paper seven".split()
_CUE = (
    ("email", "contact:", "write to", "mail me:", "reach us,"),
    ("ip", "host", "server", "client", "login from"),
    ("card", "visa", "credit card", "payment by", "card no."),
    ("phone:", "call", "tel.", "mobile", "fax", "reach me on"),
)
_OTHER = ("order", "invoice no.", "ISBN", "version", "serial", "part", "item", "ref.", "id", "page", "date", "copyright", "price", "total", "population")


class Claimed(str):
    """A body that another word than a cue must stand before."""


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _true(rng: random.Random, kind: int) -> str:
    name = rng.choice(_WORDS) + rng.choice(["", ".", "_"]) + rng.choice(_WORDS) + rng.choice(["", _digits(rng, 2)])
    host, end = rng.choice(_WORDS) + rng.choice(["", "-" + rng.choice(_WORDS)]), rng.choice(sorted(TOP_LEVEL))
    if kind == 0:
        at, dot = rng.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", "."), ("[at]", ".")])
        return name + at + host + dot + end
    if kind == 1:
        if rng.random() < 0.5:
            words = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
            if rng.random() < 0.5:
                return ":".join(words)
            a, b = rng.randrange(1, 5), rng.randrange(0, 3)
            return ":".join(words[:a]) + "::" + ":".join(words[:b])
        return rng.choice(["[.]", " . ", "(.)", "[dot]"]).join(str(rng.randrange(1, 256)) for _ in range(4))
    if kind == 2:
        d = rng.choice("3456") + _digits(rng, 14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice(["/", ".", " . "]).join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = str(rng.randrange(200, 999)), _digits(rng, 3), _digits(rng, 4)
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{a} {b}{c}", f"({a}) {b} {c}", f"00{rng.choice(['49', '33', '34', '44'])} {a[:2]} {b}{c}", f"00{rng.choice(['49', '33', '34', '44'])} {a[:2]} {b} {c}", f"0{a[:2]} {c} {b}{c[0]}",
        f"6{a[:2]} {b[:2]} {c[:2]} {c[2:]}", f"0{a[0]} {a[1:]} {b[:2]} {c[:2]} {c[2:]}", f"+{a[0]} ({b}) {a}-{c}", f"({b[:2]}) {c}-{c[::-1]}", f"{b}-{c}",
    ])


def _false(rng: random.Random, kind: int) -> str:
    if kind == 0:
        plain = f"{rng.choice(_WORDS)}{rng.choice([' at ', ' @ '])}{rng.choice(_WORDS)}{rng.choice(['. ', '.', ' dot '])}{rng.choice(_WORDS)}"
        return rng.choice([plain, plain, f"{rng.choice(_WORDS)} at www.{rng.choice(_WORDS)}.{rng.choice(sorted(TOP_LEVEL))}"])
    if kind == 1:
        if rng.random() < 0.5:
            times = ":".join(f"{rng.randrange(60):02d}" for _ in range(rng.choice([4, 5])))
            return rng.choice([times, f"{rng.choice(['abc', 'add', 'face', 'deed', 'bad', 'cafe'])}::{rng.choice(['dead', 'feed', 'fade', 'bed', 'ace'])}"])
        return rng.choice([".", " . ", ". "]).join(str(rng.randrange(1, 900)) for _ in range(4))
    if kind == 2:
        wrong = _true(rng, 2)
        at = rng.choice([i for i, c in enumerate(wrong) if c.isdigit()])
        wrong = wrong[:at] + str((int(wrong[at]) + rng.randrange(1, 10)) % 10) + wrong[at + 1 :]
        years = " ".join(str(rng.randrange(1900, 2040)) for _ in range(4))
        dates = " ".join(f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/{rng.randrange(1900, 2040)}" for _ in range(2))
        return rng.choice([_digits(rng, rng.randrange(12, 20)), " ".join(_digits(rng, rng.randrange(2, 6)) for _ in range(4)), " ".join(_digits(rng, 4) for _ in range(4)), wrong, wrong, years, dates, f"00{rng.choice(['49', '33', '44'])} {_digits(rng, 2)} {_digits(rng, 7)}"])
    year = rng.randrange(1900, 2040)
    if rng.random() < 0.25:  # a number like a phone's, which another word claims
        return Claimed(_true(rng, 3))
    return rng.choice([
        f"{year}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{year}-{year + 3}", f"{year}/{year + 1}", _digits(rng, rng.randrange(7, 16)),
        f"{rng.randrange(9)}.{_digits(rng, rng.randrange(6, 12))}", f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}/{year}", f"978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}",
        " ".join(_digits(rng, rng.randrange(1, 4)) for _ in range(4)), f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 3)}", f"{_digits(rng, 5)}-{_digits(rng, 4)}", f"{year} {year + 1}", f"{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 3)}",
    ])


def examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Described candidates of invented lines, whether each is personal data, and kinds."""
    rng, x, y, kinds = random.Random(seed), [], [], []
    for _ in range(n):
        kind, right = rng.randrange(len(KINDS)), rng.random() < 0.5
        body = _true(rng, kind) if right else _false(rng, kind)
        # a bare number counts only beside a word that says so, and not every number beside one counts
        cued = kind > 1 or rng.random() < 0.6 if right else rng.random() < 0.2
        cue = rng.choice(_CUE[kind]) if cued else rng.choice([rng.choice(_OTHER), rng.choice(_WORDS), ""])
        if kind == 3 and not right and isinstance(body, Claimed):
            cue = rng.choice(_OTHER)
        if kind == 3 and right and body[0] == "+" and rng.random() < 0.5:
            cue = rng.choice(_WORDS)
        lead = " ".join(rng.choices(_WORDS, k=rng.randrange(1, 5))) + f" {cue} "
        text = lead + body + rng.choice([" ", ". ", ", ", "\n"]) + rng.choice(_WORDS)
        x.append(described(text, (len(lead), kind, len(lead) + len(body))))
        y.append(right)
        kinds.append(kind)
    return np.array(x, dtype=float), np.array(y, dtype=float), np.array(kinds)


def masked(kind: int, body: str, choice: int) -> str:
    """A span of the fixed rules, written in a way that they do not know."""

    def one(*ways: str) -> str:
        return ways[choice % len(ways)]

    if kind == 0:
        name, host = body.split("@")
        at, dot = one((" at ", " dot "), ("[at]", "."), (" (at) ", " (dot) "), (" @ ", "."), ("(at)", "[dot]"))  # type: ignore[arg-type]
        return name + at + host.replace(".", dot)
    if kind == 1:
        return body.replace(".", one("[.]", " . ", "(.)", "[dot]"))
    digits = digits_of(body)
    if kind == 2:
        return one("/", ".", " . ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return one("", "00", "") + body[1:]


def weak_examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, description) of the candidates of a document: masked fixed
    spans, and candidates that no fixed span touches."""
    base = base_spans(text)
    for start, kind, end in base:
        body = masked(kind, text[start:end], int(hashlib.sha256(text[start:end].encode()).hexdigest()[:8], 16))
        lead = text[max(0, start - 2 * AROUND) : start]
        changed, span = lead + body + text[end : end + 4], (len(lead), kind, len(lead) + len(body))
        if span in set(candidates(changed)):
            yield kind, 1, described(changed, span)
    for span in apart(text, base):
        yield span[1], 0, described(text, span)


def apart(text: str, base: list[Span]) -> Iterator[Span]:
    """Candidates that no fixed span touches."""
    starts = np.array([b[0] for b in base])
    reach = np.maximum.accumulate(np.array([b[2] for b in base])) if base else starts
    for span in dict.fromkeys(candidates(text)):
        before = int(np.searchsorted(starts, span[2]))
        if not before or reach[before - 1] <= span[0]:
            yield span


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def weak_rows(docs: DataFrame) -> DataFrame:
    """held (of a fourth of the documents, by a hash of the text), kind, label and
    the description x of every candidate of every document."""
    schema = "examples array<struct<kind: int, label: int, x: array<double>>>"

    def kernel(texts: list[bytes]) -> dict:
        return {"examples": [[{"kind": k, "label": y, "x": x} for k, y, x in weak_examples(t.decode("utf-8", "replace"))] for t in texts]}

    found = map_texts(docs, kernel, schema, {"held": (F.pmod(F.xxhash64("text"), F.lit(4)) == 0)})
    return staged(found.select("held", F.explode("examples").alias("e")).select("held", "e.*"))


def document_examples(docs: DataFrame) -> tuple[Rows, Rows]:
    """Described candidates, labels and kinds of documents to fit on, and of
    held-out ones, as arrays: for small tables (``trained_by`` fits on any)."""
    rows = weak_rows(docs).withColumn("place", hash52(F.to_json(F.struct("kind", "label", "x")))).orderBy("kind", "label", "place", "x").collect()
    width = len(described("1", (0, 3, 1)))
    parts = [[r for r in rows if r.held == held] for held in (False, True)]
    made = [(np.array([r.x for r in p], dtype=float).reshape(-1, width), np.array([r.label for r in p], dtype=float), np.array([r.kind for r in p], dtype=int)) for p in parts]
    return made[0], made[1]


def class_weight(n: int) -> int:
    """What a candidate of documents weighs, of which there are n of its kind and label."""
    return round(min(1.0, MOST_WEIGHT / max(n, 1)) * UNIT)


def class_weights(y: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    at = 2 * kinds + y.astype(int)
    return np.array([class_weight(n) for n in np.bincount(at, minlength=2 * len(KINDS))], dtype=float)[at]


def trained_on(fitted: Rows | None, held: Rows | None) -> tuple[Trees, np.ndarray]:
    """The trees, and for each kind the least threshold that reaches PRECISION on
    held-out documents and invented lines that were not trained on."""

    def joined_with(lines: Rows, found: Rows | None) -> tuple[np.ndarray, ...]:
        weighed = [(*lines, np.full(len(lines[1]), float(UNIT))), *([(*found, class_weights(found[1], found[2]))] if found else [])]
        return tuple(np.concatenate(c) for c in zip(*weighed, strict=True))

    x, y, _, weight = joined_with(examples(1, 4000), fitted)
    held_x, held_y, held_kinds, held_weight = joined_with(examples(2, 4000), held)
    trees = boosted(x, y, weight)
    scores, of = trees.scores(held_x), [held_kinds == k for k in range(len(KINDS))]
    return trees, np.array([least_threshold(scores[m], held_y[m], held_weight[m], PRECISION) for m in of])


def trained_by(docs: DataFrame) -> tuple[Trees, np.ndarray]:
    """``trained_on`` for all candidates of all documents, which stay in tasks.

    The driver gets counts of each column's values (formats bound how many there
    are) and, for each level of a tree, one table of sums a task of packed
    candidates; thresholds come from running sums over the held-out scores.
    """
    rows = weak_rows(docs)
    counts = {(r.held, r.kind, r.label): r.n for r in rows.groupBy("held", "kind", "label").agg(F.count("*").alias("n")).collect()}
    weights = {h: [class_weight(counts.get((h, k, y), 0)) for k in range(len(KINDS)) for y in (0, 1)] for h in (False, True)}
    x, y, _ = examples(1, 4000)
    own = np.full(len(y), float(UNIT))
    seen: list[dict[float, float]] = [{} for _ in range(x.shape[1])]
    for i, column in enumerate(seen):
        values, n = np.unique(x[:, i], return_counts=True)
        column.update(zip(values.tolist(), (n * float(UNIT)).tolist(), strict=True))
    for r in rows.where("not held").select("kind", "label", F.posexplode("x").alias("i", "value")).groupBy("kind", "label", "i", "value").agg(F.count("*").alias("n")).collect():
        seen[r.i][r.value] = seen[r.i].get(r.value, 0.0) + r.n * weights[False][2 * r.kind + r.label]
    edges = [edges_of(np.array(sorted(c)), np.array([c[v] for v in sorted(c)])) for c in seen]
    every = {y: sum(counts.get((False, k, y), 0) * weights[False][2 * k + y] for k in range(len(KINDS))) for y in (0, 1)}
    right = int(own[y > 0].sum()) + every[1]
    bias = first_bias(right, int(own[y == 0].sum()) + every[0] + right)
    blocks, bins = packed_candidates(rows.where("not held"), edges, weights[False]), binned(x, edges)

    def sums(grown: Growing, level: int) -> np.ndarray:
        return sum(summed(blocks, grown, level), slope_sums(bins, y, own, grown, level))

    trees = grown_trees(sums, edges, bias)
    return trees, thresholds_of(rows.where("held"), trees, weights[True])


def packed_candidates(rows: DataFrame, edges: list[np.ndarray], weights: list[int]) -> DataFrame:
    """Blocks of candidates as bytes: numbers of bins, labels and weights."""
    of = np.array(weights, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        for batch in batches:
            kind, label = (np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1))
            x = np.asarray(batch.column(2).flatten()).reshape(len(kind), -1)
            made = [binned(x, edges).tobytes(), label.astype(np.uint8).tobytes(), of[2 * kind + label].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in made], names=["bins", "label", "weight"])

    return staged(rows.select("kind", "label", "x").mapInArrow(run, "bins binary, label binary, weight binary"))


def summed(blocks: DataFrame, grown: Growing, level: int) -> list[np.ndarray]:
    """Each task's ``slope_sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for bins, label, weight in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                y = np.frombuffer(label, dtype=np.uint8).astype(float)
                part = slope_sums(np.frombuffer(bins, dtype=np.uint8).reshape(len(y), -1), y, np.frombuffer(weight), grown, level)
                found = part if found is None else found + part
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

    return [np.frombuffer(r.sums, dtype=np.int64).reshape(2, -1) for r in blocks.mapInArrow(run, "sums binary").collect()]


def thresholds_of(held: DataFrame, trees: Trees, weights: list[int]) -> np.ndarray:
    """For each kind the least threshold of PRECISION, from all held-out candidates and lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees.scores(x))], names=["kind", "label", "score"])

    spark = held.sparkSession
    found = held.select("kind", "label", "x").mapInArrow(run, "kind int, label int, score double").groupBy("kind", "label", "score").agg(F.count("*").alias("n"))
    of_class = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), 2 * F.col("kind") + F.col("label"))
    found = found.withColumn("weight", F.col("n") * of_class).drop("n")
    x, y, kinds = examples(2, 4000)
    lines = [(int(k), int(label), float(score), UNIT) for k, label, score in zip(kinds, y, trees.scores(x), strict=True)]
    both = found.unionByName(spark.createDataFrame(lines, "kind int, label int, score double, weight long"))
    grouped = both.groupBy("kind", "score").agg(F.sum(F.col("weight") * F.col("label")).alias("right"), F.sum("weight").alias("every"))
    grouped = staged(grouped.withColumn("bucket", F.floor(64 * F.ln((1 - F.col("score")) / F.col("score")))))
    best = [F.desc("score")]
    ranked = running_sum(running_sum(grouped, ["kind"], "bucket", best, F.col("right"), "right_so_far"), ["kind"], "bucket", best, F.col("every"), "so_far")
    least = dict(ranked.where(F.col("right_so_far") >= PRECISION * F.col("so_far")).groupBy("kind").agg(F.min("score")).collect())
    return np.array([max(0.5, least[k]) if k in least else 2.0 for k in range(len(KINDS))])


@lru_cache(maxsize=1)
def trained() -> tuple[Trees, np.ndarray]:
    """Trees and thresholds from invented lines alone."""
    return trained_on(None, None)


# --- spans of whole texts -----------------------------------------------------------


def chosen(scored: list[tuple[float, Span]]) -> list[Span]:
    """Of accepted spans that overlap, that with the higher score stays.

    Taken spans do not overlap, so the only ones that a span can meet are
    its neighbours in the order of their starts.
    """
    starts: list[int] = []
    taken: list[Span] = []
    for _, span in sorted(scored, key=lambda e: (-e[0], e[1])):
        at = bisect_right(starts, span[0])
        if (at == 0 or taken[at - 1][2] <= span[0]) and (at == len(starts) or span[2] <= starts[at]):
            starts.insert(at, span[0])
            taken.insert(at, span)
    return taken


def all_spans(texts: list[str], trees: Trees, thresholds: np.ndarray) -> list[tuple[list[Span], list[Span]]]:
    """For each text, the spans of the fixed rules and those with the added ones."""
    bases = [base_spans(t) for t in texts]
    proposed: list[tuple[int, Span]] = []
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        proposed += [(i, span) for span in apart(text, base)]
    added: dict[int, list[tuple[float, Span]]] = {}
    if proposed:
        scores = np.concatenate([trees.scores(np.array([described(texts[i], s) for i, s in proposed[at : at + BLOCK]], dtype=float)) for at in range(0, len(proposed), BLOCK)])
        for (i, span), score in zip(proposed, scores.tolist(), strict=True):
            if score >= thresholds[span[1]]:
                added.setdefault(i, []).append((score, span))
    return [(b, sorted(b + chosen(added[i])) if i in added else b) for i, b in enumerate(bases)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one mark."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id (or ``keys``), n_email, n_ip, n_card, n_phone,
    base_sha256, spans and redacted.

    The counts and base_sha256 are of the fixed rules' spans alone; ``spans``
    has those and the added ones, as kind:start:end in code points, by start
    and kind; ``redacted`` is the whole text without them. A null text is
    empty; an empty text has no spans. Rows that repeat are searched each;
    columns beyond doc_id and text are not looked at. An empty table gives no
    rows. Texts of any length are searched whole. The trees are fitted on all
    candidates of ``docs`` and invented lines (``trained_by``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_by(docs))

    def kernel(texts: list[bytes]) -> dict:
        whole = [t.decode("utf-8", "replace") for t in texts]
        found = all_spans(whole, *shared.value)
        counts = [[sum(s[1] == k for s in base) for k in range(len(KINDS))] for base, _ in found]
        return {
            **{f"n_{name}": [c[k] for c in counts] for k, name in enumerate(KINDS)},
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
            "spans": [joined(every) for _, every in found],
            "redacted": [redacted(t, every) for t, (_, every) in zip(whole, found, strict=True)],
        }

    schema = ", ".join(f"n_{name} long" for name in KINDS) + ", base_sha256 string, spans string, redacted string"
    return map_texts(docs, kernel, schema, keys or {"doc_id": F.col("doc_id")})


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("redacted")


QUERIES = {"op9_pii": op9_pii}
ORACLE_SQL: dict[str, str] = {}
