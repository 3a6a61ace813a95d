"""Added spans on lines written by hand, and weak labels from documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.llm import pii

from .pii_lines import CLEAN, FOUND

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def added(text, model):
    base = pii.base_spans(text)
    (_, every), = pii.all_spans([text], *model)
    return [s for s in every if s not in base]


def span_of(line, kind, body):
    at = line.index(body)
    return at, pii.KINDS.index(kind), at + len(body)


@pytest.fixture(scope="module")
def model(spark):
    return pii.trained_on(*pii.document_examples(spark.read.parquet(DOCUMENTS)))


def test_generators_propose_every_span():
    missed = [line for line, kind, body in FOUND if span_of(line, kind, body) not in set(pii.candidates(line))]
    assert not missed


def test_precision_and_recall_on_lines_by_hand(model):
    right, wrong, by_kind = 0, 0, dict.fromkeys(pii.KINDS, 0)
    for line, kind, body in FOUND:
        found = added(line, model)
        hit = span_of(line, kind, body) in found
        right, wrong, by_kind[kind] = right + hit, wrong + len(found) - hit, by_kind[kind] + hit
    wrong += sum(len(added(line, model)) for line in CLEAN)
    total = {k: sum(kind == k for _, kind, _ in FOUND) for k in pii.KINDS}
    assert right / len(FOUND) >= 0.8 and right / (right + wrong) >= 0.95
    assert all(by_kind[k] / n >= 0.7 for k, n in total.items())


def test_labels_come_from_documents(spark):
    docs = spark.read.parquet(DOCUMENTS)
    fitted, held = pii.document_examples(docs)
    both = np.concatenate([fitted[2], held[2]])
    assert set(both.tolist()) == {0, 1, 2, 3} and set(np.concatenate([fitted[1], held[1]]).tolist()) == {0.0, 1.0}
    again, _ = pii.document_examples(docs.repartition(7))
    assert all(np.array_equal(a, b) for a, b in zip(fitted, again, strict=True))
    text = "mail a.b@c.org or 4111 1111 1111 1111 or +1 (826) 555-4081 or 10.1.2.3 and 1234567890123456"
    kinds = [(k, y) for k, y, _ in pii.weak_examples(text)]
    assert {k for k, y in kinds if y} == {0, 1, 2, 3} and (2, 0) in kinds
    empty, _ = pii.document_examples(docs.limit(0))
    assert len(empty[0]) == 0 and empty[0].shape[1] == len(pii.described("1", (0, 3, 1)))


def test_held_out_documents(spark, model):
    _, (x, y, kinds) = pii.document_examples(spark.read.parquet(DOCUMENTS))
    scores = model[0].scores(x)
    accepted = scores >= model[1][kinds]
    assert y[accepted].mean() >= 0.95 and accepted[y == 1].mean() >= 0.9


def test_repeated_rows_and_long_texts(spark):
    long = "word " * 200_000 + "call (212) 555-0199" + " word" * 200_000
    docs = spark.createDataFrame([(1, "call (212) 555-0199", "x"), (1, "call (212) 555-0199", "x"), (None, None, "y"), (2, long, "z"), (3, "", "z")], "doc_id long, text string, spans string")
    rows = pii.personal_data(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.spans) for r in rows] == [(None, ""), (1, "phone:5:19"), (1, "phone:5:19"), (2, "phone:1000005:1000019"), (3, "")]
    assert rows[1].redacted == "call [PHONE]"
    assert docs.where(F.lit(False)).transform(pii.personal_data).count() == 0


def test_all_candidates_train(spark, monkeypatch):
    """More candidates than one weight stands for: every one counts, in tasks as in arrays."""
    monkeypatch.setattr(pii, "MOST_WEIGHT", 10)
    docs = spark.read.parquet(DOCUMENTS)
    fitted, held = pii.document_examples(docs)
    every = sum(1 for r in docs.collect() for _ in pii.weak_examples(r.text or ""))
    assert len(fitted[1]) + len(held[1]) == every and max(np.bincount(2 * fitted[2] + fitted[1].astype(int))) > 10
    (wanted, limits), (found, own) = pii.trained_on(fitted, held), pii.trained_by(docs)
    for name in ("features", "cuts", "leaves"):
        assert np.array_equal(getattr(found, name), getattr(wanted, name))
    assert found.bias == wanted.bias and np.array_equal(own, limits)


def test_no_cap_on_candidates(spark):
    docs = spark.createDataFrame([(i, f"serial {10**9 + 7 * i} of many") for i in range(3000)], "doc_id long, text string")
    fitted, held = pii.document_examples(docs)
    assert len(fitted[1]) + len(held[1]) == sum(1 for r in docs.collect() for _ in pii.weak_examples(r.text)) >= 3000
