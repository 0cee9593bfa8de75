"""The CRF's inference against enumeration; both classifiers on held-out labels."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import labelled, quality, toxicity

SMALL = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    unary, start, trans = rng.normal(size=11), rng.normal(size=2), rng.normal(size=(2, 2))
    first = np.zeros(11, bool)
    first[[0, 4, 5]] = True
    got = toxicity.marginals(unary, first, start, trans)
    for a, b in ((0, 4), (4, 5), (5, 11)):
        p, total = np.zeros(b - a), 0.0
        for states in product((0, 1), repeat=b - a):
            w = start[states[0]] + sum(trans[x, y] for x, y in zip(states, states[1:], strict=False))
            # A clean token's emission is 1 - sigmoid(u), a toxic one's sigmoid(u).
            w += sum(-np.log1p(np.exp(-u if s else u)) for u, s in zip(unary[a:b], states, strict=True))
            total += np.exp(w)
            p += np.exp(w) * np.array(states)
        assert got[a:b] == pytest.approx(p / total, abs=1e-9)


def accuracy(spark, query, label: str) -> tuple[float, float]:
    scored = query(spark, SMALL).where("held_out").select("doc_id", "score", "predicted")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"))
    rows = scored.join(labels, "doc_id").toPandas()
    pos, neg = rows[rows.label == 1].score.to_numpy(), rows[rows.label == 0].score.to_numpy()
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) if len(pos) and len(neg) else 1.0
    return float(auc), float((rows.predicted == rows.label).mean())


def test_toxicity_on_held_out_labels(spark):
    auc, right = accuracy(spark, toxicity.op10_toxicity, "toxic")
    assert auc > 0.9 and right > 0.9


def test_quality_on_held_out_labels(spark):
    auc, right = accuracy(spark, quality.op2_quality, "quality")
    assert auc > 0.8 and right > 0.75


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_rows_and_columns(spark, module):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "some words here", 5), (4, "word " * 200_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = module.score(docs, module.fit(spark, docs, labels))
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r["_in_score"] == 5 for r in rows)
    assert module.score(docs.limit(0), module.fit(spark, docs.limit(0), labels)).count() == 0


def test_toxic_spans_point_at_the_words(spark):
    bad = ["you vile wretch go away", "what a vile wretch é", "vile wretch they said"]
    clean = ["a fine day for a walk", "the market opens at nine", "rivers run to the sea"]
    # A feature counts once for each word it follows, so the marked word needs surroundings that vary.
    texts = [t.replace("vile", f"near{i} vile") + f" number {i}" for i in range(40) for t in bad + clean]
    model = toxicity.train(texts, np.array([float("vile" in t) for t in texts]))
    docs = spark.createDataFrame([(1, "é such a vile wretch today"), (2, "a fine day by the river")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert rows[1].predicted == 1 and rows[2].predicted == 0
    assert any("vile" in "é such a vile wretch today"[s.start : s.end] for s in rows[1].spans) and not rows[2].spans


def test_one_long_text_does_not_end_the_training_set(monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOKENS", 4000)
    texts = ["a fine day by the river " * 2000]
    for i in range(40):
        texts += [f"near{i} vile wretch they said number {i}", f"the market opens near{i} at nine number {i}"]
    labels = np.array([float("vile" in t) for t in texts])
    model = toxicity.train(texts, labels)
    data = "what a vile wretch today".encode()
    _, _, row, features = toxicity.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert toxicity.document_values(toxicity.unaries(model)(features), model.start, model.trans, row, 1)[1][0] >= 0.5


def test_training_tokens_are_bounded_and_from_all_documents(monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOKENS", 2000)
    sizes = np.array([5000, 30, 0, 700, 10, 900])
    row = np.repeat(np.arange(6), sizes)
    marked = np.zeros(len(row), bool)
    marked[4321] = True
    pick, opens = toxicity.training_tokens(row, marked, 6)
    got = np.bincount(row[pick], minlength=6)
    assert pick.sum() <= 2000 and (got[[1, 4]] == [30, 10]).all() and (got[[0, 3, 5]] >= 600).all()
    assert pick[4321] and opens[pick][0]


def test_one_long_text_does_not_make_the_dictionary(monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_BYTES", 40_000)
    rng = np.random.default_rng(3)
    words = [f"word{i}x" for i in rng.integers(0, 1 << 30, 40)]
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 100_000))] + [" ".join(rng.permutation(words)) for _ in range(30)]
    content = quality._dictionary(texts)
    assert sum(w.encode() in content for w in words) >= 20


def test_sample_is_bounded_in_rows_and_bytes(spark):
    repeated = spark.range(100_000).selectExpr("7L AS doc_id", "concat('copy ', id % 3) AS text")
    long = spark.range(1).selectExpr("8L AS doc_id", "repeat('fifty megabytes of text. ', 2000000) AS text")
    docs = repeated.unionByName(long).unionByName(spark.createDataFrame([(i, f"text {i}") for i in range(10, 40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", 5, 0, 12).collect()
    assert len(rows) <= 24 and len({r.doc_id for r in rows}) == len(rows)
    everything = labelled.sample(docs, labels, "toxic", 1, 1, 100).collect()
    sizes = {r.doc_id: len(r.text.encode()) for r in everything}
    assert len(everything) == 32 and max(sizes.values()) == sizes[8] <= labelled.DOC_BYTES + 8
    assert next(r.text for r in everything if r.doc_id == 7) == "copy 0"
