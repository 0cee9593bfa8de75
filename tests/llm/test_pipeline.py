"""The corpus pipeline on the smallest tables: each stage against brute force on what the stage before it kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skytally.session import materialize

import corpus_pipeline

from test_copies import first_of_each
from test_decontaminate import brute


@pytest.fixture(scope="module")
def stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, tiny), name)
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_near_duplicates_keep_one_of_each_group(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].select("doc_id", "text").collect())
    first = first_of_each([t for _, t in rows])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({rows[i][0] for i in first})


def test_decontamination_drops_the_contaminated(spark, tiny, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in stages[2].select("doc_id", "text").collect()]
    kept = {d for d, v in brute(rows, items).items() if not v[4]}
    assert {r.doc_id for r in stages[3].collect()} == kept


def test_pii_keeps_all_rows_and_mixing_all_sizes(stages):
    assert sorted(r.doc_id for r in stages[4].collect()) == sorted(r.doc_id for r in stages[3].collect())
    mixed = {r.doc_id: r for r in stages[5].collect()}
    sizes = {r.doc_id: len((r.text or "").split()) for r in stages[4].collect()}
    assert set(mixed) == set(sizes)
    assert all(0 <= r.taken <= 2 * r.size for r in mixed.values())


def test_toxic_documents_go(spark, tiny, stages):
    labels = spark.read.parquet(f"{tiny}/labels.parquet").select("doc_id", "toxic")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    known = [(r.doc_id, r.toxic) for r in labels.where("toxic IS NOT NULL").join(stages[0].select("doc_id").distinct(), "doc_id").collect()]
    clean, toxic = ([d in kept for d, t in known if t == label] for label in (0, 1))
    assert sum(clean) >= 0.95 * len(clean)
    assert len(toxic) > 3 and sum(toxic) <= 0.3 * len(toxic)


def test_clashing_names_and_null_ids(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(30)
    names = ("_gone", "_bad", "_code", "_row", "_copy", "_root", "score", "_in_score", "predicted", "n_private", "_found", "row", "order")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    docs = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names)
