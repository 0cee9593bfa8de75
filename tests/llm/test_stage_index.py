"""The SimHash index within the pipeline's near-duplicate stage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skytally.llm import copies, simhash

from test_copies import edited, first_of_each


def gray_rank(fp: int) -> int:
    return int(copies.gray_rank(np.array([fp], np.uint64)).view(np.int64)[0])


def test_stage_drops_what_the_index_links_without_any_shared_minima(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = [f"w{i}" for i in rng.integers(0, 1 << 30, 3000)]
        texts += [" ".join(base), edited(rng, base, 1), edited(rng, base, 600)]
    asked, index = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda spark, codes: asked.append(codes.count()) or index(spark, codes))
    # No candidates by minima.
    monkeypatch.setattr(copies, "_pairs", lambda members: members.select(F.col("code").alias("a"), F.col("code").alias("b"), F.lit(0).cast("short").alias("alike"), F.lit(True).alias("led")).where("false"))
    monkeypatch.setattr(copies, "_open", lambda *_: None)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert len(asked) == 1 and asked[0] > 24
    # Nothing but near copies goes, and of those with one changed word most.
    assert kept >= set(first_of_each(texts)) and len([i for i in range(1, 36, 3) if i not in kept]) >= 8


def test_candidates_of_the_index(spark):
    prints = [0, 0, 0, 0b111, 0b1111 << 20, 1 << 63, (1 << 63) | 0b11 << 8, 0b111]
    sizes = [100, 100, 50, 90, 100, 100, 10, 100]
    codes = spark.createDataFrame([(i, n, gray_rank(fp)) for i, (fp, n) in enumerate(zip(prints, sizes, strict=True))], "code long, n long, rank long")
    pairs = {tuple(sorted((r.a, r.b))) for r in copies.indexed(spark, codes, simhash.links).collect()}
    # 2 and 6 are of other sizes, 4 is four bits away; 5 is one bit from 0, 7 has the fingerprint of 3.
    assert (0, 1) in pairs and (3, 7) in pairs and (0, 5) in pairs
    assert not any({2, 6, 4} & set(p) for p in pairs)
    seen = {0}
    while grown := {x for p in pairs if seen & set(p) for x in p} - seen:
        seen |= grown
    assert seen == {0, 1, 3, 5, 7}
