"""Registered queries without SQL, as they stand, against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import html_text, media, mixing, pii, simhash

from test_mixing import targets
from test_simhash import components, fingerprint


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return sorted((r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source").collect())


def test_html_has_no_markup_and_counts_code_points(spark, tiny):
    rows = html_text.op1_html(spark, tiny).collect()
    assert len(rows) == spark.read.parquet(f"{tiny}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert not [r.text for r in rows if re.search(r"</?[a-zA-Z][^<>]*>|<!--", r.text)]
    assert not [r.text for r in rows if re.search(r"[^\S\n]{2}|\n{3}|^\s|\s$", r.text)]


def test_simhash_equals_brute_force(spark, tiny, documents):
    got = {r.doc_id: r for r in simhash.op5_simhash(spark, tiny).collect()}
    codes = [fingerprint(t) for _, t, _ in documents]
    assert [got[d].fingerprint for d, _, _ in documents] == [f"{c:016x}" for c in codes]
    assert [got[d].component_id for d, _, _ in documents] == [documents[i][0] for i in components(codes)]


def test_pii_changes_nothing_else(spark, tiny, documents):
    rows = {r.doc_id: r for r in pii.op4_pii(spark, tiny).collect()}
    assert len(rows) == len(documents)
    for doc, text, _ in documents:
        assert (rows[doc].n_private == 0) == (rows[doc].text == text)
    assert sum(r.n_private > 0 for r in rows.values()) > 0


def test_mix_meets_every_target(spark, tiny, documents):
    rows = mixing.op8_mixing(spark, tiny).collect()
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in documents}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    of = {d: s for d, _, s in documents}
    want = targets({s: sum(sizes[d] for d in of if of[d] == s) for s in set(of.values())})
    for source, target in want.items():
        mine = [r for r in rows if of[r.doc_id] == source]
        assert all(r.target == pytest.approx(target) for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(target, rel=0.02)
    assert all(r.taken <= 2 * r["size"] for r in rows)


def test_media_equals_the_standard_library(spark, tiny, documents):
    rows = {r.doc_id: r for r in media.op9_media(spark, tiny).collect()}
    for doc, text, _ in documents[:60]:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
            w.writeframes(payload)
        stored = out.getvalue()
        x = np.frombuffer(payload, np.uint8).astype(float)
        p = np.unique(x, return_counts=True)[1] / len(x)
        feature = f"audio/wav;mean={x.mean():.3f};sd={x.std():.3f};entropy={-(p * np.log2(p)).sum():.3f};top={p.max():.3f};embedded=0"
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        r = rows[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want


def test_media_columns_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.read_media(media.media_table(spark, docs)).count() == 0
    df = spark.createDataFrame([(bytearray(b"GIF89a"), "image/gif", 1, 2), (None, None, 1, 2)], "media_type binary, declared string, carved int, _in_carved int")
    rows = media.sniff(df, "media_type", "declared").collect()
    assert [r["__in_carved"] for r in rows] == [1, 1] and [r["_in_carved"] for r in rows] == [2, 2]
    assert [r.media_type for r in rows] == [None, None] and rows[0].declared_right is False
    assert media.sniff(df.limit(0), "media_type").where(F.lit(True)).count() == 0
