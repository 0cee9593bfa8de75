"""Importance resampling: the registered query against SQL, longer runs of words against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from skytally.llm import resample


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n, buckets, percent, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, n)[1]))
    for text in target:
        t.update(map(bucket, features(text, n)[1]))
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        words, fs = features(text, n)
        weight = math.floor(sum(gain[bucket(f)] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = len(order) * percent // 100
    return sorted([repr((*r, k + 1 if k < drawn else None)) for k, r in enumerate(order)] + [repr((*r, None)) for r in out if r[1] < least])


@pytest.mark.parametrize("n", (1, 2, 3))
def test_equals_brute_force(spark, tiny, n, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    monkeypatch.setattr(resample, "NODES", 500)
    monkeypatch.setattr(resample, "RANKED_ROWS", 30)
    got = resample.resample(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench, n, 997, 33, 40, 7).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    want = brute(docs, [r.text for r in bench.collect()], n, 997, 33, 40, 7)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_nodes_go_on_with_their_parents_crc():
    trie = resample.Trie()
    nodes = trie.walk([b"a", "é".encode(), b"a", "é".encode()], 3)
    texts = ["a", "é", "a", "é", "a é", "é a", "a é", "a é a", "é a é"]
    assert [trie.crc[x] for x in nodes] == [zlib.crc32(t.encode()) for t in texts]
    assert nodes[4] == nodes[6] and len(trie) == 6


def test_edges(spark):
    rows = [(None, "word " * 25), (None, "word " * 25), (3, None), (4, ""), (5, "x " * 19), (6, "ß É word " * 9), (6, "ß É word " * 9), (6, "!?")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, score int")
    target = spark.createDataFrame([("a word",), (None,)], "text string")
    got = resample.resample(spark, docs, target, percent=60)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, ["a word", None], 1, 10_000, 60, 20, 2024)
    assert got.where("rank is not null").count() == 2
    assert resample.resample(spark, docs.limit(0), target).count() == 0
    assert all(r.rank is None for r in resample.resample(spark, docs, target.limit(0), least_words=100).collect())
