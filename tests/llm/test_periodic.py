"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skytally.llm import periodic


def smallest_period(x) -> int:
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def brute(x) -> list[tuple[int, int, int]]:
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q) and smallest_period(x[start : start + length]) == q:
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_any_sequence(x):
    assert periodic.find_runs(np.array(x, np.int64)) == brute(x)


def test_repeated_phrases_nested_and_touching():
    rng = random.Random(5)
    for _ in range(150):
        x: list[int] = []
        for _ in range(rng.randint(1, 5)):
            one = [rng.randint(0, 4) for _ in range(rng.randint(1, 14))]
            part = (one * 9)[: rng.randint(1, 9 * len(one))]
            x += (part * rng.choice((1, 1, 4)))[:160]
        assert periodic.find_runs(np.array(x, np.int64)) == brute(x)


@pytest.mark.parametrize("kind", ("one", "two", "natural", "nearly"))
def test_long_texts_cost_in_proportion(kind):
    n = 200_000
    rng = np.random.default_rng(1)
    x = {"one": np.zeros(n, np.int64), "two": np.arange(n) % 2, "natural": rng.zipf(1.3, n) % 100_000, "nearly": np.where(np.arange(n) % 1000 == 999, np.arange(n), 0)}[kind].astype(np.int64)
    began = time.process_time()
    runs = periodic.find_runs(x)
    assert time.process_time() - began < 20
    if kind in ("one", "two"):
        assert runs == [(0, n, 1 if kind == "one" else 2)]
    if kind == "nearly":
        assert len(runs) == 200 and all(r[1:] == (999, 1) for r in runs)


def test_registered_query_equals_brute_force(spark, tiny):
    got = {r.doc_id: r for r in periodic.op12_periodic(spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    checked = 0
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue
        runs = brute(words)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = None
        for s, m, q in runs:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
        checked += bool(runs)
    assert checked > 3


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \t\n", 5), (None, "a b " * 8, None), (4, "a b " * 8, 6), (4, "a b " * 8, 6)], "doc_id int, text string, runs int")
    rows = periodic.periodic_runs(df).collect()
    assert [r.collapsed for r in rows] == ["", "", "", "a b", "a b", "a b"]
    assert [[tuple(x) for x in r.runs] for r in rows] == [[], [], [], *[[(0, 16, 2)]] * 3]
    assert [r._in_runs for r in rows] == [5, 5, 5, None, 6, 6]
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert [r.text for r in df.select(periodic.planted(df.text, df.doc_id).alias("text")).collect()][:3] == [None, "", " \t\n"]
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, copies=2)
