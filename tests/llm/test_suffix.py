"""Removal of repeated byte strings against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from skytally.llm import suffix


def brute(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(spark, docs, **options) -> dict[int, tuple]:
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.without_repeats(spark, df, **options).collect()}


def corpus() -> list[tuple[int, str | None]]:
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgé"), 6))
    passage = " ".join(word() for _ in range(60))
    line = "this very common line of text stands in many places with other words around it, and it is over a hundred bytes long."
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "short"), (3, passage), (4, passage), (5, passage[:99]), (6, passage[:100])]
    for i in range(7, 40):
        docs.append((i, " ".join(word() for _ in range(30)) + passage[i : i + 150 + i] + " ".join(word() for _ in range(int(rng.integers(1, 30)))) + line))
    docs += [(40, "ab" * 400), (41, "x" * 350), (42, "x" * 100), (43, line + line + line)]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    assert result(spark, docs) == brute(docs, 100)


@pytest.mark.parametrize("group", [1, 4])
def test_crowded_anchors_are_dealt_by_longer_ones(spark, group, monkeypatch):
    docs = corpus()
    plain = suffix.repeats
    monkeypatch.setattr(suffix, "repeats", lambda s, d, length: plain(s, d, length, group=group, block=2000))
    assert result(spark, docs) == brute(docs, 100)


def test_one_line_in_ten_thousand_surroundings(spark):
    rng = np.random.default_rng(4)
    line = "".join(rng.choice(list("abcdefgh "), 130))
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    around = lambda: " ".join(words[i] for i in rng.integers(0, 3000, 12))
    docs = [(i, around() + line + around()) for i in range(10_000)] + [(20_000, line[:99] + "z"), (20_001, line[10:115])]
    assert result(spark, docs) == brute(docs, 100)


def test_rows_of_one_id_with_different_texts(spark):
    passage = "".join(np.random.default_rng(5).choice(list("abcdefghijk"), 300))
    other = "other words before it " + passage
    docs = [(7, passage), (7, other), (7, passage), (9, passage)]
    rows = suffix.without_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    kept = {(r.doc_id, r.n_bytes): bytes(r.kept).decode() for r in rows}
    assert len(rows) == 4 and kept[9, 300] == ""
    # One of the two texts of 7 comes first, and only what the other shares with it goes.
    assert (kept[7, 300], kept[7, 322]) in ((passage, other[:22]), ("", other))


def test_backward_extension_gives_classes_of_equal_windows():
    strings = [b"abracadabra abracadabra", b"cadabra abr", b"zzzzzzzzzzzz"]
    classes, starts = suffix.equal_windows(strings, 5)
    windows = [(s, i) for s in range(len(strings)) for i in range(len(strings[s]) - 4)]
    same = {}
    for s, i in windows:
        same.setdefault(strings[s][i : i + 5], set()).add(int(classes[starts[s] + i]))
    assert all(len(c) == 1 for c in same.values())
    assert len({next(iter(c)) for c in same.values()}) == len(same)


def test_empty_table_and_repeated_rows(spark):
    assert result(spark, []) == {}
    df = spark.createDataFrame([(1, "q" * 50 + "r" * 120), (1, "q" * 50 + "r" * 120), (None, "z" * 300)], "doc_id long, text string")
    rows = suffix.without_repeats(spark, df).collect()
    assert len(rows) == 3
    assert all(len(r.kept) == 300 for r in rows if r.doc_id is None)
    assert len({bytes(r.kept) for r in rows if r.doc_id == 1}) == 1
