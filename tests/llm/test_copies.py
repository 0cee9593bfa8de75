"""Near copies of the pipeline's stage against brute force."""

from __future__ import annotations

import re

import numpy as np

from skytally.llm import copies, simhash


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_each(texts: list[str | None]) -> list[int]:
    """The index of the first text of each one's component."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng: np.random.Generator, words: list[str], edits: int) -> str:
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"edit{rng.integers(1 << 40)}"
    return " ".join(out)


def planted() -> list[str | None]:
    """Twenty bases of 300 words with five copies each of one to nine changed words, and texts at the edges."""
    rng = np.random.default_rng(5)
    out: list[str | None] = [None, "", " \n", "one", "One", "one two", "a b c d", "A b  c d", "x " * 5000, "x " * 9]
    for _ in range(20):
        base = [f"w{i}" for i in rng.integers(0, 1 << 30, 300)]
        out += [" ".join(base), *(edited(rng, base, int(e)) for e in rng.integers(1, 10, 5))]
    return out


def test_edited_copies_go(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(spark, docs).collect()}
    assert kept == set(first_of_each(texts))


def test_crowded_keys_keep_their_links(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(rng, base, int(e)) for e in rng.integers(1, 9, 250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(spark, docs).collect()}
    want = set(first_of_each(texts))
    assert want <= kept and len(kept) <= len(want) + 2


def test_minima_agree_as_often_as_sets_are_similar():
    text = [" ".join(f"w{i}" for i in range(a, a + 1000)) for a in (0, 110)]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    h, at = copies.shingles(data, np.array([0, len(text[0].encode()), len(data)]))
    _, _, brief = copies.signatures(h, at)
    assert abs((brief[0] == brief[1]).mean() - 0.8) < 0.15


def test_rows_without_an_id(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base, "a"), (7, base + " end", "b"), (None, "other text of six words here", "d"), (None, "Other  text of six words here", "c"), (None, "other text of six words here", "e"), (None, None, "f"), (None, "", "g"), (8, "something else", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = simhash.deduplicated(spark, docs)
    assert out.columns == docs.columns
    # One of f and g (null comes first), and the first text by bytes of c, d and e.
    assert sorted(r.source for r in out.collect()) == ["b", "c", "f", "h"]
