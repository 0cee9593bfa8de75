"""Fingerprints and components against brute force."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
import xxhash

from skytally.llm import copies, simhash
from skytally.llm.components import stars


def fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes: list[int], distance: int = 3) -> list[int]:
    """The index of the first code of each one's component."""
    root = list(range(len(codes)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


BASE = " ".join(f"word{i * 7 % 83}" for i in range(300))
TEXTS = [BASE, BASE, BASE.replace("word7 ", "other ", 1), BASE.upper(), "", None, "one", "one two", "A b\tc\x0bd e", "a B c d  e", "é ü   x", "\n\n", BASE + " tail", "x " * 50_000]


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = [(i, t, "fp", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, docs).collect()}
    codes = [fingerprint(t) for t in TEXTS]
    assert [got[i].fp % (1 << 64) for i in range(len(TEXTS))] == codes
    assert [got[i].component_id for i in range(len(TEXTS))] == components(codes)


def test_index_loses_no_link_even_with_tiny_nodes(spark):
    rng = np.random.default_rng(1)
    codes = set()
    for _ in range(40):
        center = int(rng.integers(0, 1 << 63))
        for _ in range(6):
            center ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            codes.add(center)
    # A crowded corner: all codes with few bits, so that nodes must be refined.
    codes |= {sum(1 << int(b) for b in rng.choice(10, rng.integers(0, 6), replace=False)) for _ in range(200)}
    codes = sorted(codes)
    table = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark, table, leaf=16).collect()]
    assert all((a in codes) and (b in codes) for a, b in edges)
    index = {c: i for i, c in enumerate(codes)}
    root = list(range(len(codes)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(index[a]), find(index[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(codes))] == components(codes)


def test_a_hundred_thousand_near_fingerprints(spark):
    rng = np.random.default_rng(8)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (110_000, 5)).astype(np.uint64), axis=1)
    codes = np.unique(flips ^ np.uint64(0x5DEECE66D1234567))[:100_000]
    far = np.array([0x0F0F0F0F0F0F0F0F, 0xFFFF0000FFFF0000], np.uint64)  # linked to nothing
    table = spark.createDataFrame([(int(c),) for c in np.concatenate([codes, far]).view(np.int64)], "fp long")
    edges = stars(spark, simhash.links(spark, table.repartition(8))).collect()
    assert len({r.b for r in edges}) == 1 and len(edges) >= 0.999 * len(codes)
    assert not {r.a for r in edges} & set(far.view(np.int64).tolist())


def test_masks_meet_every_pair():
    rng = np.random.default_rng(9)
    table = np.array(simhash.masks(0, 21, 3), np.uint64)
    assert len(table) == 1330 and min(int(m).bit_count() for m in table) >= 54
    for _ in range(50):
        difference = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert ((table & np.uint64(difference)) == 0).any()


def test_strays_of_a_dense_node_cost_rows_of_their_own_only(spark, monkeypatch):
    """A chain-linked cluster in one crowded node, and codes in it that are 3 or 4 bits from the cluster's members only."""
    rng = np.random.default_rng(4)
    cluster = {sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 9), replace=False)) for _ in range(3000)}
    strays = [0b111 << 40 | 0x1, 0b1111 << 44 | 0x3, 0b111 << 50 | 0x155, 0b11111 << 30]
    codes = sorted(cluster | set(strays))
    made, ball = [], simhash._ball
    monkeypatch.setattr(simhash, "_ball", lambda rows, radius: made.append((rows.count(), radius)) or ball(rows, radius))
    table = spark.createDataFrame([(c,) for c in codes], "fp long")
    root = {r.a: r.b for r in stars(spark, simhash.links(spark, table, leaf=64)).collect()}
    got, want = [root.get(c, c) for c in codes], components(codes)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) > 1
    assert made and sum(n * sum(math.comb(64, r) for r in range(radius + 1)) for n, radius in made) < 1330 * len(codes) / 4


def test_gray_rank_is_the_position_in_the_gray_sequence():
    positions = np.arange(64, dtype=np.uint64)
    assert (copies.gray_rank(positions ^ (positions >> np.uint64(1))) == positions).all()


@pytest.mark.parametrize("rows", [[], [(None, "a b c d", "s"), (3, "a b c d", None), (3, "a b c d", "t")]])
def test_stage_keeps_whole_ids_and_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = simhash.deduplicated(spark, docs)
    assert out.columns == docs.columns
    assert out.where("doc_id = 3").count() == (2 if rows else 0)
