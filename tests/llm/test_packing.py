"""Packing: pieces against the tokenizer, sequences against the constraints and sequential best-fit."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skytally.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, " ", "a", "é ́x", "   z\u0085y", "it's 's'T don't 12,345", "<|endoftext|>x <|startoftext|>", "ΣΑΣ İI", "漢字テスト " * 30, "x" * 5000, "-" * 3000, "a\x1cb\x00c", "﻿q‍👩‍👩‍👧", "word " * 5000, "NFC: Å Å ﬁ"]


def best_fit(lengths, capacity):
    """How many sequences sequential best-fit takes, longest pieces first."""
    gaps = packing.Gaps()
    n = 0
    for size in sorted(lengths, reverse=True):
        found = gaps.successor(size)
        if found is None:
            n, found = n + 1, (capacity, n)
        gaps.add(found[0] - size, found[1])
    return n


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_registered_query_equals_the_tokenizer(spark, tiny):
    rows = packing.op13_packing(spark, tiny).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.piece] = r
    tokenizer, lengths = Tokenizer.from_file(PATH), []
    for doc, text in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, at, len(one), zlib.crc32(one.tobytes())) for k, at in enumerate(range(0, len(ids), 2048)) for one in [ids[at : at + 2048]]]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for _, r in sorted(by.pop(doc).items())] == want
        lengths += [w[2] for w in want]
    assert not by
    n = check(rows, 2048)
    assert n <= best_fit(lengths, 2048) * 1.01 + 1 and n >= -(-sum(lengths) // 2048)


def test_stretches_are_what_the_tokenizer_makes_of_the_whole(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    stretches, tokenizer = packing.Stretches(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    assert stretches.apart and not packing.Stretches(public_tokenizers.path("byte_bpe_50k.json")).apart
    alphabet = [*"aAzZ09JjÀÐàßÿ÷×ªº \t\n\r\x0b\x0c'.-<>|éÉſİßΣσς́̈  ‍字\x00\x1f\x85", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "'S", "J\u030c", "ing "]
    for text in [t or "" for t in HARD] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(6000)]:
        assert np.frombuffer(stretches.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("kind", ("mixed", "equal", "tiny", "halves", "long"))
def test_as_few_sequences_as_sequential_best_fit(spark, kind):
    rng = random.Random(kind)
    capacity = 512
    lengths = {
        "mixed": [min(capacity, int(rng.lognormvariate(4.5, 1.2)) + 1) for _ in range(4000)],
        "equal": [170] * 1500 + [3] * 1500,
        "tiny": [rng.randint(1, 9) for _ in range(5000)],
        "halves": [rng.choice((255, 256, 257)) for _ in range(2000)],
        "long": [capacity] * 300,
    }[kind]
    pieces = spark.createDataFrame([(i // 3, i % 3, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(spark, pieces, capacity, range_rows=300).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert sorted((r.doc_id, r.piece) for r in rows) == [(i // 3, i % 3) for i in range(len(lengths))]
    assert check(rows, capacity) <= best_fit(lengths, capacity) * 1.02 + 12  # a range may leave one sequence of a band open


def test_promises_go_to_the_nearest_ranges_of_longer_gaps():
    assert packing.promises([(0, 0, 5), (1, 2, 1), (2, 3, 2), (4, 9, 0)]) == [(0, 3, 5, 1), (1, 0, 1, 2), (0, 1, 3, 2), (2, 0, 2, 4), (0, 0, 1, 4)]


def test_edges_and_assembled_sequences(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HARD)], "doc_id int, text string, length int").coalesce(1)
    pieces = packing.token_pieces(docs, PATH, 64, ids=True)
    packed = packing.pack(spark, pieces, 64)
    check(packed.collect(), 64)
    tokenizer = Tokenizer.from_file(PATH)
    whole = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in HARD)
    sequences = packing.assemble(packed, pieces)
    assert sequences.agg(F.sum(F.size("ids"))).first()[0] == whole
    assert sequences.select(F.max(F.size("ids"))).first()[0] <= 64
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c"), (7, "c"), (7, None)], "doc_id long, text string")
    rows = packing.pack(spark, packing.token_pieces(twice, PATH)).collect()
    assert len(rows) == 5 and check(rows, 2048) == 1
    assert packing.pack(spark, packing.token_pieces(docs.limit(0), PATH)).count() == 0
