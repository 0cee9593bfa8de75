"""Targets, apportionment and the mix."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skytally.llm import mixing


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Water filling by repeated capping."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 50, None: 400}, {"a": 10}, {"z": 5000, "b": 1, "m": 1}, {"a": 0, "b": 10}])
def test_targets_equal_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def highest_quotients(votes: list[float], seats: int) -> list[int]:
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    won = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    return won


def number(*parts: str) -> int:
    return int(hashlib.md5("|".join([mixing.SEED, *parts]).encode()).hexdigest()[:8], 16)


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, size, source, taken): every word of every stream counted one by one."""
    docs = []
    for doc, text, source in rows:
        words, salt = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), zlib.crc32((text or "").encode())
        name = ("" if doc is None else str(doc), str(salt))
        docs.append((source, number("shard", *name) % mixing.LEAST_SHARDS, number("order", *name), doc is not None, doc or 0, salt, words))
    docs.sort(key=lambda d: (d[0] is None, d[0] or "", *d[1:]))
    aims = targets({s: sum(d[6] for d in docs if d[0] == s) for s in {d[0] for d in docs}})
    order = sorted(aims, key=lambda s: (s is None, s or ""))
    streams: dict[tuple, list] = {}
    for d in docs:
        streams.setdefault((d[0], d[1]), []).append(d)
    blocks = {k: max(1, int(sum(d[6] for d in v) / mixing.BLOCK + 0.5)) if any(d[6] for d in v) else 0 for k, v in streams.items()}
    total = {s: sum(b for (x, _), b in blocks.items() if x == s) for s in order}
    size = {s: sum(d[6] for d in docs if d[0] == s) for s in order}
    votes = [aims[s] * total[s] / size[s] if size[s] else 0.0 for s in order]
    seats = dict(zip(order, highest_quotients(votes, int(sum(votes) + 0.5)), strict=True))
    out = []
    for s in order:
        shards = sorted(k[1] for k in streams if k[0] == s)
        for shard, quota in zip(shards, highest_quotients([blocks[s, x] for x in shards], min(seats[s], 2 * total[s])), strict=True):
            b, mine = blocks[s, shard], streams[s, shard]
            words = sum(d[6] for d in mine)
            quota, turn, at = min(quota, 2 * b), number("blocks", "\x00" if s is None else s, str(shard)), 0
            picked = [quota // b + ((i * mixing.PRIME + turn) % b < quota % b) for i in range(b)] if b else []
            for d in mine:
                taken = sum(picked[((w + 1) * b - 1) // words] for w in range(at, at + d[6]))
                at += d[6]
                out.append((d[4] if d[3] else None, d[6], s, taken))
    return sorted(out, key=str)


def test_every_document_takes_what_brute_force_takes(spark):
    rows = [(i, "w " * (1 + i * 37 % 211), ["hot", "hot", "hot", "b", None, "c"][i % 6]) for i in range(400)]
    rows += [(None, "a b c " * 20, "b"), (None, "d e f " * 30, "b"), (None, "d e f " * 30, "b"), (7, "x " * 3000, "c"), (8, None, "c"), (9, "", "empty"), (1, "again", "tiny")]
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r.doc_id, r["size"], r.source, r.taken) for r in got), key=str) == brute(rows)


def test_rows_without_an_id_are_spread(spark):
    rows = spark.range(2000).selectExpr("CAST(NULL AS bigint) AS doc_id", "repeat(concat('w', id, ' '), 10) AS text", "'s' AS source")
    got = mixing.mix(spark, rows).groupBy().agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most")).first()
    assert got.n == 2000 and got.taken == pytest.approx(30_000, rel=0.01) and got.most <= 20


def test_apportionment_gives_the_highest_quotients(spark):
    votes = [5300, 2400, 2300, 11, 0, 700, 3]
    for seats in (0, 1, 7, 50, 9999):
        won = highest_quotients(votes, seats)
        df = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)], "g string, i long, v long, s long")
        assert {r.i: r.quota for r in mixing.apportion(df, ["g"], "v", "s", ["i"]).collect()} == dict(enumerate(won))


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 37 % 211), ["hot", "hot", "hot", "b", None][i % 5], "extra") for i in range(900)]
    rows += [(1000, None, "hot", ""), (1001, "", None, ""), (1002, "x " * 20_000, "b", ""), (1003, "q", "b", ""), (1003, "q", "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, blocks string")
    first, again = (sorted(map(tuple, mixing.mix(spark, d).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(rows)
    assert all(0 <= r[5] <= 2 * r[2] for r in first)
    assert [r[2] for r in first if r[0] in (1000, 1001)] == [0, 0]
    for source in ("hot", "b", None):
        mine = [r for r in first if r[1] == source]
        assert sum(r[5] for r in mine) == pytest.approx(mine[0][4], rel=0.02)


def test_empty_table(spark):
    assert mixing.mix(spark, spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
