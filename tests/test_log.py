"""The record log as a stream: nothing lost or doubled across batches, segments and restarts."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest

from skytally.sources import log
from skytally.streaming import tables

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def records(partition: int, first: int, n: int):
    head = lambda i: [{"key": k, "value": v.encode()} for k, v in (("tenant", "t"), ("device", f"d{partition}"), ("msgId", "33"), ("seq", str(i)))]
    return [(b"k", f"{partition}/{i}".encode(), head(i), AT) for i in range(first, first + n)]


def run(spark, tmp_path, **options):
    stream = spark.readStream.format("recordlog").options(**options).load(f"{tmp_path}/log")
    out = tables.envelopes(stream).select("device_id", "sequence", "message_id", "payload", "received_at_nanos", "undecodable")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    return sizes


def test_envelopes_from_the_log_across_restarts(spark, tmp_path):
    log.register(spark)
    path, want = f"{tmp_path}/log", []

    def add(partition: int, n: int):
        first = sum(p == partition for p, _ in want)
        assert log.append(path, partition, records(partition, first, n)) == first
        want.extend((partition, i) for i in range(first, first + n))

    add(0, 7), add(0, 5), add(1, 4)
    bounded = {"maxRecordsPerBatch": 6, "positions": f"{tmp_path}/positions"}
    sizes = run(spark, tmp_path, **bounded)
    assert sum(sizes) == 16 and max(sizes) <= 6 and len(sizes) >= 3
    add(0, 3), add(2, 2), add(0, 0), add(1, 1)  # a partition that was not there before, and a segment without records
    sizes = run(spark, tmp_path, **bounded)
    assert sum(sizes) == 6 and max(sizes) <= 12
    assert run(spark, tmp_path) == []
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((int(r.device_id[1:]), r.sequence) for r in rows) == sorted(want)
    assert all(bytes(r.payload) == f"{r.device_id[1:]}/{r.sequence}".encode() and r.message_id == 33 and not r.undecodable for r in rows)
    assert {r.received_at_nanos for r in rows} == {int(AT.timestamp()) * 10**9}


def test_latest_begins_with_what_comes_after_the_start(spark, tmp_path):
    log.register(spark)
    log.append(f"{tmp_path}/log", 0, records(0, 0, 5))
    stream = spark.readStream.format("recordlog").option("startingOffsets", "latest").load(f"{tmp_path}/log")
    query = stream.writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    log.append(f"{tmp_path}/log", 0, records(0, 5, 3))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.partition, r.offset) for r in spark.table("late").collect()) == [(0, 5), (0, 6), (0, 7)]


def test_options_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        log.Reader({"path": str(tmp_path), "startingoffsets": "12"})
