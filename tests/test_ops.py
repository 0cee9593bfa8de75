"""Settlement, duplicates and percentiles against plain loops."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.operators import ops

T = datetime(2024, 1, 1)


def settle(acks: list[tuple], commands: list[tuple]) -> dict[int, str | None]:
    """One answer after the other, each closing the oldest command that is open then."""
    open_ = sorted((c for c in commands if c[4] in ops.OPEN_STATES), key=lambda c: (c[5], c[0]))
    out = {}
    for a in sorted(acks, key=lambda a: (a[5], a[0])):
        hit = next((c for c in open_ if c[1:4] == a[1:4] and c[5] <= a[5]), None)
        out[a[0]] = hit and hit[0]
        if hit:
            open_.remove(hit)
    return out


def test_an_answer_settles_one_command_and_closes_it(spark):
    rng = np.random.default_rng(2)
    at = lambda: T + timedelta(seconds=int(rng.integers(0, 60)))
    commands = [(f"c{i:03d}", "t", f"d{i % 3}", 400 + i % 2, ["PENDING", "SENT", "ACKED"][i % 3 if i % 5 else 0], at()) for i in range(60)]
    acks = [(i, "t", f"d{i % 3}", 400 + i % 2, i % 3, at()) for i in range(80)]
    a = spark.createDataFrame(acks, "ack_id long, tenant_id string, device_id string, mav_command_id int, result int, at timestamp")
    c = spark.createDataFrame(commands, "id string, tenant_id string, device_id string, mav_command_id int, state string, created_at timestamp")
    got = ops.ack_match(a, c).collect()
    assert {r.ack_id: r.command_id for r in got} == settle(acks, commands)
    settled = [r.command_id for r in got if r.command_id]
    assert len(settled) == len(set(settled)) and 0 < len(settled) < len(acks)
    assert all((r.new_state is None) == (r.command_id is None) for r in got)
    stats = ops.ack_stats(ops.ack_match(a, c), spark.range(4000)).first()
    assert (stats.records_seen, stats.acks_seen, stats.commands_settled, stats.unmatched, stats.ack_ratio) == (4000, 80, len(settled), 80 - len(settled), 0.02)


def test_the_second_answer_finds_nothing_left(spark):
    c = spark.createDataFrame([("c1", "t", "d", 400, "SENT", T)], "id string, tenant_id string, device_id string, mav_command_id int, state string, created_at timestamp")
    acks = [(1, "t", "d", 400, 0, T), (2, "t", "d", 400, 4, T + timedelta(seconds=1)), (3, "t", "other", 400, 0, T)]
    a = spark.createDataFrame(acks, "ack_id long, tenant_id string, device_id string, mav_command_id int, result int, at timestamp")
    assert {r.ack_id: (r.command_id, r.new_state) for r in ops.ack_match(a, c).collect()} == {1: ("c1", "ACKED"), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize("hot", [False, True])
def test_duplicates_equal_a_loop(spark, hot):
    rng = np.random.default_rng(3)
    n = 30_000 if hot else 3000
    rows = [(i, None if i % 50 == 0 else f"k{0 if hot and i % 3 else int(rng.integers(0, 40))}", int(rng.integers(0, 100_000)), i % 17 == 0) for i in range(n)]
    rows += [(n, "null time", None, False), (n + 1, "null time", None, False)]
    df = spark.createDataFrame(rows, "arrival long, k string, ns long, e boolean").repartition(5)
    got = {r.arrival: r.suppressed for r in ops.dedup(df, ["k"], "ns", 500, "arrival", F.col("e")).collect()}
    passed: dict = {}
    for i, k, ns, exempt in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        ok = exempt or k not in passed or ns - passed[k] >= 500
        assert got[i] == (not ok)
        if ok and not exempt:
            passed[k] = ns
    assert not got[n] and not got[n + 1] and len(got) == len(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "arrival long, k string, ns long")
    assert ops.dedup(df, ["k"], "ns", 500, "arrival").count() == 0
    assert ops.nearest_ranks(df, "k", "ns", {"p50": 0.5}).count() == 0


@pytest.mark.parametrize("range_rows", [7, 1_000_000])
def test_nearest_ranks_equal_sorting_whatever_the_ranges(spark, range_rows):
    rng = np.random.default_rng(5)
    rows = [(None if i % 11 == 0 else f"g{i % 3 if i % 2 else 0}", None if i % 13 == 0 else float(rng.integers(0, 60))) for i in range(500)] + [("one", 4.0), ("none", None)]
    levels = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in ops.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", levels, range_rows).collect()}
    groups = {g for g, v in rows if v is not None}
    assert set(got) == groups
    for g in groups:
        values = sorted(v for h, v in rows if h == g and v is not None)
        for name, q in levels.items():
            assert got[g][name] == values[max(1, int(np.ceil(len(values) * q))) - 1]
        assert got[g]["max"] == values[-1]
