"""Rolling windows: of more samples than any cap, and capped ones against brute force."""

from __future__ import annotations

import duckdb
import pytest

from skytally.plans import catalogue

from test_catalogue import rows


@pytest.mark.parametrize("name", ["rolling_stats", "trend_slope", "derived_metrics_long"])
def test_crowded_series_equals_sql(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 100) AS ts, 0::BIGINT AS user_id, 'click' AS event_type, ((i * 7919) % 1000) / 10.0::DOUBLE AS value FROM range(1200) t(i)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
    if "n" in got:
        assert got["n"].max() == 865


def test_capped_windows_equal_brute_force_across_batches(spark):
    import random
    from datetime import datetime, timedelta, timezone

    import numpy as np

    from skytally.operators import windows

    rng = random.Random(3)
    data = []
    for device in "ab":
        at = 0
        for _ in range(400):
            at += rng.choice((0, 0, 1, 5, 300))
            data.append((datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=at), "t", device, "m", rng.uniform(-5, 5)))
    rng.shuffle(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = windows.rolling(spark.createDataFrame(data, "time timestamp, tenant_id string, device_id string, metric string, value double"), 900, 16, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(data)
    by = {(r.device_id, r.time.timestamp(), r.value): r for r in got}
    for device in "ab":
        series = sorted((t.timestamp(), v) for t, _, d, _, v in data if d == device)
        for i, (t, v) in enumerate(series):
            w = [(a, b) for a, b in series[max(0, i - 15) : i + 1] if a >= t - 900]
            ts, vs = np.array([a - t for a, _ in w]), np.array([b for _, b in w])
            r = by[device, t, v]
            assert (r.n, r.min, r.max) == (len(w), vs.min(), vs.max())
            assert (r.mean, r.stddev) == (pytest.approx(vs.mean()), pytest.approx(vs.std()))
            spread = ((ts - ts.mean()) ** 2).sum()
            assert r.slope_per_min == (None if len(w) < 4 else pytest.approx(60 * ((ts - ts.mean()) * (vs - vs.mean())).sum() / spread if spread else 0.0))
