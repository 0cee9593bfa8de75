"""Trend alerts whose slope lies exactly between two printed ones."""

from __future__ import annotations

import math

import duckdb
import pytest

from skytally.plans import catalogue
from skytally.rules import window

from test_catalogue import rows

#: Eight values ten minutes apart; the slopes are 0.0275, 0.0385 and 0.0695 a minute.
HALVES = [
    [19.56, 3.82, 0.92, 1.13, 16.57, 12.23, 0.47, 18.2],
    [5.28, 4.9, 14.38, 19.69, 5.72, 11.68, 17.91, 3.76],
    [0.17, 12.2, 17.5, 16.95, 11.7, 11.51, 19.7, 6.47],
]


def test_alerts_at_exact_halves_equal_sql(spark, tmp_path):
    values = ", ".join(f"({8 * u + i}::BIGINT, TIMESTAMP '2024-01-01' + to_seconds({600 * i}), {u}::BIGINT, 'click', {v}::DOUBLE)" for u, vs in enumerate(HALVES) for i, v in enumerate(vs))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = catalogue.queries()["alerts_trend"](spark, str(tmp_path)).toPandas()
    assert len(got) == 3
    assert rows(got) == rows(con.execute(catalogue.oracle_sql()["alerts_trend"]).df())


def test_slopes_of_equal_and_of_endless_values():
    assert window.stats([(i * window.SECOND, 29.27) for i in range(64)]).slope_per_min == 0.0
    assert math.isnan(window.stats([(0, 1.0), (window.SECOND, math.inf), (2 * window.SECOND, 1.0)]).slope_per_min)
    assert window.stats([(i * window.SECOND, 2.0 * i) for i in range(10)]).slope_per_min == pytest.approx(120.0)
