"""Scanned alerts against the fold, record by record."""

from __future__ import annotations

import random

import pytest

from skytally.rules.batch import alerts
from skytally.rules.model import Geofence, Rule, Staleness, Threshold
from skytally.rules.scan import threshold_alerts

SCHEMA = "tenant_id string, device_id string, metric string, value double, time_ns long, arrival long"
RULES = [
    Rule("low", "Low", "t", "*", "WARNING", Threshold("m", "BELOW", 20.0, 30.0), 5, 3),
    Rule("high", "High", "t", "hot", "CRITICAL", Threshold("m", "ABOVE", 70.0, 60.0), 0, 8),
    Rule("other", "Other", "t", "*", "INFO", Threshold("n", "BELOW", 50.0, 50.0), 7, 0),
    Rule("none", "None", "u", "*", "INFO", Threshold("m", "BELOW", 50.0, 50.0)),
]


@pytest.mark.parametrize("ranges", (1, 16))
def test_scan_equals_the_fold_with_a_hot_device(spark, ranges):
    rng = random.Random(7)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice((0, 1, 1, 2, 9, -4))
        device = "hot" if i % 2 else f"d{rng.randrange(12)}"
        metric = rng.choice(("m", "m", "m", "n", None))
        value = None if metric is None or rng.random() < 0.02 else float("nan") if rng.random() < 0.02 else rng.choice((10.0, 10.0, 25.0, 45.0, 65.0, 80.0, rng.uniform(0, 100)))
        rows.append(("t" if i % 7 else "v", device, metric, value, at, i))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(repr, map(tuple, threshold_alerts(spark, df, RULES, "arrival", ranges).collect())))
    want = sorted(map(repr, map(tuple, alerts(spark, df, RULES, "arrival").collect())))
    assert got == want and len(got) > 100


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert threshold_alerts(spark, empty, RULES, "arrival").count() == threshold_alerts(spark, empty, RULES, "arrival", 4).count() == 0
    for condition in (Geofence(1.0, 1.0, 5.0, 5.0), Staleness(5), Threshold("m#mean", "BELOW", 1.0, 1.0)):
        with pytest.raises(ValueError):
            threshold_alerts(spark, empty, [Rule("r", "n", "t", "*", "INFO", condition)], "arrival")
