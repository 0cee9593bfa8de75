"""Whole rolling windows: work that doesn't grow with the window, and odd samples against brute force."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from skytally.operators import windows
from skytally.plans import catalogue


@pytest.mark.parametrize("name", ["rolling_stats", "trend_slope", "derived_metrics_long"])
def test_frames_only_run_on(spark, tiny, name):
    """A frame with a moving beginning is computed anew at each sample."""
    plan = catalogue.queries()[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    frames = [f.split(")")[0] for f in plan.split("specifiedwindowframe(")[1:]]
    assert frames and all("unboundedpreceding" in f for f in frames)


def test_odd_samples_equal_brute_force(spark):
    rng, span = random.Random(11), 900
    data = []
    for device in "ab":
        at = -5000
        for _ in range(300):
            at += rng.choice((0, 0, 1, 5, 100, 450, 900, 901, 3000))
            value = rng.choice((None, math.nan, 7.0, 7.0, rng.uniform(-5, 5), rng.uniform(-5, 5)) if device == "b" else (rng.uniform(-5, 5),))
            data.append((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=at), "t", device, "m", value))
        data += [(None, "t", device, "m", v) for v in (1.0, 4.0)]
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "time timestamp, tenant_id string, device_id string, metric string, value double")
    got = windows.rolling_whole(rows, span, 4).collect()
    key = lambda d, t, v: (d, t and t.timestamp(), repr(v))
    by = {key(r.device_id, r.time, r.value): r for r in got}
    assert len(got) == len(data)
    for t, _, d, _, v in data:
        r = by[key(d, t, v)]
        if t is None:
            assert (r.n, r.min, r.max, r.mean, r.stddev, r.slope_per_min) == (2, 1.0, 4.0, 2.5, 1.5, None)
            continue
        w = [((a - t).total_seconds(), b) for a, _, e, _, b in data if e == d and a and 0 <= (t - a).total_seconds() <= span]
        assert r.n == len(w)
        known = [(a, b) for a, b in w if b is not None]
        if not known:
            assert (r.min, r.max, r.mean, r.stddev) == (None,) * 4
        elif any(math.isnan(b) for _, b in known):
            assert math.isnan(r.mean) and math.isnan(r.stddev) and math.isnan(r.max)
        else:
            ts, vs = np.array([a for a, _ in known]), np.array([b for _, b in known])
            assert (r.min, r.max) == (vs.min(), vs.max())
            assert (r.mean, r.stddev) == (pytest.approx(vs.mean()), pytest.approx(vs.std(), abs=1e-12))
            spread = ((ts - ts.mean()) ** 2).sum()
            assert r.slope_per_min == (None if len(w) < 4 else pytest.approx(60 * ((ts - ts.mean()) * (vs - vs.mean())).sum() / spread if spread else 0.0, abs=1e-9))
