"""The alert state machine, conditions and windows: boundaries to the nanosecond."""

from __future__ import annotations

import math

import pytest

from skytally.rules import fsm, window
from skytally.rules.model import SECOND, Geofence, Observation, Rule, Staleness, Threshold, haversine_m, iso_duration

LOW = Threshold("battery", "BELOW", 20.0, 30.0)


def rule(condition=LOW, for_ns: int = 10 * SECOND, clear_ns: int = 5 * SECOND, device: str = "*") -> Rule:
    return Rule("r", "Low battery", "t", device, "WARNING", condition, for_ns, clear_ns)


def at(now: int, value: float | None) -> Observation:
    return Observation("t", "d", {} if value is None else {"battery": value}, now, now)


def run(r: Rule, samples: list[tuple[int, float | None]]) -> list[tuple[str, str | None]]:
    state, out = None, []
    for now, value in samples:
        state, alert = fsm.step(r, state, at(now, value))
        out.append((state.phase, alert.kind if alert else None))
    return out


def test_debounce_is_inclusive_on_both_sides():
    s = SECOND
    assert run(rule(), [(0, 10), (10 * s - 1, 10), (10 * s, 10), (11 * s, 50), (16 * s - 1, 50), (16 * s, 50)]) == [("PENDING", None), ("PENDING", None), ("FIRING", "FIRED"), ("RESOLVING", None), ("RESOLVING", None), ("INACTIVE", "RESOLVED")]


def test_hysteresis_and_relapse_keep_one_fault():
    s = SECOND
    assert run(rule(for_ns=0), [(0, 19), (1 * s, 25), (2 * s, 30), (3 * s, 25), (4 * s, 31), (9 * s, 31)]) == [("FIRING", "FIRED"), ("FIRING", None), ("RESOLVING", None), ("FIRING", None), ("RESOLVING", None), ("INACTIVE", "RESOLVED")]


def test_pending_that_recovers_is_silent():
    assert run(rule(), [(0, 10), (1, 40), (2, 10)]) == [("PENDING", None), ("INACTIVE", None), ("PENDING", None)]


@pytest.mark.parametrize("value", [None, math.nan, 20.0])
def test_missing_nan_and_equal_values_do_not_breach(value):
    assert not LOW.holds(at(0, value), False)
    assert not Threshold("battery", "ABOVE", 20.0, 10.0).holds(at(0, value), False)


def test_staleness_is_strict():
    c = Staleness(20 * SECOND)
    o = at(0, 1.0)
    assert not c.holds(o.as_of(20 * SECOND), False) and c.holds(o.as_of(20 * SECOND + 1), False)
    assert c.clear_after == 10 * SECOND and c.describe(o.as_of(90 * SECOND)) == "silent for PT1M30S (limit PT20S)"


def test_geofence_needs_both_coordinates():
    fence = Geofence(41.0, 29.0, 500.0, 400.0)
    here = Observation("t", "d", {"position.latitude_deg": 41.004})
    assert not fence.holds(here, False)
    assert fence.holds(here.with_all({"position.longitude_deg": 29.006}, 1), False)
    assert haversine_m(0, 0, 0, 180) == pytest.approx(math.pi * 6371008.8)


@pytest.mark.parametrize("bad", [lambda: Threshold("m", "BELOW", 20, 10), lambda: Threshold("m", "ABOVE", 1, 2), lambda: Threshold("m", "ABOVE", math.inf, 2), lambda: Geofence(0, 0, 10, 11), lambda: Staleness(5, 6), lambda: Rule("r", "n", "t", "d", "LOUD", LOW), lambda: window.add([], 0, 1.0, 0), lambda: window.add([], 0, 1.0, 5, 1)])
def test_invalid_rules_are_refused(bad):
    with pytest.raises(ValueError):
        bad()


def test_window_keeps_the_edge_and_sorts_late_samples():
    w = window.add(window.add(window.add([], 0, 1.0, 10), 10, 2.0, 10), 5, 3.0, 10)
    assert w == [(0, 1.0), (5, 3.0), (10, 2.0)]
    assert window.add(w, 11, 4.0, 10) == [(5, 3.0), (10, 2.0), (11, 4.0)]
    assert window.add(w, 10, 9.0, 10, 2) == [(10, 2.0), (10, 9.0)]


def test_stats_of_a_line():
    st = window.stats([(i * SECOND, 2.0 * i) for i in range(10)])
    assert (st.count, st.min, st.max, st.mean) == (10, 0.0, 18.0, 9.0)
    assert st.slope_per_min == pytest.approx(120.0)
    assert window.stats([(5, 1.0), (5, 3.0)]).slope_per_min == 0.0


def test_iso_durations():
    assert [iso_duration(x) for x in (0, SECOND, 90 * SECOND, 3600 * SECOND, SECOND // 2)] == ["PT0S", "PT1S", "PT1M30S", "PT1H", "PT0.5S"]
