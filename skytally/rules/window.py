"""Rolling windows of samples, their summaries, and the metrics derived from them."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from typing import NamedTuple

from skytally.rules.model import Rule, Threshold

SECOND = 1_000_000_000
#: Samples that a slope needs at least; span and capacity of a window.
MIN_SAMPLES, SPAN_NS, CAPACITY = 8, 300 * SECOND, 64


class Stats(NamedTuple):
    count: int
    min: float
    max: float
    mean: float
    stddev: float
    slope_per_min: float


EMPTY = Stats(0, 0.0, 0.0, 0.0, 0.0, 0.0)


def add(samples: list[tuple[int, float]], at: int, value: float, span: int = SPAN_NS, capacity: int = CAPACITY) -> list[tuple[int, float]]:
    """The window with one more sample: in order of time, none older than the span before the newest, at most capacity."""
    if span <= 0 or capacity < 2:
        raise ValueError("a window needs a positive span and room for two samples")
    kept = samples.copy()
    insort(kept, (at, value), key=lambda s: s[0])
    return kept[max(0, len(kept) - capacity, bisect_left(kept, kept[-1][0] - span, key=lambda s: s[0])) :]


def _fused(x: float, y: float, z: float) -> float:
    """x * y + z, rounded once; what has no such value (infinities) as the plain operations give it."""
    try:
        return math.fma(x, y, z)
    except (ValueError, OverflowError):
        return x * y + z


def _slope(samples: list[tuple[int, float]]) -> float:
    """Least squares, per second: updated sample by sample from the newest back, the covariance by fused multiply-adds. That
    is the order and the rounding of the rule's SQL, whose slopes often lie exactly between two printed ones."""
    newest = samples[-1][0]
    age = value = both = spread = 0.0
    for n, (t, v) in enumerate(reversed(samples), 1):
        at = (t - newest) / SECOND
        d = at - age
        age += d / n
        value += (v - value) / n
        both = _fused(d, v - value, both)
        spread += (at - age) * d
    return both / n / (spread / n) if spread else 0.0


def stats(samples: list[tuple[int, float]]) -> Stats:
    """Population deviation; a least-squares slope per minute, 0 without spread in time."""
    n = len(samples)
    if not n:
        return EMPTY
    values = [v for _, v in samples]
    mean = sum(values) / n
    slope = 60 * _slope(samples) if samples[0][0] != samples[-1][0] else 0.0
    return Stats(n, min(values), max(values), mean, math.sqrt(sum((v - mean) ** 2 for v in values) / n), slope)


def base_metric(name: str) -> str | None:
    at = name.find("#")
    return name[:at] if at > 0 else None


def windowed_metrics(rules: list[Rule]) -> list[str]:
    """Only the metrics whose derived values some rule reads."""
    names = (base_metric(r.condition.metric) for r in rules if isinstance(r.condition, Threshold))
    return list(dict.fromkeys(n for n in names if n))


def derived(metric: str, s: Stats, min_samples: int = MIN_SAMPLES) -> dict[str, float]:
    """metric#count and, with samples, #mean, #stddev, #min, #max; #slope_per_min only from enough samples on."""
    out = {f"{metric}#count": float(s.count)}
    if s.count:
        out |= {f"{metric}#mean": s.mean, f"{metric}#stddev": s.stddev, f"{metric}#min": s.min, f"{metric}#max": s.max}
        if s.count >= max(2, min_samples):
            out[f"{metric}#slope_per_min"] = s.slope_per_min
    return out
