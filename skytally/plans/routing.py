"""Which relation answers a range query: the coarsest whose resolution still resolves the buckets asked for."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

MINUTE_S, HOUR_S = 60, 3600
DEFAULT_POINTS, MOST_POINTS = 500, 5000


class Route(NamedTuple):
    source: str  # RAW, MINUTE or HOUR
    bucket_s: int


def bucket_seconds(span_s: float, points: int) -> int:
    return max(1, int(span_s // max(1, points)))


def resolution(bucket_s: int) -> str:
    return "HOUR" if bucket_s >= HOUR_S else "MINUTE" if bucket_s >= MINUTE_S else "RAW"


def route(start: datetime, end: datetime, points: int = DEFAULT_POINTS) -> Route:
    """The point budget is clamped to 1..5000; an empty or reversed range is an error."""
    if end <= start:
        raise ValueError("the end must lie after the start")
    bucket = bucket_seconds((end - start).total_seconds(), min(max(points, 1), MOST_POINTS))
    return Route(resolution(bucket), bucket)
