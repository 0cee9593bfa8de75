"""Alert rules as frozen values. Nothing here reads a clock: every instant is an argument, in nanoseconds."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

SEVERITIES = ("INFO", "WARNING", "CRITICAL")
COMPARISONS = ("BELOW", "ABOVE")
EARTH_M = 6371008.8
LATITUDE, LONGITUDE = "position.latitude_deg", "position.longitude_deg"
SECOND = 1_000_000_000


def haversine_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(a)))


def iso_duration(ns: int) -> str:
    """ISO 8601 with hours, minutes and seconds: PT20S, PT1H30M, PT0.5S."""
    if ns == 0:
        return "PT0S"
    seconds, nanos = divmod(abs(ns), SECOND)
    h, m, s = seconds // 3600, seconds % 3600 // 60, seconds % 60
    sign = "-" if ns < 0 else ""
    tail = f"{s}" + (f".{nanos:09d}".rstrip("0") if nanos else "")
    return "PT" + (f"{sign}{h}H" if h else "") + (f"{sign}{m}M" if m else "") + (f"{sign}{tail}S" if s or nanos else "")


@dataclass(frozen=True)
class Observation:
    """The latest value of each metric of a device, when it was last heard, and as of when it is judged."""

    tenant_id: str
    device_id: str
    metrics: dict[str, float] = field(default_factory=dict)
    last_seen: int = 0
    at: int = 0

    def with_all(self, updates: dict[str, float], sample_time: int) -> Observation:
        """Values follow arrival; the two times never go back."""
        return Observation(self.tenant_id, self.device_id, {**self.metrics, **updates}, max(self.last_seen, sample_time), max(self.at, sample_time))

    def as_of(self, now: int) -> Observation:
        return Observation(self.tenant_id, self.device_id, self.metrics, self.last_seen, max(self.at, now))

    @property
    def silence(self) -> int:
        return self.at - self.last_seen


@dataclass(frozen=True)
class Threshold:
    metric: str
    comparison: str
    fire_at: float
    clear_at: float

    def __post_init__(self) -> None:
        if not self.metric:
            raise ValueError("metric must not be blank")
        if self.comparison not in COMPARISONS:
            raise ValueError(f"comparison must be one of {COMPARISONS}")
        if not (math.isfinite(self.fire_at) and math.isfinite(self.clear_at)):
            raise ValueError("thresholds must be finite")
        if self.clear_at < self.fire_at if self.comparison == "BELOW" else self.clear_at > self.fire_at:
            raise ValueError("the clearing threshold must lie on the safe side of the firing one")

    def holds(self, o: Observation, active: bool) -> bool:
        v, bound = o.metrics.get(self.metric), self.clear_at if active else self.fire_at
        return v is not None and (v < bound if self.comparison == "BELOW" else v > bound)

    def describe(self, o: Observation) -> str:
        v = o.metrics.get(self.metric)
        return f"{self.metric} {'no reading' if v is None else f'{v:.3f}'} (threshold {'<' if self.comparison == 'BELOW' else '>'} {self.fire_at:.3f})"


@dataclass(frozen=True)
class Geofence:
    latitude: float
    longitude: float
    radius_m: float
    clear_radius_m: float

    def __post_init__(self) -> None:
        if not (self.radius_m > 0 and 0 < self.clear_radius_m <= self.radius_m):
            raise ValueError("radii must be positive and the clearing one not beyond the firing one")
        if not (-90 <= self.latitude <= 90 and -180 <= self.longitude <= 180):
            raise ValueError("the centre must be a place on earth")

    def distance_m(self, o: Observation) -> float | None:
        lat, lon = o.metrics.get(LATITUDE), o.metrics.get(LONGITUDE)
        return None if lat is None or lon is None else haversine_m(self.latitude, self.longitude, lat, lon)

    def holds(self, o: Observation, active: bool) -> bool:
        d = self.distance_m(o)
        return d is not None and d > (self.clear_radius_m if active else self.radius_m)

    def describe(self, o: Observation) -> str:
        d = self.distance_m(o)
        return f"position unavailable (fence radius {self.radius_m:.0f} m)" if d is None else f"{d:.0f} m from fence centre (radius {self.radius_m:.0f} m)"


@dataclass(frozen=True)
class Staleness:
    max_silence: int
    clear_after: int | None = None

    def __post_init__(self) -> None:
        if self.max_silence <= 0:
            raise ValueError("silence must be positive")
        if self.clear_after is None:
            object.__setattr__(self, "clear_after", self.max_silence // 2)
        if not 0 <= self.clear_after <= self.max_silence:
            raise ValueError("the clearing silence must not exceed the firing one")

    def holds(self, o: Observation, active: bool) -> bool:
        return o.silence > (self.clear_after if active else self.max_silence)

    def describe(self, o: Observation) -> str:
        return f"silent for {iso_duration(o.silence)} (limit {iso_duration(self.max_silence)})"


Condition = Threshold | Geofence | Staleness


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    tenant_id: str
    device_id: str  # "*" for all
    severity: str
    condition: Condition
    for_ns: int = 0
    clear_ns: int = 0

    def __post_init__(self) -> None:
        if not (self.id and self.name and self.tenant_id and self.device_id):
            raise ValueError("rule id, name, tenant and device must not be blank")
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}")
        if self.for_ns < 0 or self.clear_ns < 0:
            raise ValueError("durations must not be negative")

    def applies_to(self, tenant: str, device: str) -> bool:
        return self.tenant_id == tenant and self.device_id in ("*", device)

    def key(self, device: str) -> str:
        return f"{self.id}/{device}"


@dataclass(frozen=True)
class Alert:
    rule_id: str
    rule_name: str
    tenant_id: str
    device_id: str
    severity: str
    kind: str  # FIRED or RESOLVED
    condition_since_ns: int
    at_ns: int
    debounce_ns: int
    detail: str

    @property
    def key(self) -> str:
        return f"{self.rule_id}/{self.device_id}"

    @property
    def detection_latency_ns(self) -> int:
        return self.at_ns - self.condition_since_ns

    @property
    def incidental_latency_ns(self) -> int:
        return max(0, self.detection_latency_ns - self.debounce_ns)
