"""Rules over history: every device's records folded in order of arrival, one partition per device, as a stream of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.rules import fsm, window
from skytally.rules.model import Observation, Rule
from skytally.schema import ALERT
from skytally.session import ship_package

NAMES = [part.split()[0] for part in ALERT.split(", ")]


class Fold:
    """The state of one device: observation, windows of the metrics that rules watch, and alert states."""

    def __init__(self, rules: list[Rule], tenant: str, device: str, span_ns: int = window.SPAN_NS, capacity: int = window.CAPACITY, min_samples: int = window.MIN_SAMPLES) -> None:
        self.rules = [r for r in rules if r.applies_to(tenant, device)]
        self.watched = window.windowed_metrics(self.rules)
        self.limits = (span_ns, capacity)
        self.min_samples = min_samples
        self.observation: Observation | None = None
        self.tenant, self.device = tenant, device
        self.windows: dict[str, list[tuple[int, float]]] = {}
        self.states: dict[str, fsm.State] = {}
        self.derived: dict[str, dict[str, float]] = {}

    def record(self, at: int, metrics: dict[str, float]) -> list:
        """One record; a record without metrics still tells that the device is alive."""
        updates = dict(metrics)
        for name in self.watched:
            if name in metrics:
                self.windows[name] = window.add(self.windows.get(name, []), at, metrics[name], *self.limits)
                self.derived.pop(name, None)
        for name, samples in self.windows.items():
            if name not in self.derived:  # only where the window has changed
                self.derived[name] = window.derived(name, window.stats(samples), self.min_samples)
            updates |= self.derived[name]
        before = self.observation or Observation(self.tenant, self.device, {}, at, at)
        self.observation = before.with_all(updates, at)
        return fsm.observe(self.rules, self.states, self.observation)

    def tick(self, now: int) -> list:
        """What the passing of time alone changes; the moved clock is not kept."""
        return fsm.observe(self.rules, self.states, self.observation.as_of(now)) if self.observation else []


def alerts(spark: SparkSession, telemetry: DataFrame, rules: list[Rule], arrival: str, span_ns: int = window.SPAN_NS, capacity: int = window.CAPACITY, min_samples: int = window.MIN_SAMPLES) -> DataFrame:
    """All alerts of all rules. telemetry: tenant_id, device_id, metric, value, time_ns and the arrival order.

    The fold depends on its own past, so a device's rows meet in one partition, sorted; they pass through it row by row and
    only the device's current state is held. Devices that no rule applies to are left out before the shuffle.
    """
    ship_package(spark)
    applies = F.lit(False)
    for tenant, device in sorted({(r.tenant_id, r.device_id) for r in rules}):
        one = F.col("tenant_id") == tenant
        applies = applies | (one if device == "*" else one & (F.col("device_id") == device))
    telemetry = telemetry.where(applies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            out = []
            for tenant, device, metric, value, at in zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "device_id", "metric", "value", "time_ns")), strict=True):
                if fold is None or (fold.tenant, fold.device) != (tenant, device):
                    fold = Fold(rules, tenant, device, span_ns, capacity, min_samples)
                out += map(astuple, fold.record(at, {} if metric is None else {metric: value}))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for a in out], pa.int64() if n.endswith("_ns") else pa.string()) for i, n in enumerate(NAMES)], NAMES)

    rows = telemetry.select("tenant_id", "device_id", "metric", "value", "time_ns", arrival)
    return rows.repartition("tenant_id", "device_id").sortWithinPartitions("tenant_id", "device_id", arrival).mapInArrow(run, ALERT)
