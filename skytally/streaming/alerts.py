"""Alert rules over a stream: the batch fold with its state kept per device by Structured Streaming.

A group is a shard of the fleet. Its state, in RocksDB, is a map with an entry for each device (observation, the windows of
watched metrics, the states of its rules) and one value for the shard: its newest record, how many it consumed and when it
last ticked. A batch reads and writes the entries of the devices that it has records of. Records are folded in order of
arrival. Every ``tick_s`` seconds a shard's devices are judged by the clock, in batches with data as well as, by a
processing-time timer, without, so that telemetry loss is noticed; the moved clock is not kept, and only devices whose rules
changed are written.

A catching-up stream must not raise silence alerts for records that only wait in the backlog: where a shard has consumed
records since its last tick and its newest one is older than ``catch_up_s``, the tick is left out, for all its devices.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skytally.rules import window
from skytally.rules.batch import NAMES, Fold
from skytally.rules.fsm import State
from skytally.rules.model import Observation, Rule
from skytally.schema import ALERT
from skytally.session import on_rocksdb, ship_package

SECOND = 1_000_000_000


def fold_group(fold: Fold, rows: pd.DataFrame) -> list:
    """Feeds a device's rows, sorted by arrival, to its fold."""
    out = []
    for metric, value, at in zip(rows["metric"], rows["value"], rows["time_ns"], strict=True):
        known = isinstance(metric, str)
        out += fold.record(int(at), {metric: float(value)} if known else {})
    return out


class Shard:
    """The devices of a shard and what its ticks go by."""

    def __init__(self, rules: list[Rule], span_ns: int, capacity: int, min_samples: int, now: int) -> None:
        self.make = lambda device: Fold(rules, *device, span_ns, capacity, min_samples)
        self.devices: dict[tuple[str, str], Fold] = {}
        self.newest, self.consumed, self.ticked = 0, 0, now

    @classmethod
    def load(cls, data: tuple, rules: list[Rule], span_ns: int, capacity: int, min_samples: int) -> Shard:
        devices, newest, consumed, ticked = data
        shard = cls(rules, span_ns, capacity, min_samples, ticked)
        shard.newest, shard.consumed = newest, consumed
        shard.devices = {d: restore(shard.make(d), entry) for d, entry in devices.items()}
        return shard

    def dump(self) -> tuple:
        return {d: entry_of(f) for d, f in self.devices.items()}, self.newest, self.consumed, self.ticked

    def records(self, device: tuple[str, str], rows: pd.DataFrame) -> list:
        if device not in self.devices:
            self.devices[device] = self.make(device)
        self.consumed += len(rows)
        self.newest = max(self.newest, int(rows["time_ns"].max()))
        return fold_group(self.devices[device], rows)

    def tick(self, now: int, catch_up_s: float) -> list:
        consumed, self.consumed, self.ticked = self.consumed, 0, now
        if consumed and now - self.newest > catch_up_s * SECOND:
            return []
        return [a for fold in self.devices.values() for a in fold.tick(now)]


#: A device's entry.
DEVICE = "last_seen bigint, at bigint, metrics map<string,double>, windows map<string,array<struct<t:bigint,v:double>>>, states map<string,struct<phase:string,since:bigint,onset:bigint>>"


def entry_of(fold: Fold) -> tuple:
    """A device's fold as its entry."""
    o = fold.observation
    windows = {m: [tuple(s) for s in w] for m, w in fold.windows.items()}
    return o.last_seen, o.at, dict(o.metrics), windows, {k: tuple(s) for k, s in fold.states.items()}


def restore(fold: Fold, entry: tuple) -> Fold:
    last_seen, at, metrics, windows, states = entry
    fold.observation = Observation(fold.tenant, fold.device, dict(metrics or {}), last_seen, at)
    fold.windows = {m: [(s[0], s[1]) for s in w] for m, w in (windows or {}).items()}
    fold.states = {k: State(*s) for k, s in (states or {}).items()}
    return fold


class Devices(StatefulProcessor):
    """One shard of the fleet."""

    def __init__(self, rules: list[Rule], limits: tuple[int, int, int], tick_s: float, catch_up_s: float, clock: Callable[[], int]):
        self.rules, self.limits, self.tick_s, self.catch_up_s, self.clock = rules, limits, tick_s, catch_up_s, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("devices", "tenant_id string, device_id string", DEVICE)
        self.totals = handle.getValueState("shard", "newest bigint, consumed bigint, ticked bigint")

    def _shard(self) -> Shard:
        shard = Shard(self.rules, *self.limits, self.clock())
        if self.totals.exists():
            shard.newest, shard.consumed, shard.ticked = self.totals.get()
        return shard

    def _ticked(self, shard: Shard, touched: set) -> list:
        """A tick of the whole shard. Devices whose rules it changed are touched by it."""
        for device, entry in self.entries.iterator():
            if tuple(device) not in shard.devices:
                shard.devices[tuple(device)] = restore(shard.make(tuple(device)), entry)
        before = {d: dict(f.states) for d, f in shard.devices.items()}
        out = shard.tick(self.clock(), self.catch_up_s)
        touched |= {d for d, f in shard.devices.items() if f.states != before[d]}
        return out

    def _close(self, shard: Shard, touched: set, out: list) -> Iterator[pd.DataFrame]:
        for device in touched:
            self.entries.updateValue(device, entry_of(shard.devices[device]))
        self.totals.update((shard.newest, shard.consumed, shard.ticked))
        if out:
            yield pd.DataFrame([astuple(a) for a in out], columns=NAMES)

    def _again(self, timers) -> None:
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + max(1, int(self.tick_s * 1000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.totals.exists():
            self._again(timerValues)
        shard, out, touched = self._shard(), [], set()
        for device, own in pd.concat(list(rows)).sort_values("arrival", kind="stable").groupby(["tenant_id", "device_id"], sort=False):
            if self.entries.containsKey(device):
                shard.devices[device] = restore(shard.make(device), self.entries.getValue(device))
            out += shard.records(device, own)
            touched.add(device)
        if self.clock() - shard.ticked >= self.tick_s * SECOND:
            out += self._ticked(shard, touched)
        yield from self._close(shard, touched, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._again(timerValues)
        shard, touched = self._shard(), set()
        out = self._ticked(shard, touched)
        yield from self._close(shard, touched, out)

    def close(self) -> None:
        pass


def live_alerts(
    spark: SparkSession,
    telemetry: DataFrame,
    rules: list[Rule],
    tick_s: float = 1.0,
    catch_up_s: float = 60.0,
    span_ns: int = window.SPAN_NS,
    capacity: int = window.CAPACITY,
    min_samples: int = window.MIN_SAMPLES,
    clock: Callable[[], int] = time.time_ns,
    shards: int = 64,
) -> DataFrame:
    """Alerts of a stream of measurements (tenant_id, device_id, metric, value, time_ns, arrival), in update mode.

    A null metric is a record without measurements: the device is alive. Rows with a null tenant or device are dropped. A tick
    reads a whole shard: take so many shards that each has some thousands of devices. The number must not change between runs
    from one checkpoint. Puts the session's new streams on RocksDB, unless it names a state store itself.
    """
    ship_package(spark)
    on_rocksdb(spark)
    rows = telemetry.where(F.col("tenant_id").isNotNull() & F.col("device_id").isNotNull())
    shard = F.pmod(F.xxhash64("tenant_id", "device_id"), F.lit(shards)).alias("shard")
    rows = rows.select(shard, "tenant_id", "device_id", "metric", "value", "time_ns", "arrival")
    return rows.groupBy("shard").transformWithStateInPandas(Devices(rules, (span_ns, capacity, min_samples), tick_s, catch_up_s, clock), ALERT, "update", "ProcessingTime")
