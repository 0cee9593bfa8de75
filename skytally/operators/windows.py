"""Window-shaped operators: rolling statistics, latest state, hysteresis, silence, sequence gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.schema import SERIES_KEY
from skytally.session import ship_package

DEVICE = ("tenant_id", "device_id")


def rolling(telemetry: DataFrame, span_s: int, capacity: int = 64, min_samples: int = 8) -> DataFrame:
    """For each sample: count, min, max, mean, population deviation and slope per minute of the window that it ends.

    A window is bounded twice: the last ``capacity`` samples of the series, in order of time (equal times: of value), and of
    these only those within the span, its edge included. Slopes need ``min_samples``; without spread in time they are 0. Null
    times come first and see each other only.

    A series' samples pass sorted (with spill) through one task that holds a batch and the ``capacity`` samples before it; the
    windows of a whole batch go forward together, one step back in time after the other.
    """
    if span_s <= 0 or capacity < 2:
        raise ValueError("a window needs a positive span and room for two samples")
    names = ["time", *SERIES_KEY, "value"]
    stats = "n int, min double, max double, mean double, stddev double, slope_per_min double"
    rows = telemetry.select(*names, F.unix_micros(F.col("time").cast("timestamp")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([before, batch] if before else [batch]).combine_chunks()
            old = len(held) - batch.num_rows
            new = np.zeros(len(held), bool)
            for c in SERIES_KEY:
                codes = held.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = True
            t = held.column("_t").fill_null(-(1 << 62)).to_numpy()
            v = held.column("value").fill_null(float("nan")).cast(pa.float64()).to_numpy()
            at = np.arange(old, len(held))
            first = np.maximum.accumulate(np.where(new, np.arange(len(held)), 0))[at]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *_frame_stats(t, v, at, first, span_s * 1_000_000, capacity, max(2, min_samples))], [*names, *(c.split()[0] for c in stats.split(", "))])
            before = held.slice(max(0, len(held) - capacity + 1)).combine_chunks().to_batches()[0] if capacity > 1 else None

    ship_package(telemetry.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in telemetry.select(*names).schema)
    return rows.repartition(*SERIES_KEY).sortWithinPartitions(*SERIES_KEY, "time", "value").mapInArrow(run, f"{schema}, {stats}")


def _frame_stats(t: np.ndarray, v: np.ndarray, at: np.ndarray, first: np.ndarray, span: int, capacity: int, min_samples: int) -> list[pa.Array]:
    """Statistics of the windows that end at places ``at`` of sorted samples and begin at ``first`` at the earliest."""
    n, low, high = np.ones(len(at), np.int64), v[at].copy(), v[at].copy()
    value, age = v[at].copy(), np.zeros(len(at))
    steps: list[tuple[np.ndarray, np.ndarray]] = []  # places of those whose window goes so far back, and how old it is there
    inside = np.arange(len(at))
    for k in range(1, capacity):
        back = at[inside] - k
        inside = inside[back >= first[inside]]
        back = at[inside] - k
        inside = inside[t[back] >= t[at[inside]] - span]
        if not len(inside):
            break
        back = at[inside] - k
        seconds = (t[back] - t[at[inside]]) / 1e6
        steps.append((inside, seconds))
        n[inside] += 1
        low[inside], high[inside] = np.minimum(low[inside], v[back]), np.maximum(high[inside], v[back])
        value[inside] += v[back]
        age[inside] += seconds
    mean, middle = value / n, age / n
    vv, tt, tv = (v[at] - mean) ** 2, middle**2, -middle * (v[at] - mean)
    for k, (some, seconds) in enumerate(steps, 1):
        dv, dt = v[at[some] - k] - mean[some], seconds - middle[some]
        vv[some] += dv * dv
        tt[some] += dt * dt
        tv[some] += dt * dv
    slope = np.where(tt > 0, tv / np.where(tt > 0, tt, 1), 0.0) * 60
    return [pa.array(n, pa.int32()), *(pa.array(x) for x in (low, high, mean, np.sqrt(vv / n))), pa.array(slope, mask=n < min_samples)]


def rolling_whole(telemetry: DataFrame, span_s: int, min_samples: int = 8) -> DataFrame:
    """As ``rolling``, over all samples of the span, however many; samples of one time are in each other's windows.

    A series is cut into slices as long as the span. A window is then the end of the slice before and the beginning of its
    own: two running aggregates, each sample entering each once, that are merged without subtracting sums. Samples go to their
    slice and the next one, so a series is worked on in as many groups as it has slices.
    """
    span = span_s * 1_000_000
    t, v = F.unix_micros(F.col("time").cast("timestamp")), F.col("value")
    w = telemetry.select("time", *SERIES_KEY, "value", t.alias("_t")).withColumn("_own", F.col("_t") - F.pmod("_t", F.lit(span)))
    # Null times have no slice before or after them.
    slices = F.when(F.col("_t").isNull(), F.array("_own")).otherwise(F.array("_own", F.col("_own") + span))
    w = w.select("time", *SERIES_KEY, "value", "_t", F.posexplode(slices).alias("_late", "_slice"))
    # Microseconds from the slice's beginning, exact in a double; only samples with a value count for slopes.
    w = w.withColumn("_x", F.when(v.isNotNull(), (F.col("_t") - F.col("_slice")).cast("double")))
    group = Window.partitionBy(*SERIES_KEY, "_slice")
    running = (Window.unboundedPreceding, Window.currentRow)
    # The slice before from its end on: a window has seen what is no older than its own oldest.
    w = w.withColumn("_oldest", F.when(F.col("_late") == 0, F.col("_t") - span).otherwise(F.col("_t")))
    ends = {0: group.orderBy("_t").rangeBetween(*running), 1: group.orderBy(F.desc("_oldest")).rangeBetween(*running)}
    for late, frame in ends.items():
        here = F.col("_late") == late
        y, x = F.when(here, v), F.when(here, F.col("_x"))
        stats = {"n": F.count_if(here), "m": F.count(y), "min": F.min(y), "max": F.max(y), "y": F.sum(y), "yy": F.var_pop(y), "x": F.sum(x), "xx": F.var_pop(x), "xy": F.covar_pop(y, x)}
        w = w.select("*", *(a.over(frame).alias(f"_{c}{late}") for c, a in stats.items()))
    w = w.where("_late = 0")
    m0, m1 = F.col("_m0"), F.col("_m1")
    m = F.nullif(m0 + m1, F.lit(0))

    def total(name: str) -> Column:
        return F.coalesce(f"_{name}0", F.lit(0.0)) + F.coalesce(f"_{name}1", F.lit(0.0))

    def apart(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}0") / F.nullif(m0, F.lit(0)) - F.col(f"_{name}1") / F.nullif(m1, F.lit(0)), F.lit(0.0))

    def spread(name: str, one: str, two: str) -> Column:
        """The sum of products of deviations from the means of both parts together."""
        return F.coalesce(m0 * F.col(f"_{name}0"), F.lit(0.0)) + F.coalesce(m1 * F.col(f"_{name}1"), F.lit(0.0)) + apart(one) * apart(two) * (m0 * m1 / m)

    n = (F.col("_n0") + F.col("_n1")).cast("int")
    slope = spread("xy", "x", "y") / F.nullif(spread("xx", "x", "x"), F.lit(0.0)) * 60e6
    stats = {
        "n": n,
        "min": F.least("_min0", "_min1"),
        "max": F.greatest("_max0", "_max1"),
        "mean": total("y") / m,
        "stddev": F.sqrt(spread("yy", "y", "y") / m),
        "slope_per_min": F.when(n >= max(2, min_samples), F.coalesce(F.nanvl(slope, F.lit(0.0)), F.lit(0.0))),
    }
    return w.select("time", *SERIES_KEY, "value", *(c.alias(name) for name, c in stats.items()))


def derived_long(rolled: DataFrame) -> DataFrame:
    """Rolling statistics as metrics of their own, named metric#statistic; absent ones give no row."""
    names = ("count", "mean", "stddev", "min", "max", "slope_per_min")
    wide = rolled.select("time", *SERIES_KEY, *(F.col("n" if s == "count" else s).cast("double").alias(s) for s in names))
    # Unpivoted, not exploded: a filter inferred from an array of these columns would be pushed down with all their terms in it.
    long = wide.unpivot(["time", *SERIES_KEY], list(names), "_s", "value").where("value IS NOT NULL")
    return long.select("time", "tenant_id", "device_id", F.concat("metric", F.lit("#"), F.col("_s")).alias("metric"), "value")


def observation_state(telemetry: DataFrame, metrics: list[str], arrival: str) -> DataFrame:
    """After each record, in order of arrival: the latest value of each metric, and the newest time seen."""
    w = Window.partitionBy(*DEVICE).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("metric") == m, F.col("value")), True).over(w).alias(m) for m in metrics]
    return telemetry.select(arrival, *DEVICE, F.max("time").over(w).alias("last_seen"), *latest)


def hysteresis(telemetry: DataFrame, comparison: str, fire_at: float, clear_at: float, arrival: str = "time") -> DataFrame:
    """Adds active: whether the last decisive sample breached (no debounce). NaN never breaches, so it clears."""
    v = F.col("value")
    fires, stays = (v < fire_at, v < clear_at) if comparison == "BELOW" else (v > fire_at, v > clear_at)
    decisive = F.when(F.isnan(v), 0).when(fires, 1).when(~stays, 0)
    w = Window.partitionBy(*SERIES_KEY).orderBy(arrival, "value").rowsBetween(Window.unboundedPreceding, 0)
    return telemetry.withColumn("active", F.coalesce(F.last(decisive, True).over(w), F.lit(0)) == 1)


def edges(flagged: DataFrame, arrival: str = "time") -> DataFrame:
    """FIRED and RESOLVED rows: where active changes."""
    w = Window.partitionBy(*SERIES_KEY).orderBy(arrival, "value")
    before = F.coalesce(F.lag("active").over(w), F.lit(False))
    return flagged.withColumn("_before", before).where(F.col("active") != F.col("_before")).withColumn("kind", F.when(F.col("active"), "FIRED").otherwise("RESOLVED")).drop("_before", "active")


def silences(telemetry: DataFrame, limit_s: int, until: Column | None = None) -> DataFrame:
    """Intervals without data longer than the limit: tenant, device, last_seen, resumed (null: still silent), silence_s."""
    per_time = telemetry.select(*DEVICE, "time").distinct()
    after = F.lead("time").over(Window.partitionBy(*DEVICE).orderBy("time"))
    out = per_time.withColumn("resumed", after)
    end = F.coalesce("resumed", until) if until is not None else F.col("resumed")
    out = out.withColumn("silence_s", (F.unix_micros(end) - F.unix_micros(F.col("time"))) / 1e6)
    return out.where(F.col("silence_s") > limit_s).select(*DEVICE, F.col("time").alias("last_seen"), "resumed", "silence_s")


def sequence_gaps(frames: DataFrame, link: list[str], sequence: str, arrival: str) -> DataFrame:
    """Frames lost before each frame of an endpoint (sequence numbers are modulo 256); the first frame is the baseline."""
    before = F.lag(sequence).over(Window.partitionBy(*link).orderBy(arrival))
    lost = F.coalesce((F.col(sequence) - before - 1).bitwiseAND(255), F.lit(0)).cast("int")
    return frames.withColumn("lost", lost)


def link_loss(gaps: DataFrame, link: list[str]) -> DataFrame:
    """Decoded, lost and the ratio of each endpoint."""
    out = gaps.groupBy(*link).agg(F.count("*").alias("decoded"), F.sum("lost").cast("long").alias("lost"))
    return out.withColumn("loss_ratio", F.col("lost") / (F.col("decoded") + F.col("lost")))


def silence_alerts(telemetry: DataFrame, limit_s: int) -> DataFrame:
    """FIRED when a device has been silent longer than the limit, RESOLVED when it is heard again."""
    gaps = silences(telemetry, limit_s)
    fired = gaps.select(*DEVICE, F.lit("FIRED").alias("kind"), (F.col("last_seen") + F.make_dt_interval(secs=F.lit(limit_s))).alias("at"))
    return fired.unionByName(gaps.select(*DEVICE, F.lit("RESOLVED").alias("kind"), F.col("resumed").alias("at")))
