"""Threshold rules over history as scans: the same alerts as the fold's, by window functions, and a hot device in many tasks.

For a rule a record is a breach (beyond the firing bound), clear (on the safe side of the clearing one) or between. Only
breaches make an alert pend, and only clear records make one resolve, so that every run of successive breaches has at most one
record at which it could fire, the first whose time is far enough from the run's first; every run of clear records has one at
which it could resolve. A rule is active after the former and inactive after the latter, whether they changed anything or not.
The alerts are therefore the candidates whose predecessor among the candidates is of the other kind.

All that needs, of what came before a record, are last values and a greatest time. With ``ranges`` the records are dealt by
device and arrival into as many ranges of equal size; each is scanned by itself, and what it begins with comes from the ends
of the ranges before it, one row per range and device. A device with half of all rows is then the work of half the tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytally.rules.batch import NAMES
from skytally.rules.model import Rule, Threshold
from skytally.rules.window import base_metric
from skytally.session import materialize, scratch, ship_package

KEYS = ["rule_id", "tenant_id", "device_id"]
FIRED, RESOLVED = "FIRED", "RESOLVED"


@F.pandas_udf(T.StringType())
def _detail(metric: pd.Series, value: pd.Series, known: pd.Series, sign: pd.Series, bound: pd.Series) -> pd.Series:
    """Of alerts only, in Python's rounding, as the fold describes them."""
    return pd.Series([f"{m} {f'{v:.3f}' if k else 'no reading'} (threshold {s} {b:.3f})" for m, v, k, s, b in zip(metric, value, known, sign, bound, strict=True)], dtype=object)


def _carried(df: DataFrame, ranges: int, upto: int, last: dict[str, Column], most: dict[str, Column] | None = None) -> DataFrame:
    """Adds the last value that isn't null (``most``: the greatest) of the records up to this one (0) or before it (-1)."""
    most = most or {}
    here = Window.partitionBy(*KEYS, "_range").orderBy("_arrival").rowsBetween(Window.unboundedPreceding, upto)
    if ranges == 1:
        return df.withColumns({n: F.last(c, True).over(here) for n, c in last.items()} | {n: F.max(c).over(here) for n, c in most.items()})
    df = df.withColumns({f"_own_{n}": c for n, c in (last | most).items()})
    ends = df.groupBy(*KEYS, "_range").agg(*(F.max_by(F.when(F.col(f"_own_{n}").isNotNull(), F.struct(f"_own_{n}")), F.when(F.col(f"_own_{n}").isNotNull(), F.col("_arrival"))).alias(n) for n in last), *(F.max(f"_own_{n}").alias(n) for n in most))
    before = Window.partitionBy(*KEYS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*KEYS, "_range", *(F.last(F.col(n)[f"_own_{n}"], True).over(before).alias(f"_in_{n}") for n in last), *(F.max(n).over(before).alias(f"_in_{n}") for n in most))
    df = df.join(ends, [*KEYS, "_range"])
    df = df.withColumns({n: F.coalesce(F.last(f"_own_{n}", True).over(here), F.col(f"_in_{n}")) for n in last} | {n: F.greatest(F.max(f"_own_{n}").over(here), F.col(f"_in_{n}")) for n in most})
    return df.drop(*(f"{p}_{n}" for p in ("_own", "_in") for n in (*last, *most)))


def threshold_alerts(spark: SparkSession, telemetry: DataFrame, rules: list[Rule], arrival: str, ranges: int = 1) -> DataFrame:
    """All alerts of rules on plain thresholds; as ``batch.alerts``, which also takes the other conditions.

    telemetry: tenant_id, device_id, metric, value, time_ns and the arrival order, which must be unique within a device. A null
    metric is a record without measurements; NaN and null values don't breach.
    """
    if any(not isinstance(r.condition, Threshold) or base_metric(r.condition.metric) for r in rules):
        raise ValueError("only thresholds on plain metrics can be scanned")
    ship_package(spark)
    list_ = [(r.id, r.name, r.tenant_id, r.device_id, r.severity, r.condition.metric, r.condition.comparison == "BELOW", float(r.condition.fire_at), float(r.condition.clear_at), r.for_ns, r.clear_ns) for r in rules]
    given = spark.createDataFrame(list_, "rule_id string, rule_name string, _tenant string, _device string, severity string, _metric string, _below boolean, _fire double, _clear double, _for bigint, _wait bigint")
    rows = telemetry.select("tenant_id", "device_id", "metric", "value", "time_ns", F.col(arrival).alias("_arrival"))
    applies = (F.col("tenant_id") == F.col("_tenant")) & ((F.col("_device") == "*") | (F.col("_device") == F.col("device_id")))
    with scratch(spark):
        if ranges > 1:
            rows = rows.repartitionByRange(ranges, "tenant_id", "device_id", "_arrival").withColumn("_range", F.spark_partition_id())
            rows = materialize(spark, rows, "scan-ranges")
        else:
            rows = rows.withColumn("_range", F.lit(0))
        df = rows.join(F.broadcast(given), applies).drop("_tenant", "_device")  # the caller's list of rules
        df = _carried(df, ranges, 0, {"_v": F.when(F.col("metric") == F.col("_metric"), F.struct("value"))}, {"_at": F.col("time_ns")})
        v = F.when(F.isnan("_v.value"), None).otherwise(F.col("_v.value"))
        beyond = lambda bound: F.coalesce(F.when(F.col("_below"), v < F.col(bound)).otherwise(v > F.col(bound)), F.lit(False))
        df = df.withColumn("_class", F.when(beyond("_fire"), FIRED).when(beyond("_clear"), "BETWEEN").otherwise(RESOLVED))
        df = _carried(df, ranges, -1, {"_class_before": F.col("_class"), "_at_before": F.col("_at")})
        new = F.col("_class_before").isNull() | (F.col("_class") != F.col("_class_before"))
        df = _carried(df, ranges, 0, {"_start": F.when(new, F.col("_at"))})
        wait = F.when(F.col("_class") == FIRED, F.col("_for")).when(F.col("_class") == RESOLVED, F.col("_wait"))
        reached = F.coalesce(F.col("_at") - F.col("_start") >= wait, F.lit(False)) & (new | (F.col("_at_before") - F.col("_start") < wait))
        df = df.withColumn("_kind", F.when(reached, F.col("_class")))
        df = _carried(df, ranges, -1, {"_kind_before": F.col("_kind")})
        found = df.where(F.col("_kind").isNotNull() & (F.col("_kind") != F.coalesce("_kind_before", F.lit(RESOLVED))))
        detail = _detail("_metric", F.col("_v.value"), F.col("_v.value").isNotNull(), F.when(F.col("_below"), "<").otherwise(">"), "_fire")
        found = found.select("rule_id", "rule_name", "tenant_id", "device_id", "severity", F.col("_kind").alias("kind"), F.col("_start").alias("condition_since_ns"), F.col("_at").alias("at_ns"), wait.alias("debounce_ns"), detail.alias("detail"))
        return materialize(spark, found.select(NAMES), "scanned-alerts", keep=True)
