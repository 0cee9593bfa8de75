"""Queries over the narrow measurement table and its rollups. Every builder takes the tenant first and filters by it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.functions.binary import metrics
from skytally.functions.scalars import ratio, time_bucket
from skytally.plans.routing import DEFAULT_POINTS, Route, route
from skytally.schema import SERIES_KEY


def from_events(events: DataFrame) -> DataFrame:
    """The driver's event table as measurements."""
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("link-"), (F.col("user_id") % 10).cast("string"), F.lit("/sys"), (F.col("user_id") % 3).cast("string")).alias("device_id"),
        F.col("event_type").alias("metric"),
        "value",
    )


def _at(t: datetime | str) -> Column:
    return F.lit(t).cast("timestamp")


def scoped(df: DataFrame, tenant: str, device: str | None = None, metric: str | None = None) -> DataFrame:
    """Equality filters that reach the scan."""
    for name, value in (("tenant_id", tenant), ("device_id", device), ("metric", metric)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def between(df: DataFrame, start: datetime | str | None, end: datetime | str | None, column: str = "time") -> DataFrame:
    """Half-open: start <= t < end. Tables written by the store have an event_date, which is pruned along."""
    if start is not None:
        df = df.where(F.col(column) >= _at(start))
        df = df.where(F.col("event_date") >= _at(start).cast("date")) if "event_date" in df.columns else df
    if end is not None:
        df = df.where(F.col(column) < _at(end))
        df = df.where(F.col("event_date") <= _at(end).cast("date")) if "event_date" in df.columns else df
    return df


def rollup(telemetry: DataFrame, seconds: int = 60) -> DataFrame:
    """avg, min, max, samples (and the sum, for exact coarser means) of each series and bucket."""
    keys = [time_bucket(seconds, "time").alias("bucket"), *SERIES_KEY]
    return telemetry.groupBy(*keys).agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("samples"), F.sum("value").alias("sum_value"))


def rollup_up(rolled: DataFrame, seconds: int = 3600) -> DataFrame:
    """A coarser rollup from a finer one: the mean of means as the compatible avg_value, and the sum for exact means."""
    keys = [time_bucket(seconds, "bucket").alias("bucket"), *SERIES_KEY]
    return rolled.groupBy(*keys).agg(F.avg("avg_value").alias("avg_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("samples").alias("samples"), F.sum("sum_value").alias("sum_value"))


def downsample(telemetry: DataFrame, bucket_s: int) -> DataFrame:
    """Points of one series from raw measurements."""
    return telemetry.groupBy(time_bucket(bucket_s, "time").alias("bucket")).agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("samples")).orderBy("bucket")


def downsample_rollup(rolled: DataFrame, bucket_s: int) -> DataFrame:
    """Points of one series from a rollup: means weighed by samples. Buckets count by their start."""
    weighed = F.sum(F.col("avg_value") * F.col("samples")) / F.nullif(F.sum("samples"), F.lit(0))
    return rolled.groupBy(time_bucket(bucket_s, "bucket").alias("b")).agg(weighed.alias("avg_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("samples").alias("samples")).select(F.col("b").alias("bucket"), "avg_value", "min_value", "max_value", "samples").orderBy("bucket")


def series(relations: dict[str, DataFrame], tenant: str, device: str, metric: str, start: datetime, end: datetime, points: int = DEFAULT_POINTS) -> tuple[Route, DataFrame]:
    """Routes a range query to RAW, MINUTE or HOUR among the relations and downsamples there."""
    r = route(start, end, points)
    table = scoped(relations[r.source], tenant, device, metric)
    if r.source == "RAW":
        return r, downsample(between(table, start, end), r.bucket_s)
    return r, downsample_rollup(between(table, start, end, "bucket"), r.bucket_s)


def latest(telemetry: DataFrame, tenant: str, device: str, since: datetime | str) -> DataFrame:
    """The newest value of each metric; at one time the larger value counts."""
    rows = between(scoped(telemetry, tenant, device), since, None)
    newest = F.max(F.struct("time", "value")).alias("m")
    return rows.groupBy("metric").agg(newest).select("metric", F.col("m.time").alias("time"), F.col("m.value").alias("value")).orderBy("metric")


def devices_seen(telemetry: DataFrame, tenant: str, since: datetime | str) -> DataFrame:
    return between(scoped(telemetry, tenant), since, None).select("device_id").distinct().orderBy("device_id")


def metrics_seen(telemetry: DataFrame, tenant: str, device: str, since: datetime | str) -> DataFrame:
    return between(scoped(telemetry, tenant, device), since, None).select("metric").distinct().orderBy("metric")


def fleet_max(rolled: DataFrame, tenant: str, metric: str) -> DataFrame:
    """The highest value of one metric per device, from a rollup."""
    return scoped(rolled, tenant, metric=metric).groupBy("device_id").agg(F.max("max_value").alias("max_value")).orderBy("device_id")


def ingest_stats(records: DataFrame, record: str) -> DataFrame:
    """By tenant: records, those with and without metrics, measurements that they give, and measurements per record.

    records: a unique ``record`` column, tenant_id, message_id, payload. Counts per record go before the sums, and both are
    partly aggregated before their shuffle.
    """
    rows = metrics(records).groupBy(record).agg(F.count("*").alias("_m"))
    out = records.select(record, "tenant_id").join(rows, record, "left").groupBy("tenant_id")
    m = F.coalesce("_m", F.lit(0))
    out = out.agg(F.count("*").alias("records"), F.count_if(m > 0).alias("with_metrics"), F.count_if(m == 0).alias("without_metrics"), F.sum(m).alias("rows_written"))
    return out.withColumn("rows_per_record", ratio("rows_written", "records"))


def retained(df: DataFrame, now: datetime, keep: timedelta, column: str = "time") -> DataFrame:
    """Rows inside the retention horizon."""
    return df.where(F.col(column) >= _at(now - keep))


#: Refresh horizons of the rollups: (start offset, end offset). Buckets outside are neither added nor changed.
REFRESH = {"MINUTE": (timedelta(hours=3), timedelta(minutes=1)), "HOUR": (timedelta(days=3), timedelta(hours=1))}
#: How long each relation is kept; hours stay for good.
RETENTION = {"RAW": timedelta(days=7), "MINUTE": timedelta(days=90)}


def refresh_range(level: str, now: datetime) -> tuple[datetime, datetime]:
    """The buckets a refresh at ``now`` recomputes: whole buckets within the horizons."""
    back, lead = REFRESH[level]
    width = 60 if level == "MINUTE" else 3600
    origin = datetime(2000, 1, 3, tzinfo=now.tzinfo)
    up = lambda t: origin + timedelta(seconds=-(-(t - origin).total_seconds() // width) * width)
    down = lambda t: origin + timedelta(seconds=(t - origin).total_seconds() // width * width)
    return up(now - back), down(now - lead)
