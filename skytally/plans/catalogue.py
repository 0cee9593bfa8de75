"""The registered queries over the driver's tables, with the SQL that gives the same rows.

Measurements come from the event table, commands from orders, frames from events; the adapters are SQL expressions that
Spark and the oracle share.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.codec import hk
from skytally.codec.crc import crc16_ccitt_false, crc16_mcrf4xx, mcrf4xx
from skytally.codec.dialect import CORE_DIALECT
from skytally.functions import binary, scalars
from skytally.operators import ops, telemetry, windows
from skytally.plans.routing import route
from skytally.rules.batch import alerts
from skytally.rules.model import Geofence, Rule, Threshold
from skytally.rules.scan import threshold_alerts
from skytally.schema import HK_LAYOUTS
from skytally.session import shared_dir, ship_package
from skytally.sources import binary as sources
from skytally.streaming import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TENANT, DEVICE, METRIC = "tenant-0", "link-5/sys0", "purchase"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 31)
VIEW = ["ts AS time", "'tenant-' || (user_id % 3) AS tenant_id", "'link-' || (user_id % 10) || '/sys' || (user_id % 3) AS device_id", "event_type AS metric", "value"]
TELEMETRY = f"(SELECT {', '.join(VIEW)}, event_id FROM events)"
#: Orders as commands.
COMMAND = [
    "o_orderkey AS id",
    "'tenant-' || (o_custkey % 3) AS tenant_id",
    "'link-' || (o_custkey % 40) || '/sys1' AS device_id",
    "'key-' || (o_orderkey % 14000) AS idempotency_key",
    "CASE o_orderkey % 5 WHEN 0 THEN 'ARM' WHEN 1 THEN 'DISARM' WHEN 2 THEN 'TAKEOFF' WHEN 3 THEN 'LAND' ELSE 'RETURN_TO_LAUNCH' END AS command_type",
    "CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'SENT' ELSE 'ACKED' END AS state",
    "CASE WHEN o_orderstatus = 'F' THEN 0 ELSE -1 END AS ack_result",
    "o_orderdate AS created_at",
    "o_orderdate + INTERVAL 30 DAY AS expires_at",
    "CASE o_orderkey % 5 WHEN 0 THEN 400 WHEN 1 THEN 400 WHEN 2 THEN 22 WHEN 3 THEN 21 ELSE 20 END AS mav_command_id",
]
COMMANDS = f"(SELECT {', '.join(COMMAND)} FROM orders)"
#: Events as one busy series among four, so that ranges hold hundreds of buckets.
DENSE_VIEW = ["ts AS time", "'tenant-' || (user_id % 2) AS tenant_id", "'link-5/sys' || (user_id % 4 - user_id % 2) AS device_id", "CASE WHEN event_id % 4 = 0 THEN 'view' ELSE 'purchase' END AS metric", "value"]
DENSE = f"(SELECT {', '.join(DENSE_VIEW)} FROM events)"
#: Events as frames of endpoints: events of other endpoints leave gaps in the sequence numbers.
FRAME = ["event_id", "ts", "'link-' || (user_id % 4) AS link_id", "(user_id % 2) AS system_id", "(event_id % 256) AS sequence", "value"]
FRAMES = f"(SELECT {', '.join(FRAME)} FROM events)"
#: Events as records with a message id and a pressure.
RECORD = ["event_id", "'tenant-' || (user_id % 3) AS tenant_id", "'link-' || (user_id % 10) AS device_id", "CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 253 WHEN 'click' THEN 33 WHEN 'view' THEN 27 ELSE 42 END AS message_id", "(event_id % 100) / 100.0 AS pressure", "floor(value / 100) AS body", "ts"]
RECORDS = f"(SELECT {', '.join(RECORD)} FROM events)"
PRIORITY_SQL = "CASE WHEN message_id IN (0, 1, 77, 253) THEN 'CRITICAL' WHEN message_id IN (24, 30, 32, 33, 74, 147) THEN 'HIGH' WHEN message_id IN (26, 27, 35, 36, 65, 125, 152, 163, 164, 165, 178, 241) THEN 'BULK' ELSE 'NORMAL' END"
SHED_SQL = "CASE WHEN priority = 'HIGH' THEN pressure >= 0.95 WHEN priority = 'NORMAL' THEN pressure >= 0.85 WHEN priority = 'BULK' THEN pressure >= 0.75 ELSE false END"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = f(spark, sf_dir)
            # Times go out without a zone, as the tables have them.
            return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes))

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _telemetry(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(*VIEW, "event_id").withColumn("time", F.col("time").cast("timestamp"))


def _commands(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr(*COMMAND)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(*FRAME)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(*RECORD)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Minute rollups of the whole fleet."""
    return QUERIES["rollup_1m"](spark, d)


# Scans, projections, rollups, series.


@query("telemetry_view", f"SELECT time, tenant_id, device_id, metric, value FROM {TELEMETRY}")
def telemetry_view(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.from_events(_events(spark, d))


ROLLUP_1M = f"(SELECT time_bucket(INTERVAL '60 seconds', time) AS bucket, tenant_id, device_id, metric, avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS samples, sum(value) AS sum_value FROM {TELEMETRY} GROUP BY ALL)"
ROLLUP_1H = f"(SELECT time_bucket(INTERVAL '3600 seconds', bucket) AS bucket, tenant_id, device_id, metric, avg(avg_value) AS avg_value, min(min_value) AS min_value, max(max_value) AS max_value, sum(samples)::BIGINT AS samples, sum(sum_value) AS sum_value FROM {ROLLUP_1M} GROUP BY ALL)"
ROUNDED = "bucket, tenant_id, device_id, metric, round(avg_value, 6) AS avg_value, min_value, max_value, samples, round(sum_value, 6) AS sum_value"


@query("rollup_1m", f"SELECT {ROUNDED} FROM {ROLLUP_1M}")
def rollup_1m(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(telemetry.rollup(_telemetry(spark, d)), "avg_value", "sum_value")


@query("rollup_1h", f"SELECT {ROUNDED} FROM {ROLLUP_1H}")
def rollup_1h(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(telemetry.rollup_up(telemetry.rollup(_telemetry(spark, d))), "avg_value", "sum_value")


@query("rollup_replayed", f"SELECT bucket, tenant_id, device_id, metric, round(avg_value, 6) AS avg_value, min_value, max_value, 2 * samples AS samples, round(2 * sum_value, 5) AS sum_value FROM {ROLLUP_1M}")
def rollup_replayed(spark: SparkSession, d: str) -> DataFrame:
    """What a batch that was delivered twice does to a rollup: means and bounds stay, counts and sums double."""
    rows = _telemetry(spark, d)
    return _rounded(_rounded(telemetry.rollup(rows.unionByName(rows)), "avg_value"), "sum_value", digits=5)


@query("rollup_1h_exact", f"SELECT time_bucket(INTERVAL '3600 seconds', time) AS bucket, tenant_id, device_id, metric, round(sum(value) / count(*), 6) AS mean, count(*) AS samples FROM {TELEMETRY} GROUP BY ALL")
def rollup_1h_exact(spark: SparkSession, d: str) -> DataFrame:
    rolled = telemetry.rollup_up(telemetry.rollup(_telemetry(spark, d)))
    return rolled.select("bucket", "tenant_id", "device_id", "metric", F.round(F.col("sum_value") / F.col("samples"), 6).alias("mean"), "samples")


def _series(name: str, start: datetime, end: datetime, points: int) -> None:
    r = route(start, end, points)
    rollup_1m, rollup_1h = (t.replace(TELEMETRY, DENSE) for t in (ROLLUP_1M, ROLLUP_1H))
    scope = f"tenant_id = '{TENANT}' AND device_id = '{DEVICE}' AND metric = '{METRIC}'"
    span = f">= TIMESTAMP '{start}' AND {{t}} < TIMESTAMP '{end}'"
    if r.source == "RAW":
        sql = f"SELECT time_bucket(INTERVAL '{r.bucket_s} seconds', time) AS bucket, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS samples FROM {DENSE} WHERE {scope} AND time {span.format(t='time')} GROUP BY 1"
    else:
        table = rollup_1m if r.source == "MINUTE" else rollup_1h
        sql = f"SELECT time_bucket(INTERVAL '{r.bucket_s} seconds', bucket) AS bucket, round(sum(avg_value * samples) / nullif(sum(samples), 0), 6) AS avg_value, min(min_value) AS min_value, max(max_value) AS max_value, sum(samples)::BIGINT AS samples FROM (SELECT bucket, avg_value, min_value, max_value, samples FROM {table} WHERE {scope} AND bucket {span.format(t='bucket')}) GROUP BY 1"

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = _events(spark, d).selectExpr(*DENSE_VIEW).withColumn("time", F.col("time").cast("timestamp"))
        if r.source != "RAW":  # buckets that begin in the range end an hour after it at most: the scan reads no more
            raw = telemetry.between(raw, start, end + timedelta(hours=1))
        minute = telemetry.rollup(telemetry.scoped(raw, TENANT, DEVICE, METRIC))
        relations = {"RAW": raw, "MINUTE": minute, "HOUR": telemetry.rollup_up(minute)}
        return _rounded(telemetry.series(relations, TENANT, DEVICE, METRIC, start, end, points)[1], "avg_value")


_series("series_raw", datetime(2024, 1, 3), datetime(2024, 1, 6), 5000)
_series("series_minute", datetime(2024, 1, 5), datetime(2024, 1, 25), 5000)
_series("series_hour", T0, T1, 500)
_series("series_5m_raw", datetime(2024, 1, 2), datetime(2024, 1, 5, 8), 4900)


@query("series_stored", ORACLE["series_hour"])
def series_stored(spark: SparkSession, d: str) -> DataFrame:
    """As series_hour, from rollups that are stored: minutes from the measurements, hours from the stored minutes. The range
    query prunes days and reads hours only."""
    raw = _events(spark, d).selectExpr(*DENSE_VIEW).withColumn("time", F.col("time").cast("timestamp"))
    stored, levels = {"RAW": raw}, {"MINUTE": telemetry.rollup, "HOUR": telemetry.rollup_up}
    source = raw
    for level, roll in levels.items():
        path = f"{shared_dir(spark)}/skytally/{level.lower()}-{uuid.uuid4().hex}"
        tables.write_rollup(roll(source), path)
        source = stored[level] = spark.read.parquet(path)
    return _rounded(telemetry.series(stored, TENANT, DEVICE, METRIC, T0, T1, 500)[1], "avg_value")


def _buckets(name: str, level: str, width: int) -> None:
    table, column = {"RAW": (TELEMETRY, "time"), "MINUTE": (ROLLUP_1M, "bucket"), "HOUR": (ROLLUP_1H, "bucket")}[level]

    @query(name, f"SELECT count(*) AS buckets FROM (SELECT DISTINCT time_bucket(INTERVAL '{width} seconds', {column}) FROM {table} WHERE tenant_id = '{TENANT}' AND device_id = '{DEVICE}' AND metric = '{METRIC}')")
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = telemetry.scoped(_telemetry(spark, d), TENANT, DEVICE, METRIC)
        if level != "RAW":
            rows = telemetry.rollup(rows)
            rows = telemetry.rollup_up(rows) if level == "HOUR" else rows
        return rows.select(scalars.time_bucket(width, column).alias("b")).distinct().agg(F.count("*").alias("buckets"))


_buckets("buckets_5m_raw", "RAW", 300)
_buckets("series_5m_from_1m", "MINUTE", 300)
_buckets("series_6h_from_1h", "HOUR", 21600)


@query("point_query_count", f"SELECT count(*) AS n FROM {TELEMETRY} WHERE tenant_id = '{TENANT}' AND device_id = '{DEVICE}' AND metric = '{METRIC}' AND time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-11'")
def point_query_count(spark: SparkSession, d: str) -> DataFrame:
    rows = telemetry.between(telemetry.scoped(_telemetry(spark, d), TENANT, DEVICE, METRIC), "2024-01-10", "2024-01-11")
    return rows.agg(F.count("*").alias("n"))


@query("latest_per_metric", f"SELECT DISTINCT ON (metric) metric, time, value FROM {TELEMETRY} WHERE tenant_id = '{TENANT}' AND device_id = '{DEVICE}' AND time >= TIMESTAMP '2024-01-10' ORDER BY metric, time DESC, value DESC")
def latest_per_metric(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.latest(_telemetry(spark, d), TENANT, DEVICE, "2024-01-10")


@query("devices_seen", f"SELECT DISTINCT device_id FROM {TELEMETRY} WHERE tenant_id = '{TENANT}' AND time >= TIMESTAMP '2024-01-29'")
def devices_seen(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.devices_seen(_telemetry(spark, d), TENANT, "2024-01-29")


@query("metrics_seen", f"SELECT DISTINCT metric FROM {TELEMETRY} WHERE tenant_id = '{TENANT}' AND device_id = '{DEVICE}' AND time >= TIMESTAMP '2024-01-25'")
def metrics_seen(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.metrics_seen(_telemetry(spark, d), TENANT, DEVICE, "2024-01-25")


@query("fleet_max_by_device", f"SELECT device_id, max(max_value) AS max_value FROM {ROLLUP_1H} WHERE tenant_id = '{TENANT}' AND metric = '{METRIC}' GROUP BY 1")
def fleet_max_by_device(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.fleet_max(telemetry.rollup_up(telemetry.rollup(_telemetry(spark, d))), TENANT, METRIC)


@query("retention_cutoff", f"SELECT count(*) AS kept FROM {TELEMETRY} WHERE time >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def retention_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.retained(_telemetry(spark, d), T1, telemetry.RETENTION["RAW"]).agg(F.count("*").alias("kept"))


@query("refresh_horizon", f"SELECT {ROUNDED} FROM {ROLLUP_1H} WHERE bucket >= TIMESTAMP '2024-01-22 12:00:00' AND bucket < TIMESTAMP '2024-01-25 11:00:00'")
def refresh_horizon(spark: SparkSession, d: str) -> DataFrame:
    start, end = telemetry.refresh_range("HOUR", datetime(2024, 1, 25, 12))
    rolled = telemetry.rollup_up(telemetry.rollup(telemetry.between(_telemetry(spark, d), start, end)))
    return _rounded(rolled, "avg_value", "sum_value")


# Windows.

ROLLING = f"""(SELECT time, tenant_id, device_id, metric, value, count(*) OVER w AS n, min(value) OVER w AS min, max(value) OVER w AS max, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS stddev,
 CASE WHEN count(*) OVER w >= 2 THEN coalesce(CASE WHEN isnan(regr_slope(value, epoch(time)) OVER w) THEN 0 ELSE regr_slope(value, epoch(time)) OVER w END, 0) * 60 END AS slope_per_min
 FROM {TELEMETRY} WINDOW w AS (PARTITION BY tenant_id, device_id, metric ORDER BY time RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW))"""


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_whole(_telemetry(spark, d), 86400, min_samples=2)


@query("rolling_stats", f"SELECT time, tenant_id, device_id, metric, n::INT AS n, min, max, round(mean, 7) AS mean, round(stddev, 7) AS stddev FROM {ROLLING}")
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rolling(spark, d), "mean", "stddev", digits=7).select("time", "tenant_id", "device_id", "metric", "n", "min", "max", "mean", "stddev")


@query("trend_slope", f"SELECT time, tenant_id, device_id, metric, n::INT AS n, round(slope_per_min, 4) + 0 AS slope_per_min FROM {ROLLING}")
def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).withColumn("slope_per_min", F.round("slope_per_min", 4) + F.lit(0.0)).select("time", "tenant_id", "device_id", "metric", "n", "slope_per_min")


@query(
    "derived_metrics_long",
    f"""SELECT time, tenant_id, device_id, metric || '#' || s AS metric, v AS value FROM (
 SELECT time, tenant_id, device_id, metric, unnest(['count', 'mean', 'stddev', 'min', 'max', 'slope_per_min']) AS s, unnest([n::DOUBLE, round(mean, 7), round(stddev, 7), min, max, round(slope_per_min, 4) + 0]) AS v FROM {ROLLING}) WHERE v IS NOT NULL""",
)
def derived_metrics_long(spark: SparkSession, d: str) -> DataFrame:
    long = windows.derived_long(_rolling(spark, d))
    return long.withColumn("value", F.when(F.col("metric").endswith("#slope_per_min"), F.round("value", 4) + F.lit(0.0)).otherwise(F.round("value", 7)))


#: Of a busy series both bounds take effect: 64 samples, and a day. Slopes are over seconds since the window's newest sample.
CAPPED = f"""(WITH s AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_id, metric ORDER BY time, value) AS rn FROM {DENSE})
 SELECT a.time, a.tenant_id, a.device_id, a.metric, a.value, count(*) AS n, min(b.value) AS min, max(b.value) AS max, avg(b.value) AS mean, stddev_pop(b.value) AS stddev,
 CASE WHEN count(*) >= 8 THEN coalesce(CASE WHEN min(b.time) <> max(b.time) THEN regr_slope(b.value, epoch(b.time) - epoch(a.time)) END, 0) * 60 END AS slope_per_min
 FROM s a JOIN s b ON a.tenant_id = b.tenant_id AND a.device_id = b.device_id AND a.metric = b.metric AND b.rn BETWEEN a.rn - 63 AND a.rn AND b.time >= a.time - INTERVAL 86400 SECOND GROUP BY a.time, a.tenant_id, a.device_id, a.metric, a.value, a.rn)"""


@query("rolling_capped", f"SELECT time, tenant_id, device_id, metric, value, n::INT AS n, min, max, round(mean, 9) AS mean, round(stddev, 7) AS stddev, round(slope_per_min, 6) + 0 AS slope_per_min FROM {CAPPED}")
def rolling_capped(spark: SparkSession, d: str) -> DataFrame:
    """Windows of at most 64 samples within a day."""
    raw = _events(spark, d).selectExpr(*DENSE_VIEW).withColumn("time", F.col("time").cast("timestamp"))
    found = _rounded(_rounded(windows.rolling(raw, 86400), "stddev", digits=7), "mean", digits=9)
    return found.withColumn("slope_per_min", F.round("slope_per_min", 6) + F.lit(0.0))


KINDS = ["signup", "error", "click", "view", "purchase"]


@query(
    "observation_state",
    "SELECT event_id, tenant_id, device_id, max(time) OVER w AS last_seen, " + ", ".join(f"last_value(CASE WHEN metric = '{k}' THEN value END IGNORE NULLS) OVER w AS {k}" for k in KINDS) + f" FROM {TELEMETRY} WINDOW w AS (PARTITION BY tenant_id, device_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def observation_state(spark: SparkSession, d: str) -> DataFrame:
    return windows.observation_state(_telemetry(spark, d), KINDS, "event_id")


HYSTERESIS = f"(SELECT *, coalesce(last_value(CASE WHEN isnan(value) THEN 0 WHEN value < 20 THEN 1 WHEN NOT value < 40 THEN 0 END IGNORE NULLS) OVER (PARTITION BY tenant_id, device_id, metric ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS active FROM {TELEMETRY})"


@query("hysteresis_flag", f"SELECT event_id, tenant_id, device_id, metric, active FROM {HYSTERESIS}")
def hysteresis_flag(spark: SparkSession, d: str) -> DataFrame:
    return windows.hysteresis(_telemetry(spark, d), "BELOW", 20, 40, "event_id").select("event_id", "tenant_id", "device_id", "metric", "active")


@query("threshold_edges", f"SELECT event_id, tenant_id, device_id, metric, CASE WHEN active THEN 'FIRED' ELSE 'RESOLVED' END AS kind FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY tenant_id, device_id, metric ORDER BY event_id), false) AS was FROM {HYSTERESIS}) WHERE active <> was")
def threshold_edges(spark: SparkSession, d: str) -> DataFrame:
    return windows.edges(windows.hysteresis(_telemetry(spark, d), "BELOW", 20, 40, "event_id"), "event_id").select("event_id", "tenant_id", "device_id", "metric", "kind")


HOUR_NS = 3600 * 10**9
RULES = [Rule("low-click", "Low click value", f"tenant-{i}", "*", "WARNING", Threshold("click", "BELOW", 20.0, 40.0), 6 * HOUR_NS, 12 * HOUR_NS) for i in range(3)]


@query(
    "alerts_debounced",
    f"""WITH RECURSIVE s AS (SELECT tenant_id, device_id, epoch_us(time) * 1000 AS t, event_id, last_value(CASE WHEN metric = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY tenant_id, device_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY tenant_id, device_id ORDER BY event_id) AS rn FROM {TELEMETRY}),
f AS (SELECT tenant_id, device_id, 0::BIGINT AS rn, 'INACTIVE' AS phase, 0::BIGINT AS since, 0::BIGINT AS onset, NULL::VARCHAR AS kind, 0::BIGINT AS start, 0::BIGINT AS t, NULL::DOUBLE AS v FROM s WHERE rn = 1
UNION ALL
SELECT tenant_id, device_id, rn, CASE WHEN h THEN CASE WHEN phase IN ('FIRING', 'RESOLVING') THEN 'FIRING' WHEN t - o >= {6 * HOUR_NS} THEN 'FIRING' ELSE 'PENDING' END ELSE CASE WHEN phase IN ('INACTIVE', 'PENDING') THEN 'INACTIVE' WHEN t - c >= {12 * HOUR_NS} THEN 'INACTIVE' ELSE 'RESOLVING' END END,
 CASE WHEN h THEN CASE WHEN phase = 'FIRING' THEN since WHEN phase = 'PENDING' AND t - o < {6 * HOUR_NS} THEN since ELSE t END ELSE CASE WHEN phase = 'INACTIVE' THEN since WHEN phase IN ('FIRING', 'RESOLVING') AND t - c < {12 * HOUR_NS} THEN c ELSE t END END,
 CASE WHEN h THEN CASE WHEN phase IN ('FIRING', 'RESOLVING') THEN onset ELSE o END ELSE CASE WHEN phase IN ('FIRING', 'RESOLVING') AND t - c < {12 * HOUR_NS} THEN onset WHEN phase = 'INACTIVE' THEN onset ELSE t END END,
 CASE WHEN h AND phase IN ('INACTIVE', 'PENDING') AND t - o >= {6 * HOUR_NS} THEN 'FIRED' WHEN NOT h AND phase IN ('FIRING', 'RESOLVING') AND t - c >= {12 * HOUR_NS} THEN 'RESOLVED' END, CASE WHEN h THEN o ELSE c END, t, v
FROM (SELECT s.tenant_id, s.device_id, s.rn, s.t, s.v, f.phase, f.since, f.onset, coalesce(s.v < CASE WHEN f.phase IN ('FIRING', 'RESOLVING') THEN 40 ELSE 20 END, false) AS h, CASE WHEN f.phase = 'PENDING' THEN f.onset ELSE s.t END AS o, CASE WHEN f.phase = 'RESOLVING' THEN f.since ELSE s.t END AS c FROM f JOIN s ON s.tenant_id = f.tenant_id AND s.device_id = f.device_id AND s.rn = f.rn + 1))
SELECT tenant_id, device_id, kind, start AS condition_since_ns, t AS at_ns, printf('click %.3f (threshold < 20.000)', v) AS detail FROM f WHERE kind IS NOT NULL""",
)
def alerts_debounced(spark: SparkSession, d: str) -> DataFrame:
    rows = _telemetry(spark, d).withColumn("time_ns", F.unix_micros("time") * 1000)
    return alerts(spark, rows, RULES, "event_id").select("tenant_id", "device_id", "kind", "condition_since_ns", "at_ns", "detail")


@query("alerts_scanned", ORACLE["alerts_debounced"])
def alerts_scanned(spark: SparkSession, d: str) -> DataFrame:
    """As alerts_debounced, by scans over ranges of all records instead of a fold per device."""
    rows = _telemetry(spark, d).withColumn("time_ns", F.unix_micros("time") * 1000)
    return threshold_alerts(spark, rows, RULES, "event_id", ranges=8).select("tenant_id", "device_id", "kind", "condition_since_ns", "at_ns", "detail")


@query("alert_latency", "SELECT tenant_id, kind, count(*) AS n, max(at_ns - condition_since_ns) AS worst_ns, max(greatest(0, at_ns - condition_since_ns - CASE kind WHEN 'FIRED' THEN " + f"{6 * HOUR_NS} ELSE {12 * HOUR_NS} END)) AS worst_incidental_ns FROM (" + ORACLE["alerts_debounced"] + ") GROUP BY 1, 2")
def alert_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = _telemetry(spark, d).withColumn("time_ns", F.unix_micros("time") * 1000)
    late = F.col("at_ns") - F.col("condition_since_ns")
    found = alerts(spark, rows, RULES, "event_id")
    return found.groupBy("tenant_id", "kind").agg(F.count("*").alias("n"), F.max(late).alias("worst_ns"), F.max(F.greatest(F.lit(0), late - F.col("debounce_ns"))).alias("worst_incidental_ns"))


DISTANCE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 39.8917) / 2), 2) + cos(radians(39.8917)) * cos(radians(lat)) * pow(sin(radians(lon - 32.7833) / 2), 2))))"
PLACES = "(SELECT event_id, tenant_id, device_id, 39.8917 + value / 100000 AS lat, 32.7833 + (event_id % 97) / 10000.0 AS lon FROM " + TELEMETRY + ")"


def _places(spark: SparkSession, d: str) -> DataFrame:
    p = _telemetry(spark, d).selectExpr("event_id", "tenant_id", "device_id", "39.8917D + value / 100000 AS lat", "32.7833D + (event_id % 97) / 10000.0D AS lon")
    return p.withColumn("distance_m", scalars.haversine_m(F.lit(39.8917), F.lit(32.7833), F.col("lat"), F.col("lon")))


@query("geofence_distance", f"SELECT event_id, tenant_id, device_id, round({DISTANCE}, 4) AS distance_m FROM {PLACES}")
def geofence_distance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_places(spark, d), "distance_m", digits=4).select("event_id", "tenant_id", "device_id", "distance_m")


@query("geofence_breach", f"SELECT tenant_id, device_id, count(*) AS breaches FROM {PLACES} WHERE {DISTANCE} > 500 GROUP BY 1, 2")
def geofence_breach(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).where(scalars.breaches("distance_m", "ABOVE", 500)).groupBy("tenant_id", "device_id").agg(F.count("*").alias("breaches"))


#: Positions that come a coordinate at a time, as records of a link do; a fence with hysteresis, without debounce.
FENCE = [Rule("fence", "Left the area", f"tenant-{i}", "*", "CRITICAL", Geofence(39.8917, 32.7833, 500.0, 300.0)) for i in range(3)]
POSITION = [*VIEW[:3], "event_id", "CASE WHEN event_id % 2 = 0 THEN 'position.latitude_deg' ELSE 'position.longitude_deg' END AS metric", "CASE WHEN event_id % 2 = 0 THEN CAST(39.8917 AS DOUBLE) + value / 100000 ELSE CAST(32.7833 AS DOUBLE) + (event_id % 97) / CAST(10000 AS DOUBLE) END AS value"]
IN_ORDER = "PARTITION BY tenant_id, device_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _edges_sql(source: str, fires: str, clears: str, detail: str) -> str:
    """Alerts without debounce: where the last decisive value changes sides. at: the newest time so far."""
    return f"""SELECT tenant_id, device_id, CASE WHEN active = 1 THEN 'FIRED' ELSE 'RESOLVED' END AS kind, at_ns, {detail} AS detail FROM (
 SELECT *, lag(active, 1, 0) OVER (PARTITION BY tenant_id, device_id ORDER BY event_id) AS was FROM (
 SELECT *, coalesce(last_value(CASE WHEN {fires} THEN 1 WHEN {clears} THEN 0 END IGNORE NULLS) OVER ({IN_ORDER}), 0) AS active FROM {source})) WHERE active <> was"""


@query(
    "alerts_geofence",
    _edges_sql(f"(SELECT *, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN {DISTANCE} END AS d FROM (SELECT tenant_id, device_id, event_id, max(epoch_us(time) * 1000) OVER ({IN_ORDER}) AS at_ns, last_value(CASE WHEN metric = 'position.latitude_deg' THEN value END IGNORE NULLS) OVER ({IN_ORDER}) AS lat, last_value(CASE WHEN metric = 'position.longitude_deg' THEN value END IGNORE NULLS) OVER ({IN_ORDER}) AS lon FROM (SELECT {', '.join(POSITION)} FROM events)))", "d > 500", "d <= 300", "printf('%.0f m from fence centre (radius 500 m)', d)"),
)
def alerts_geofence(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).selectExpr(*POSITION).withColumn("time_ns", F.unix_micros(F.col("time").cast("timestamp")) * 1000)
    return alerts(spark, rows, FENCE, "event_id").select("tenant_id", "device_id", "kind", "at_ns", "detail")


#: A rule on the slope of at most 64 samples of ten days. Events arrive in order of time, ten minutes of them at one time.
TREND = [Rule("rising", "Rising fast", f"tenant-{i}", "*", "WARNING", Threshold("click#slope_per_min", "ABOVE", 0.004, 0.0)) for i in range(3)]
TEN_DAYS_NS = 864_000 * 10**9
TIED = "epoch_us(time) // 600000000 * 600000000"


@query(
    "alerts_trend",
    _edges_sql(f"""(SELECT tenant_id, device_id, place AS event_id, max(t * 1000) OVER w AS at_ns, last_value(slope IGNORE NULLS) OVER w AS v FROM (
 WITH s AS (SELECT *, row_number() OVER (ORDER BY t, event_id) AS place, row_number() OVER (PARTITION BY tenant_id, device_id, metric ORDER BY t, event_id) AS rn FROM (SELECT tenant_id, device_id, metric, value, event_id, {TIED} AS t FROM {TELEMETRY}))
 SELECT a.tenant_id, a.device_id, a.place, a.t, CASE WHEN a.metric = 'click' AND count(*) >= 8 THEN 60 * CASE WHEN min(b.t) = max(b.t) THEN 0 ELSE regr_slope(b.value, (b.t - a.t) / 1e6) END END AS slope
 FROM s a JOIN s b ON a.tenant_id = b.tenant_id AND a.device_id = b.device_id AND a.metric = b.metric AND b.rn BETWEEN a.rn - 63 AND a.rn AND b.t >= a.t - 864000000000 GROUP BY a.tenant_id, a.device_id, a.place, a.t, a.metric)
 WINDOW w AS (PARTITION BY tenant_id, device_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", "v > 0.004", "v <= 0", "printf('click#slope_per_min %.3f (threshold > 0.004)', v)"),
)
def alerts_trend(spark: SparkSession, d: str) -> DataFrame:
    tied = F.floor(F.unix_micros("time") / 600_000_000) * 600_000_000
    rows = _telemetry(spark, d).withColumn("time_ns", tied * 1000).withColumn("place", F.struct("time_ns", "event_id"))
    found = alerts(spark, rows, TREND, "place", span_ns=TEN_DAYS_NS)
    return found.select("tenant_id", "device_id", "kind", "at_ns", "detail")


SILENCES = f"(SELECT tenant_id, device_id, time AS last_seen, resumed, (epoch_us(resumed) - epoch_us(time)) / 1e6 AS silence_s FROM (SELECT tenant_id, device_id, time, lead(time) OVER (PARTITION BY tenant_id, device_id ORDER BY time) AS resumed FROM (SELECT DISTINCT tenant_id, device_id, time FROM {TELEMETRY})) WHERE (epoch_us(resumed) - epoch_us(time)) / 1e6 > 21600)"


@query("silence_gaps", f"SELECT * FROM {SILENCES}")
def silence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return windows.silences(_telemetry(spark, d), 21600)


@query("silence_alerts", f"SELECT tenant_id, device_id, 'FIRED' AS kind, last_seen + INTERVAL 21600 SECOND AS at FROM {SILENCES} UNION ALL SELECT tenant_id, device_id, 'RESOLVED', resumed FROM {SILENCES}")
def silence_alerts(spark: SparkSession, d: str) -> DataFrame:
    return windows.silence_alerts(_telemetry(spark, d), 21600)


RULE_ROWS = [("r1", "tenant-0", "*"), ("r2", "tenant-1", "link-1/sys1"), ("r3", "tenant-2", "*"), ("r4", "tenant-9", "*")]


@query("rule_applicability_join", "SELECT rule_id, t.tenant_id, t.device_id, count(*) AS observations FROM " + TELEMETRY + " t JOIN (VALUES " + ", ".join(map(str, RULE_ROWS)) + ") r(rule_id, rule_tenant, rule_device) ON t.tenant_id = rule_tenant AND rule_device IN ('*', t.device_id) GROUP BY ALL")
def rule_applicability_join(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULE_ROWS, "rule_id string, rule_tenant string, rule_device string")  # a fixed list
    seen = _telemetry(spark, d)
    joined = seen.join(F.broadcast(rules), (F.col("tenant_id") == F.col("rule_tenant")) & ((F.col("rule_device") == "*") | (F.col("rule_device") == F.col("device_id"))))
    return joined.groupBy("rule_id", "tenant_id", "device_id").agg(F.count("*").alias("observations"))


# Links, duplicates, admission.

GAPS = f"(SELECT *, coalesce((sequence - lag(sequence) OVER (PARTITION BY link_id, system_id ORDER BY event_id) - 1) & 255, 0)::INT AS lost FROM {FRAMES})"


@query("seq_gaps", f"SELECT event_id, link_id, system_id, sequence, lost FROM {GAPS}")
def seq_gaps(spark: SparkSession, d: str) -> DataFrame:
    return windows.sequence_gaps(_frames(spark, d), ["link_id", "system_id"], "sequence", "event_id").select("event_id", "link_id", "system_id", "sequence", "lost")


@query("link_loss", f"SELECT link_id, system_id, count(*) AS decoded, sum(lost)::BIGINT AS lost, sum(lost) / (count(*) + sum(lost)) AS loss_ratio FROM {GAPS} GROUP BY 1, 2")
def link_loss(spark: SparkSession, d: str) -> DataFrame:
    return windows.link_loss(windows.sequence_gaps(_frames(spark, d), ["link_id", "system_id"], "sequence", "event_id"), ["link_id", "system_id"])


DEDUP = f"""WITH RECURSIVE r AS (SELECT *, {PRIORITY_SQL} AS priority, epoch_us(ts) * 1000 AS ns FROM {RECORDS}),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_id, message_id, body ORDER BY ns, event_id) AS rn FROM r WHERE priority <> 'CRITICAL'),
f AS (SELECT tenant_id, device_id, message_id, body, rn, event_id, ns AS opened, false AS suppressed FROM n WHERE rn = 1
UNION ALL SELECT n.tenant_id, n.device_id, n.message_id, n.body, n.rn, n.event_id, CASE WHEN n.ns - f.opened < {HOUR_NS * 6} THEN f.opened ELSE n.ns END, n.ns - f.opened < {HOUR_NS * 6} FROM f JOIN n ON n.tenant_id = f.tenant_id AND n.device_id = f.device_id AND n.message_id = f.message_id AND n.body = f.body AND n.rn = f.rn + 1),
a AS (SELECT event_id, priority, coalesce(f.suppressed, false) AS suppressed FROM r LEFT JOIN f USING (event_id)) """


def _deduped(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d).withColumn("priority", scalars.priority("message_id")).withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return ops.dedup(records, ["tenant_id", "device_id", "message_id", "body"], "ns", 6 * HOUR_NS, "event_id", F.col("priority") == "CRITICAL")


@query("dedup_window", DEDUP + "SELECT event_id, priority, suppressed FROM a")
def dedup_window(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d).select("event_id", "priority", "suppressed")


@query("dedup_stats", DEDUP + "SELECT count(*) FILTER (priority <> 'CRITICAL' AND NOT suppressed) AS passed, count(*) FILTER (suppressed) AS suppressed, count(*) FILTER (priority = 'CRITICAL') AS exempt, count(*) FILTER (suppressed) / count(*) FILTER (priority <> 'CRITICAL') AS suppressed_ratio FROM a")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.dedup_stats(_deduped(spark, d), F.col("priority") == "CRITICAL")


@query("priority_classify", f"SELECT event_id, message_id, {PRIORITY_SQL} AS priority FROM {RECORDS}")
def priority_classify(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("event_id", "message_id", scalars.priority("message_id").alias("priority"))


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    return ops.admission(_records(spark, d).withColumn("priority", scalars.priority("message_id")).withColumn("pressure", F.col("pressure").cast("double")), "priority", "pressure")


ADMITTED = f"(SELECT *, {SHED_SQL} AS is_shed FROM (SELECT *, {PRIORITY_SQL} AS priority FROM {RECORDS}))"


@query("shed_policy", f"SELECT event_id, priority, is_shed FROM {ADMITTED}")
def shed_policy(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).select("event_id", "priority", "is_shed")


@query("shed_stats", f"SELECT priority, count(*) FILTER (NOT is_shed) AS accepted, count(*) FILTER (is_shed) AS shed, count(*) FILTER (is_shed) / count(*) AS shed_ratio FROM {ADMITTED} GROUP BY 1")
def shed_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.shed_stats(_admitted(spark, d), "priority")


REGISTRY = [("link-0", "tenant-a"), ("link-1", "tenant-b"), ("link-2", "tenant-a")]
REGISTRY_SQL = "(VALUES " + ", ".join(map(str, REGISTRY)) + ") r(link_id, tenant_id)"


@query("link_registry_join", f"SELECT 'open' AS mode, coalesce(r.tenant_id, 'default') AS tenant_id, count(*) AS frames FROM {FRAMES} f LEFT JOIN {REGISTRY_SQL} USING (link_id) GROUP BY 2 UNION ALL SELECT 'closed', r.tenant_id, count(*) FROM {FRAMES} f JOIN {REGISTRY_SQL} USING (link_id) GROUP BY 2")
def link_registry_join(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame(REGISTRY, "link_id string, tenant_id string")
    parts = [ops.link_registry(_frames(spark, d), registry, mode).groupBy("tenant_id").agg(F.count("*").alias("frames")).select(F.lit(mode).alias("mode"), "tenant_id", "frames") for mode in ("open", "closed")]
    return parts[0].unionByName(parts[1])


# Commands.

ACKS = "(SELECT event_id AS ack_id, 'tenant-' || (user_id % 3) AS tenant_id, 'link-' || (user_id % 40) || '/sys1' AS device_id, CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 22 WHEN 2 THEN 21 ELSE 20 END AS mav_command_id, (event_id % 3) AS result, ts AS \"at\" FROM events)"


def _acks(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr("event_id AS ack_id", "'tenant-' || (user_id % 3) AS tenant_id", "'link-' || (user_id % 40) || '/sys1' AS device_id", "CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 22 WHEN 2 THEN 21 ELSE 20 END AS mav_command_id", "(event_id % 3) AS result", "ts AS at")


#: The n-th answer of a key that finds an open command settles the n-th one; answers that find none push the rest back.
ACK_MATCH = f"""(WITH q AS (SELECT tenant_id, device_id, mav_command_id, id AS command_id, NULL AS ack_id, NULL AS result, created_at AS t, 0 AS is_ack FROM {COMMANDS} WHERE state IN ('PENDING', 'SENT')
 UNION ALL SELECT tenant_id, device_id, mav_command_id, NULL, ack_id, result, "at", 1 FROM {ACKS}),
 n AS (SELECT *, sum(is_ack) OVER w AS acks, sum(2 * is_ack - 1) OVER w AS ahead, sum(1 - is_ack) OVER w AS nth FROM q WINDOW w AS (PARTITION BY tenant_id, device_id, mav_command_id ORDER BY t, is_ack, command_id NULLS FIRST, ack_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, greatest(0, max(ahead) OVER w) AS missed, greatest(0, coalesce(max(ahead) OVER (PARTITION BY tenant_id, device_id, mav_command_id ORDER BY t, is_ack, command_id NULLS FIRST, ack_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS missed_before FROM n WINDOW w AS (PARTITION BY tenant_id, device_id, mav_command_id ORDER BY t, is_ack, command_id NULLS FIRST, ack_id NULLS FIRST ROWS UNBOUNDED PRECEDING))
 SELECT a.ack_id, a.tenant_id, a.device_id, a.mav_command_id, c.command_id, CASE WHEN c.command_id IS NOT NULL THEN CASE WHEN a.result = 0 THEN 'ACKED' ELSE 'REJECTED' END END AS new_state, a.t AS "at"
 FROM m a LEFT JOIN m c ON c.is_ack = 0 AND a.missed = a.missed_before AND c.tenant_id = a.tenant_id AND c.device_id = a.device_id AND c.mav_command_id = a.mav_command_id AND c.nth = a.acks - a.missed WHERE a.is_ack = 1)"""


@query("ack_match", f"SELECT * FROM {ACK_MATCH}")
def ack_match(spark: SparkSession, d: str) -> DataFrame:
    return ops.ack_match(_acks(spark, d), _commands(spark, d))


@query("ack_stats", f"SELECT (SELECT count(*) FROM events) AS records_seen, count(*) AS acks_seen, count(command_id) AS commands_settled, count(*) - count(command_id) AS unmatched, count(*) / (SELECT count(*) FROM events) AS ack_ratio FROM {ACK_MATCH} WHERE ack_id % 50 = 0".replace(" FROM events)", " FROM events)", 1).replace(f"FROM {ACKS})", f"FROM {ACKS} WHERE ack_id % 50 = 0)", 1))
def ack_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth record of the topic is an answer, the rest ordinary telemetry."""
    return ops.ack_stats(ops.ack_match(_acks(spark, d).where("ack_id % 50 = 0"), _commands(spark, d)), _events(spark, d))


@query("outbox_claim", f"SELECT o.id, o.command_id, c.tenant_id, c.device_id FROM (SELECT o_orderkey * 2 AS id, o_orderkey AS command_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS published_at FROM orders) o JOIN {COMMANDS} c ON c.id = o.command_id WHERE published_at IS NULL ORDER BY o.id LIMIT 100")
def outbox_claim(spark: SparkSession, d: str) -> DataFrame:
    outbox = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey * 2 AS id", "o_orderkey AS command_id", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS published_at")
    return ops.outbox_claim(outbox, _commands(spark, d), 100).drop("published_at")


@query("recent_commands", f"SELECT id, device_id, state, created_at FROM {COMMANDS} WHERE tenant_id = 'tenant-1' ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_commands(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent_commands(_commands(spark, d), "tenant-1", None, 50).select("id", "device_id", "state", "created_at")


@query("expired_commands", f"SELECT id, 'EXPIRED' AS state, expires_at FROM {COMMANDS} WHERE state IN ('PENDING', 'SENT') AND expires_at < TIMESTAMP '1996-06-01'")
def expired_commands(spark: SparkSession, d: str) -> DataFrame:
    return ops.expired_commands(_commands(spark, d), F.lit("1996-06-01").cast("timestamp_ntz")).select("id", "state", "expires_at")


@query("open_command_conflicts", f"SELECT tenant_id, device_id, mav_command_id, count(*) AS open_commands FROM {COMMANDS} WHERE state IN ('PENDING', 'SENT') GROUP BY 1, 2, 3 HAVING count(*) > 1")
def open_command_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ops.open_command_conflicts(_commands(spark, d))


@query("command_states", f"SELECT command_type, mav_command_id, state, count(*) AS n, count(nullif(ack_result, -1)) AS answered FROM {COMMANDS} GROUP BY 1, 2, 3")
def command_states(spark: SparkSession, d: str) -> DataFrame:
    view = ops.command_view(_commands(spark, d)).withColumn("mav_command_id", scalars.command_number("command_type"))
    return view.groupBy("command_type", "mav_command_id", "state").agg(F.count("*").alias("n"), F.count("ack_result").alias("answered"))


@query("idempotency_duplicates", f"SELECT tenant_id, idempotency_key, count(*) AS n FROM {COMMANDS} GROUP BY 1, 2 HAVING count(*) > 1")
def idempotency_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ops.duplicate_keys(_commands(spark, d))


@query("conflict_insert", f"SELECT tenant_id, idempotency_key, min(id) AS id FROM {COMMANDS} WHERE id % 2 = 1 AND (tenant_id, idempotency_key) NOT IN (SELECT (tenant_id, idempotency_key) FROM {COMMANDS} WHERE id % 2 = 0) GROUP BY 1, 2")
def conflict_insert(spark: SparkSession, d: str) -> DataFrame:
    c = _commands(spark, d).select("tenant_id", "idempotency_key", "id")
    return ops.insert_ignore(c.where("id % 2 = 0"), c.where("id % 2 = 1"), ["tenant_id", "idempotency_key"], ["id"])


@query("orphan_orders", "SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def orphan_orders(spark: SparkSession, d: str) -> DataFrame:
    parents = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return ops.orphans(spark.read.parquet(f"{d}/orders.parquet"), parents, ["o_custkey"]).agg(F.count("*").alias("orphans"))


@query("props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("latency_percentiles", "SELECT event_type, list_sort(list(value))[ceil(0.5 * count(*))::INT] AS p50, list_sort(list(value))[ceil(0.95 * count(*))::INT] AS p95, list_sort(list(value))[ceil(0.99 * count(*))::INT] AS p99, max(value) AS max FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rank: the first value whose cumulative share reaches the level."""
    return ops.nearest_ranks(_events(spark, d), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


# Binary codecs. The queries decode captures that are made of the event table.

CAPTURE = 512
#: What becomes of each event: frames with a wrong checksum, of an unknown message, of version 1, signed, and ordinary ones.
FATE = "CASE WHEN event_id % 22 = 0 AND event_id % 256 < 200 THEN 'bad' WHEN event_id % 19 = 0 THEN 'unknown' WHEN event_id % 13 = 0 THEN 'v1' WHEN event_id % 17 = 0 THEN 'signed' ELSE 'v2' END"
#: Before some frames stand three bytes of noise, before others a false start: a header that claims the bytes after it.
NOISE, FALSE_START = "event_id % 7 = 0", "event_id % 16 = 9"
SENT = f"(SELECT *, CASE WHEN fate = 'bad' OR event_id % 5 = 0 THEN 33 WHEN event_id % 5 = 1 THEN 74 WHEN event_id % 5 = 2 THEN 1 WHEN event_id % 5 = 3 THEN 24 ELSE 30 END AS message_id FROM (SELECT event_id, value, 'cap-' || (event_id // {CAPTURE}) AS path, (event_id % 256)::INT AS sequence, {FATE} AS fate FROM events))"
DECODED = f"(SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) - 1 AS arrival, coalesce((sequence - lag(sequence) OVER (PARTITION BY path ORDER BY event_id) - 1) & 255, 0) AS lost FROM {SENT} WHERE fate NOT IN ('bad', 'unknown'))"


def _mavlink_payload(number: int, event: int, value: float) -> bytes:
    """Fields by the rules that METRIC_SQL repeats."""
    n = event % 100
    if number == 33:
        return struct.pack("<IiiiihhhH", n, n, 2 * n, 3 * n, n, n, n + 1, 0, 256 + n)
    if number == 74:
        return struct.pack("<ffffhH", value, float(n), 1.5, -2.0, n, 256 + n)
    if number == 1:
        return struct.pack("<IIIHHhHHHHHHb", 0, 0, 0, 10 * n, 12000 + n if n % 10 else 65535, n if n % 9 else -1, n, 0, 0, 0, 0, 0, n if n % 8 else -1)
    if number == 24:
        return struct.pack("<QiiiHHHHBB", event, n, 2 * n, 3 * n, 100 + n if n % 11 else 65535, 0, 0, 0, n % 7, n % 30)
    return struct.pack("<Iffffff", n, value, n * 0.5, -1.25, n * 0.25, 0.0, -3.5)


def _mavlink_frame(event: int, value: float) -> bytes:
    """One event as bytes on the wire. A false start claims five bytes of payload, which its message has, and a checksum, and
    takes them from the frame behind it: reading gives up its ten bytes one by one, and loses nothing."""
    fate = "bad" if event % 22 == 0 and event % 256 < 200 else "unknown" if event % 19 == 0 else "v1" if event % 13 == 0 else "signed" if event % 17 == 0 else "v2"
    number = 33 if fate == "bad" else (33, 74, 1, 24, 30)[event % 5]
    payload = _mavlink_payload(number, event, value)
    seed = bytes([CORE_DIALECT[number].seed])
    if fate == "v1":
        magic, head = b"\xfe", bytes([len(payload), event % 256, 1, 1, number])
    else:
        # Version 2 leaves out zeros at the end; the damaged frames are whole.
        payload = payload if fate == "bad" else payload.rstrip(b"\0") or b"\0"
        magic, head = b"\xfd", bytes([len(payload), fate == "signed", 0, event % 256, 1, 1]) + (9999 if fate == "unknown" else number).to_bytes(3, "little")
    crc = b"\0\0" if fate == "bad" else mcrf4xx(seed, mcrf4xx(head + payload)).to_bytes(2, "little")
    noise = (b"\0\0\0" if event % 7 == 0 else b"") + (bytes([0xFD, 5, 0, 0, 0, 1, 1, 0, 0, 0]) if event % 16 == 9 else b"")
    return noise + magic + head + payload + crc + (bytes(13) if fate == "signed" else b"")


def _hk_payload(code: int, event: int) -> bytes:
    """Fields by the rules that HK_FIELDS_SQL repeats."""
    values = [(event * (i + 3)) % 100 if kind[0] == "u" else event % 2 if kind == "bool" else (event * (i + 3)) % 1000 * 0.25 for i, (_, kind, _) in enumerate(HK_LAYOUTS[code][1])]
    return struct.pack("<" + "".join(hk.FORMATS[kind][1:] for _, kind, _ in HK_LAYOUTS[code][1]), *values)


def _hk_frame(event: int, value: float) -> bytes:
    """A log record; every eleventh has a wrong checksum, every seventh stands after noise."""
    frame = hk.encode(event % 5 + 1, _hk_payload(event % 5 + 1, event))
    return (b"\0\0\0" if event % 7 == 0 else b"") + (frame[:-2] + bytes([frame[-2] ^ 0xFF, frame[-1]]) if event % 11 == 0 else frame)


def _captures(spark: SparkSession, d: str, frame: Callable[[int, float], bytes]) -> DataFrame:
    """path and content: the frames of so many successive events each, in their order."""
    ship_package(spark)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, parts = None, []
        for batch in batches:
            for p, event, value in zip(*(batch.column(c).to_pylist() for c in ("path", "event_id", "value")), strict=True):
                if p != path:
                    if parts:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])
                    path, parts = p, []
                parts.append(frame(event, value))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

    rows = _events(spark, d).select(F.expr(f"'cap-' || CAST(event_id DIV {CAPTURE} AS STRING)").alias("path"), "event_id", "value")
    return rows.repartition("path").sortWithinPartitions("path", "event_id").mapInArrow(join, "path string, content binary")


@query("mavlink_decode", f"SELECT path, arrival, message_id, sequence, 1::INT AS system_id, 1::INT AS component_id, CASE WHEN fate = 'v1' THEN 1 ELSE 2 END AS version, CASE WHEN fate = 'signed' THEN 1 ELSE 0 END AS incompat FROM {DECODED}")
def mavlink_decode(spark: SparkSession, d: str) -> DataFrame:
    frames = sources.mavlink_frames(spark, _captures(spark, d, _mavlink_frame))
    return frames.select("path", "arrival", "message_id", "sequence", "system_id", "component_id", "version", "incompat")


@query("mavlink_stats", f"""SELECT path, count(*) FILTER (fate NOT IN ('bad', 'unknown')) AS decoded, (count(*) FILTER (fate = 'bad') + count(*) FILTER ({FALSE_START}))::BIGINT AS crc_errors, count(*) FILTER (fate = 'unknown') AS unknown,
 (40 * count(*) FILTER (fate = 'bad') + 3 * count(*) FILTER ({NOISE}) + 10 * count(*) FILTER ({FALSE_START}))::BIGINT AS resync_bytes, (SELECT coalesce(sum(lost), 0)::BIGINT FROM {DECODED} x WHERE x.path = s.path) AS lost,
 count(*) FILTER (fate = 'signed') AS signed, count(*) FILTER (fate = 'v1') AS v1, max(CASE WHEN fate NOT IN ('bad', 'unknown') THEN 1 ELSE 0 END)::BIGINT AS endpoints FROM {SENT} s GROUP BY path""")
def mavlink_stats(spark: SparkSession, d: str) -> DataFrame:
    return sources.mavlink_stats(spark, _captures(spark, d, _mavlink_frame))


#: The metrics of the messages, by the rules that made their payloads; null: the sender does not know.
METRIC_SQL = {
    33: [("position.latitude_deg", "n / 1e7"), ("position.longitude_deg", "2 * n / 1e7"), ("position.altitude_msl_m", "3 * n / 1000.0"), ("position.altitude_rel_m", "n / 1000.0"), ("velocity.north_ms", "n / 100.0"), ("velocity.east_ms", "(n + 1) / 100.0"), ("velocity.down_ms", "0.0"), ("attitude.heading_deg", "(256 + n) / 100.0")],
    74: [("speed.airspeed_ms", "value::FLOAT"), ("speed.groundspeed_ms", "n"), ("position.altitude_hud_m", "1.5"), ("speed.climb_ms", "-2.0"), ("attitude.heading_hud_deg", "n"), ("power.throttle_pct", "256 + n")],
    1: [("power.load_pct", "n"), ("power.battery_v", "CASE WHEN n % 10 <> 0 THEN (12000 + n) / 1000.0 END"), ("power.current_a", "CASE WHEN n % 9 <> 0 THEN n / 100.0 END"), ("power.battery_remaining_pct", "CASE WHEN n % 8 <> 0 THEN n END"), ("link.drop_rate_pct", "n / 100.0")],
    24: [("gps.fix_type", "n % 7"), ("gps.satellites", "n % 30"), ("gps.hdop", "CASE WHEN n % 11 <> 0 THEN (100 + n) / 100.0 END")],
    30: [("attitude.roll_rad", "value::FLOAT"), ("attitude.pitch_rad", "n * 0.5"), ("attitude.yaw_rad", "-1.25"), ("attitude.rollspeed_rads", "n * 0.25"), ("attitude.pitchspeed_rads", "0.0"), ("attitude.yawspeed_rads", "-3.5")],
}


@query("metric_extract", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT path, arrival, '{m}' AS metric, round(({x})::DOUBLE, 9) AS value FROM (SELECT *, event_id % 100 AS n FROM {DECODED}) WHERE message_id = {i}" for i, fields in METRIC_SQL.items() for m, x in fields) + ") WHERE value IS NOT NULL")
def metric_extract(spark: SparkSession, d: str) -> DataFrame:
    frames = sources.mavlink_frames(spark, _captures(spark, d, _mavlink_frame))
    return _rounded(binary.metrics(frames), "value", digits=9).select("path", "arrival", "metric", "value")


HK_GOOD = f"(SELECT event_id, 'cap-' || (event_id // {CAPTURE}) AS path, (event_id % 5 + 1)::INT AS record_type, (row_number() OVER (PARTITION BY event_id // {CAPTURE} ORDER BY event_id) - 1)::INT AS seq FROM events WHERE event_id % 11 <> 0)"


@query("hk_decode", f"SELECT path, seq, record_type, CASE record_type {' '.join(f'WHEN {c} THEN {size}' for c, (_, _, size) in HK_LAYOUTS.items())} END::INT AS size FROM {HK_GOOD}")
def hk_decode(spark: SparkSession, d: str) -> DataFrame:
    return sources.hk_records(spark, _captures(spark, d, _hk_frame)).select("path", "seq", "record_type", F.octet_length("payload").alias("size"))


HK_SIZE = f"CASE event_id % 5 + 1 {' '.join(f'WHEN {c} THEN {size + hk.FRAME}' for c, (_, _, size) in HK_LAYOUTS.items())} END"


@query("hk_stats", f"SELECT path, count(*) FILTER (good) AS frames, count(*) FILTER (NOT good) AS crc_errors, sum(noise + CASE WHEN good THEN 0 ELSE size - 1 END)::BIGINT - max(tail)::BIGINT AS resync_bytes, max(tail)::BIGINT AS tail_bytes FROM (SELECT 'cap-' || (event_id // {CAPTURE}) AS path, event_id % 11 <> 0 AS good, CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END AS noise, {HK_SIZE} AS size, CASE WHEN event_id % 11 = 0 AND event_id = max(event_id) OVER (PARTITION BY event_id // {CAPTURE}) THEN 6 ELSE 0 END AS tail FROM events) GROUP BY path")
def hk_stats(spark: SparkSession, d: str) -> DataFrame:
    return sources.hk_stats(spark, _captures(spark, d, _hk_frame))


def _hk_fields(code: int) -> None:
    name, layout, _ = HK_LAYOUTS[code]
    rule = lambda i, kind: f"((event_id * {i + 3}) % 100)::BIGINT" if kind[0] == "u" else "event_id % 2 = 1" if kind == "bool" else f"((event_id * {i + 3}) % 1000 * 0.25)::DOUBLE"
    sql = ", ".join(f"{rule(i, kind)} AS {field}" for i, (field, kind, _) in enumerate(layout))

    @query(f"hk_{name.lower()}", f"SELECT path, seq, {sql} FROM {HK_GOOD} WHERE record_type = {code}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return binary.hk_fields(sources.hk_records(spark, _captures(spark, d, _hk_frame)), code)


for _code in HK_LAYOUTS:
    _hk_fields(_code)

#: 32 bits of a float: an exponent and a mantissa that every event gives.
F32_BITS = "(CAST(event_id % 250 + 1 AS BIGINT) * 8388608 + (event_id * 7919) % 8388608)"


@query("f32_fields", "SELECT event_id, (1 + ((event_id * 7919) % 8388608) / 8388608.0::DOUBLE) * pow(2.0::DOUBLE, (event_id % 250 + 1) - 127) AS value FROM events")
def f32_fields(spark: SparkSession, d: str) -> DataFrame:
    big = F.lpad(F.hex(F.expr(F32_BITS)), 8, "0")
    little = F.unhex(F.concat(*(F.substring(big, i, 2) for i in (7, 5, 3, 1))))
    return _events(spark, d).select("event_id", binary.read(little, "f32", 0).cast("double").alias("value"))


#: Both checksums a byte at a time, without tables.
CRC_SQL = """SELECT event_id,
 list_reduce(list_prepend(65535, b), lambda c, x: xor(xor(xor(c >> 8, (xor(xor(x, c & 255), (xor(x, c & 255) << 4) & 255) << 8)), (xor(xor(x, c & 255), (xor(x, c & 255) << 4) & 255) << 3)), (xor(xor(x, c & 255), (xor(x, c & 255) << 4) & 255) >> 4)) & 65535)::INT AS mcrf4xx,
 list_reduce(list_prepend(65535, b), lambda c, x: xor(xor(xor((c << 8) & 65535, (xor(xor(c >> 8, x), xor(c >> 8, x) >> 4) << 12) & 65535), (xor(xor(c >> 8, x), xor(c >> 8, x) >> 4) << 5) & 65535), xor(xor(c >> 8, x), xor(c >> 8, x) >> 4)))::INT AS ccitt_false
 FROM (SELECT event_id, list_transform(string_split(event_id || event_type || (user_id % 1000), ''), lambda x: ascii(x)) AS b FROM events)"""


@query("crc_check", CRC_SQL)
def crc_check(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    text = F.concat(F.col("event_id").cast("string"), "event_type", (F.col("user_id") % 1000).cast("string")).cast("binary")
    return _events(spark, d).select("event_id", crc16_mcrf4xx(text).alias("mcrf4xx"), crc16_ccitt_false(text).alias("ccitt_false"))


@query("ingest_stats", f"SELECT tenant_id, count(*) AS records, count(*) FILTER (m > 0) AS with_metrics, count(*) FILTER (m = 0) AS without_metrics, sum(m)::BIGINT AS rows_written, sum(m) / count(*) AS rows_per_record FROM (SELECT tenant_id, CASE message_id WHEN 33 THEN CASE WHEN event_id % 4 = 0 THEN 7 ELSE 8 END WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 4 ELSE 5 END ELSE 0 END AS m FROM (SELECT event_id, tenant_id, CASE message_id WHEN 42 THEN 1 ELSE message_id END AS message_id FROM {RECORDS})) GROUP BY 1")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    """Positions of which a quarter has no heading, and system states that lack none, one or three of their values."""
    unknown = lambda some, bytes_: F.when(some, F.lit("ff" * bytes_)).otherwise(F.lit("01" * bytes_))
    third = F.col("event_id") % 3
    position = F.concat(F.lit("01" * 26), unknown(F.col("event_id") % 4 == 0, 2))
    state = F.concat(F.lit("01" * 14), unknown(third == 0, 2), unknown(third < 2, 2), F.lit("01" * 12), unknown(third == 0, 1))
    rows = _records(spark, d).withColumn("message_id", F.when(F.col("message_id") == 42, 1).otherwise(F.col("message_id")))
    payload = F.unhex(F.when(F.col("message_id") == 33, position).otherwise(state))
    return telemetry.ingest_stats(rows.select("event_id", "tenant_id", "message_id", payload.alias("payload")), "event_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["flagship", "oracle_sql", "queries"]
