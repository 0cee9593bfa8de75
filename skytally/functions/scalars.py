"""Scalar expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
#: Seconds from the epoch to 2000-01-03, a Monday: where buckets begin.
ORIGIN_S = 946857600
#: Message ids by priority; the rest is NORMAL.
CRITICAL, HIGH = (0, 1, 77, 253), (24, 30, 32, 33, 74, 147)
BULK = (26, 27, 35, 36, 65, 125, 152, 163, 164, 165, 178, 241)
HK_PRIORITY = {1: "CRITICAL", 5: "CRITICAL", 2: "HIGH", 4: "HIGH", 3: "BULK"}
PRIORITY_RANK = {"CRITICAL": 0, "HIGH": 1, "NORMAL": 2, "BULK": 3}
#: Pressure from which on a priority is shed; CRITICAL never is.
SHED_FROM = {"HIGH": 0.95, "NORMAL": 0.85, "BULK": 0.75}
#: Command types and the numbers they have on the wire.
COMMAND_NUMBERS = {"ARM": 400, "DISARM": 400, "TAKEOFF": 22, "LAND": 21, "RETURN_TO_LAUNCH": 20}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def time_bucket(seconds: int, time: Column | str) -> Column:
    """Start of the bucket that holds the time; buckets begin at the origin, not at the epoch."""
    micros, width = F.unix_micros(_col(time).cast("timestamp")) - ORIGIN_S * 1_000_000, seconds * 1_000_000
    return F.timestamp_micros(_col(time).cast("timestamp").isNotNull().cast("long") * (micros - F.pmod(micros, F.lit(width)) + ORIGIN_S * 1_000_000))


def instant(nanos: Column | str) -> Column:
    """Timestamp (microseconds, rounded down) of nanoseconds since the epoch."""
    n = _col(nanos).cast("long")
    return F.timestamp_micros(((n - F.pmod(n, F.lit(1000))) / 1000).cast("decimal(20,0)").cast("long"))


def routing_key(tenant: Column | str, device: Column | str) -> Column:
    return F.concat_ws("/", _col(tenant), _col(device))


def device_id(link: Column | str, system: Column | str) -> Column:
    return F.concat(_col(link), F.lit("/sys"), _col(system).cast("string"))


def alert_key(rule: Column | str, device: Column | str) -> Column:
    return F.concat_ws("/", _col(rule), _col(device))


def derived_name(metric: Column | str, statistic: str) -> Column:
    return F.concat(_col(metric), F.lit(f"#{statistic}"))


def base_metric(name: Column | str) -> Column:
    """What stands before the first '#'; null if there is none or it comes first."""
    return F.when(F.instr(_col(name), "#") > 1, F.substring_index(_col(name), "#", 1))


def priority(message_id: Column | str) -> Column:
    m = _col(message_id)
    return F.when(m.isin(*CRITICAL), "CRITICAL").when(m.isin(*HIGH), "HIGH").when(m.isin(*BULK), "BULK").otherwise("NORMAL")


def hk_priority(record_type: Column | str) -> Column:
    out = F.lit("NORMAL")
    for code, name in HK_PRIORITY.items():
        out = F.when(_col(record_type) == code, name).otherwise(out)
    return out


def priority_rank(name: Column | str) -> Column:
    out = F.lit(None).cast("int")
    for label, rank in PRIORITY_RANK.items():
        out = F.when(_col(name) == label, rank).otherwise(out)
    return out


def shed(priority_name: Column | str, pressure: Column | str) -> Column:
    """Whether a record of this priority is refused at this pressure."""
    out = F.lit(False)
    for label, bound in SHED_FROM.items():
        out = F.when(_col(priority_name) == label, _col(pressure) >= bound).otherwise(out)
    return out


def shed_band(pressure: Column | str) -> Column:
    p = _col(pressure)
    return F.when(p >= 0.95, "HIGH").when(p >= 0.85, "NORMAL").when(p >= 0.75, "BULK").when(p >= 0.60, "PAUSE").otherwise("OPEN")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), F.lit(0.0))


def breaches(value: Column | str, comparison: str, bound: Column | float) -> Column:
    """Strictly BELOW or ABOVE; missing and NaN never breach."""
    v, b = _col(value), bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.coalesce((v < b if comparison == "BELOW" else v > b) & ~F.isnan(v), F.lit(False))


def ack_state(result: Column | str) -> Column:
    return F.when(_col(result) == 0, "ACKED").otherwise("REJECTED")


def command_number(command_type: Column | str) -> Column:
    out = F.lit(None).cast("int")
    for name, number in COMMAND_NUMBERS.items():
        out = F.when(_col(command_type) == name, number).otherwise(out)
    return out


def arm_param(command_type: Column | str) -> Column:
    return F.when(_col(command_type) == "ARM", 1.0).when(_col(command_type) == "DISARM", 0.0)


def copy_escaped(text: Column | str) -> Column:
    """Backslash, tab, newline and carriage return as text-copy formats want them."""
    return F.replace(F.replace(F.replace(F.replace(_col(text), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def slope_per_minute(value: Column | str, seconds: Column | str) -> Column:
    """Least-squares slope as an aggregate; 0 without spread in time."""
    return F.coalesce(F.regr_slope(_col(value), _col(seconds)), F.lit(0.0)) * 60
