"""Field readers for little-endian payloads, and metric extraction, as JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.schema import HK_LAYOUTS, METRICS, Field

WIDTH = {"u8": 1, "i8": 1, "bool": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "f32": 4, "i64": 8, "f64": 8}


def _hex(payload: Column, offset: int, width: int) -> Column:
    """The bytes in hex, most significant first; bytes past the end are zero."""
    h = F.rpad(F.hex(F.substring(payload, offset + 1, width)), 2 * width, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)))


def unsigned(payload: Column, offset: int, width: int) -> Column:
    return F.conv(_hex(payload, offset, width), 16, 10).cast("long")


def signed(payload: Column, offset: int, width: int) -> Column:
    u, half = unsigned(payload, offset, width), 1 << (8 * width - 1)
    return F.when(u >= half, u - 2 * half).otherwise(u)


def _float(sign: Column, exponent: Column, mantissa: Column, bits: int, bias: int) -> Column:
    """Exact in double: scaled integers and powers of two only."""
    top = 2 * bias + 1
    magnitude = F.when(exponent == 0, mantissa * F.lit(2.0 ** (1 - bias - bits))).when(exponent == top, F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise((1 + mantissa / F.lit(float(1 << bits))) * F.pow(F.lit(2.0), exponent - bias))
    return F.when(sign == 1, -magnitude).otherwise(magnitude)


def f32(payload: Column, offset: int) -> Column:
    u = unsigned(payload, offset, 4)
    return _float(F.shiftright(u, 31), F.shiftright(u, 23).bitwiseAND(0xFF), u.bitwiseAND(0x7FFFFF), 23, 127)


def f64(payload: Column, offset: int) -> Column:
    low, high = unsigned(payload, offset, 4), unsigned(payload, offset + 4, 4)
    mantissa = high.bitwiseAND(0xFFFFF) * F.lit(1 << 32) + low
    e = F.shiftright(high, 20).bitwiseAND(0x7FF)
    sign = F.shiftright(high, 31)
    normal = (1 + mantissa / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), e - 1023)
    tiny = mantissa.cast("double") * F.pow(F.lit(2.0), F.lit(-537.0)) * F.pow(F.lit(2.0), F.lit(-537.0))
    magnitude = F.when(e == 0, tiny).when(e == 2047, F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(normal)
    return F.when(sign == 1, -magnitude).otherwise(magnitude)


def read(payload: Column | str, kind: str, offset: int) -> Column:
    """The field; zero where the payload is too short."""
    p = F.col(payload) if isinstance(payload, str) else payload
    if kind == "f32":
        return f32(p, offset)
    if kind == "f64":
        return f64(p, offset)
    if kind == "bool":
        return unsigned(p, offset, 1) != 0
    if kind == "i64":
        return F.conv(_hex(p, offset, 8), 16, -10).cast("long")
    return (signed if kind[0] == "i" else unsigned)(p, offset, WIDTH[kind])


def _value(payload: Column, f: Field) -> Column:
    raw = read(payload, f.kind, f.offset)
    value = raw.cast("double") / F.lit(f.divisor) if f.divisor != 1.0 else raw.cast("double")
    return value if f.absent is None else F.when(raw != f.absent, value)


def metrics(frames: DataFrame, message_id: str = "message_id", payload: str = "payload") -> DataFrame:
    """One row per metric of each curated frame: all columns but the payload, and metric, value. Other messages give none.

    Messages are filtered before their payload is looked at; a metric with an "unknown" raw value gives no row. Where the
    input has a ``source`` column, only frames of the telemetry protocol count: ids of other protocols mean other things.
    """
    ids = sorted({f.message_id for f in METRICS})
    rows = frames.where(F.col(message_id).isin(*ids))
    if "source" in frames.columns:
        rows = rows.where(F.col("source") == "MAVLINK")
    p = F.col(payload)

    def of(number: int) -> Column:
        return F.array(*(F.struct(F.lit(f.metric).alias("metric"), _value(p, f).alias("value")) for f in METRICS if f.message_id == number))

    case = reduce(lambda acc, number: acc.when(F.col(message_id) == number, of(number)), ids[1:], F.when(F.col(message_id) == ids[0], of(ids[0])))
    keep = [c for c in frames.columns if c != payload]
    exploded = rows.select(*keep, F.explode(F.filter(case, lambda x: x["value"].isNotNull())).alias("_m"))
    return exploded.select(*keep, "_m.metric", "_m.value")


def hk_fields(records: DataFrame, record_type: int) -> DataFrame:
    """Typed columns of one record type; payloads too short for it are left out."""
    _, layout, size = HK_LAYOUTS[record_type]
    rows = records.where((F.col("record_type") == record_type) & (F.octet_length("payload") >= size))
    keep = [c for c in records.columns if c not in ("record_type", "payload")]
    return rows.select(*keep, *(read("payload", kind, offset).alias(name) for name, kind, offset in layout))
