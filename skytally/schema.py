"""Schemas of the canonical relations, and the declarative catalogue of decoded metrics."""

from __future__ import annotations

from typing import NamedTuple

ENVELOPE = "tenant_id string, device_id string, source string, message_id int, sequence int, system_id int, component_id int, received_at_nanos bigint, priority string, payload binary"
TELEMETRY = "time timestamp, tenant_id string, device_id string, metric string, value double"
ROLLUP = "bucket timestamp, tenant_id string, device_id string, metric string, avg_value double, min_value double, max_value double, samples bigint, sum_value double"
FRAME = "version int, sequence int, system_id int, component_id int, message_id int, incompat int, compat int, payload binary"
HK_RECORD = "record_type int, payload binary"
ALERT = "rule_id string, rule_name string, tenant_id string, device_id string, severity string, kind string, condition_since_ns bigint, at_ns bigint, debounce_ns bigint, detail string"
COMMAND = "id string, tenant_id string, device_id string, idempotency_key string, command_type string, params map<string,double>, state string, ack_result int, ack_at timestamp, issued_by string, created_at timestamp, updated_at timestamp, expires_at timestamp, mav_command_id int"

SERIES_KEY = ("tenant_id", "device_id", "metric")


class Field(NamedTuple):
    """One metric: which message it comes from, and how its raw value is read and scaled."""

    message_id: int
    metric: str
    kind: str
    offset: int
    divisor: float = 1.0
    absent: int | None = None  # the raw value that means "not known"


#: The curated metrics of five messages, by wire offset.
METRICS = (
    Field(33, "position.latitude_deg", "i32", 4, 1e7),
    Field(33, "position.longitude_deg", "i32", 8, 1e7),
    Field(33, "position.altitude_msl_m", "i32", 12, 1000.0),
    Field(33, "position.altitude_rel_m", "i32", 16, 1000.0),
    Field(33, "velocity.north_ms", "i16", 20, 100.0),
    Field(33, "velocity.east_ms", "i16", 22, 100.0),
    Field(33, "velocity.down_ms", "i16", 24, 100.0),
    Field(33, "attitude.heading_deg", "u16", 26, 100.0, 65535),
    Field(30, "attitude.roll_rad", "f32", 4),
    Field(30, "attitude.pitch_rad", "f32", 8),
    Field(30, "attitude.yaw_rad", "f32", 12),
    Field(30, "attitude.rollspeed_rads", "f32", 16),
    Field(30, "attitude.pitchspeed_rads", "f32", 20),
    Field(30, "attitude.yawspeed_rads", "f32", 24),
    Field(74, "speed.airspeed_ms", "f32", 0),
    Field(74, "speed.groundspeed_ms", "f32", 4),
    Field(74, "position.altitude_hud_m", "f32", 8),
    Field(74, "speed.climb_ms", "f32", 12),
    Field(74, "attitude.heading_hud_deg", "i16", 16),
    Field(74, "power.throttle_pct", "u16", 18),
    Field(1, "power.load_pct", "u16", 12, 10.0),
    Field(1, "power.battery_v", "u16", 14, 1000.0, 65535),
    Field(1, "power.current_a", "i16", 16, 100.0, -1),
    Field(1, "power.battery_remaining_pct", "i8", 30, 1.0, -1),
    Field(1, "link.drop_rate_pct", "u16", 18, 100.0),
    Field(24, "gps.fix_type", "u8", 28),
    Field(24, "gps.satellites", "u8", 29),
    Field(24, "gps.hdop", "u16", 20, 100.0, 65535),
)

#: Layouts of the capsule log's typed payloads (name, kind, offset), by record type.
HK_LAYOUTS = {
    1: ("META", (("time_ms", "u32", 0), ("firmware_version", "u16", 4), ("reset_cause", "u8", 6), ("log_version", "u8", 7)), 8),
    2: ("ENV", (("time_ms", "u32", 0), ("state", "u8", 4), ("pressure_pa", "f32", 5), ("altitude_m", "f32", 9), ("baro_temp_c", "f32", 13), ("temp1_c", "f32", 17), ("humidity1_pct", "f32", 21), ("temp2_c", "f32", 25), ("humidity2_pct", "f32", 29), ("battery_v", "f32", 33), ("state_of_charge", "f32", 37)), 41),
    3: ("IMU", (("time_ms", "u32", 0), ("accel_x", "f32", 4), ("accel_y", "f32", 8), ("accel_z", "f32", 12), ("gyro_x", "f32", 16), ("gyro_y", "f32", 20), ("gyro_z", "f32", 24), ("roll_deg", "f32", 28), ("pitch_deg", "f32", 32)), 36),
    4: ("GPS", (("time_ms", "u32", 0), ("latitude", "f64", 4), ("longitude", "f64", 12), ("altitude_m", "f32", 20), ("speed_ms", "f32", 24), ("course_deg", "f32", 28), ("satellites", "u8", 32), ("fix_quality", "u8", 33), ("valid", "bool", 34)), 35),
    5: ("EVENT", (("time_ms", "u32", 0), ("from_state", "u8", 4), ("to_state", "u8", 5), ("argument", "u16", 6)), 8),
}
