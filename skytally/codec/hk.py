"""Capsule log records: 'H' 'K' 1, type, length, payload, checksum (little-endian)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from skytally.codec.crc import ccitt_false
from skytally.schema import HK_LAYOUTS

MAGIC, FRAME = b"HK\x01", 7
FORMATS = {"u8": "<B", "bool": "<B", "u16": "<H", "u32": "<I", "f32": "<f", "f64": "<d"}
#: Mission states by code, and short field names of the canonical text lines.
STATES = ("BOOT", "SELFTEST", "ATTACHED", "ARMED", "RELEASE", "DESCENT", "LANDED", "RECOVERY")
LINE_NAMES = {
    "META": ("t", "fw", "reset", "logver"),
    "ENV": ("t", "state", "p", "alt", "tbmp", "t1", "rh1", "t2", "rh2", "vbat", "soc"),
    "IMU": ("t", "ax", "ay", "az", "gx", "gy", "gz", "roll", "pitch"),
    "GPS": ("t", "lat", "lon", "alt", "spd", "crs", "sats", "fix", "valid"),
    "EVENT": ("t", "from", "to", "arg"),
}


@dataclass
class Stats:
    frames: int = 0
    crc_errors: int = 0
    resync_bytes: int = 0
    tail_bytes: int = 0

    def row(self) -> tuple[int, ...]:
        return tuple(getattr(self, f.name) for f in fields(self))


@dataclass
class Decoder:
    rest: bytes = b""
    stats: Stats = field(default_factory=Stats)

    def feed(self, chunk: bytes, end: bool = False) -> Iterator[tuple[int, bytes]]:
        """(type, payload) of each record. What remains at the end is the tail."""
        data, at = self.rest + chunk, 0
        while len(data) - at >= FRAME:
            if data[at : at + 3] != MAGIC:
                at += 1
                self.stats.resync_bytes += 1
                continue
            stop = at + 5 + data[at + 4]
            if stop + 2 > len(data):
                if not end:
                    break
                at += 1
                self.stats.resync_bytes += 1
            elif ccitt_false(data[at + 2 : stop]) == int.from_bytes(data[stop : stop + 2], "little"):
                self.stats.frames += 1
                yield data[at + 3], bytes(data[at + 5 : stop])
                at = stop + 2
            else:
                self.stats.crc_errors += 1
                at += 1
        self.rest = data[at:]
        if end:
            self.stats.tail_bytes, self.rest = len(self.rest), b""


def decode(data: bytes) -> tuple[list[tuple[int, bytes]], Stats]:
    decoder = Decoder()
    return list(decoder.feed(data, end=True)), decoder.stats


def type_name(code: int) -> str:
    return HK_LAYOUTS[code][0] if code in HK_LAYOUTS else "UNKNOWN"


def state_name(code: int) -> str:
    return STATES[code] if 0 <= code < len(STATES) else f"?{code}"


def parse(code: int, payload: bytes) -> dict[str, object]:
    """The fields of a typed payload. A payload too short for its type is an error."""
    _, layout, size = HK_LAYOUTS[code]
    if len(payload) < size:
        raise ValueError(f"{type_name(code)} needs {size} bytes, got {len(payload)}")
    out = {name: struct.unpack_from(FORMATS[kind], payload, offset)[0] for name, kind, offset in layout}
    return {k: bool(v) if (k, "bool") in {(n, t) for n, t, _ in layout} else v for k, v in out.items()}


def line(code: int, payload: bytes) -> str:
    """Canonical text: floats as their bits in hex, so that it is exact."""
    if code not in HK_LAYOUTS:
        return f"UNKNOWN,type={code},payload={payload.hex()}"
    name, layout, _ = HK_LAYOUTS[code]
    parts = []
    for label, (_, kind, offset) in zip(LINE_NAMES[name], layout, strict=True):
        size = struct.calcsize(FORMATS[kind])
        raw = payload[offset : offset + size]
        parts.append(f"{label}={raw[::-1].hex()}" if kind in ("f32", "f64") else f"{label}={int.from_bytes(raw, 'little')}")
    return ",".join([name, *parts])


def encode(code: int, payload: bytes) -> bytes:
    body = bytes([1, code, len(payload)]) + payload
    return b"HK" + body + ccitt_false(body).to_bytes(2, "little")
