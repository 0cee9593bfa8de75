"""MAVLink v1 and v2 frames: a resumable decoder, an encoder, and the two command messages."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from skytally.codec.crc import mcrf4xx
from skytally.codec.dialect import CORE_DIALECT, Message
from skytally.codec.framing import V1, V2, Stats, Tracker, known, scan


@dataclass
class Decoder:
    """Feed bytes in any chunks; frames come out in order. Whatever fails to validate gives up one byte, counted as such."""

    dialect: dict[int, Message] = field(default_factory=lambda: CORE_DIALECT)
    rest: bytes = b""
    tracker: Tracker = field(default_factory=Tracker)
    stats: Stats = field(default_factory=Stats)

    def feed(self, chunk: bytes, end: bool = False) -> Iterator[tuple]:
        """(version, sequence, system, component, message id, incompat, compat, payload) of each whole frame."""
        data = self.rest + chunk
        frames, done = scan(np.frombuffer(data, np.uint8), known(self.dialect), end, self.stats)
        self.tracker.follow(frames, self.stats)
        self.rest = data[done:]
        yield from ((*row[:-2], data[row[-2] : row[-1]]) for row in zip(*(c.tolist() for c in frames[1:]), strict=True))


def decode(data: bytes, dialect: dict[int, Message] | None = None) -> tuple[list[tuple], Stats]:
    """All frames of a finished stream, and its counters."""
    decoder = Decoder(dialect or CORE_DIALECT)
    return list(decoder.feed(data, end=True)), decoder.stats


@dataclass
class Encoder:
    """Frames for one endpoint; the sequence number goes on by itself."""

    system: int
    component: int
    dialect: dict[int, Message] = field(default_factory=lambda: CORE_DIALECT)
    sequence: int = 0

    def v2(self, number: int, payload: bytes) -> bytes:
        if number not in self.dialect:
            raise ValueError(f"message {number} is not in the dialect")
        body = payload.rstrip(b"\0") or payload[:1] or b"\0"
        return self._frame(bytes([len(body), 0, 0, self._next(), self.system, self.component]) + number.to_bytes(3, "little"), V2, number, body)

    def v1(self, number: int, payload: bytes) -> bytes:
        if number not in self.dialect:
            raise ValueError(f"message {number} is not in the dialect")
        if number > 255 or len(payload) > 255:
            raise ValueError("version 1 has ids and payloads up to 255")
        return self._frame(bytes([len(payload), self._next(), self.system, self.component, number]), V1, number, payload)

    def _next(self) -> int:
        self.sequence, now = (self.sequence + 1) % 256, self.sequence
        return now

    def _frame(self, head: bytes, magic: int, number: int, body: bytes) -> bytes:
        crc = mcrf4xx(bytes([self.dialect[number].seed]), mcrf4xx(head + body))
        return bytes([magic]) + head + body + crc.to_bytes(2, "little")


def command_long(command: int, params: list[float] | tuple[float, ...] = (), target_system: int = 1, target_component: int = 1, confirmation: int = 0) -> bytes:
    """Payload of message 76; missing parameters are zero."""
    if len(params) > 7:
        raise ValueError("a command has seven parameters at most")
    return struct.pack("<7fHBBB", *params, *[0.0] * (7 - len(params)), command, target_system, target_component, confirmation)


def command_ack(payload: bytes) -> tuple[int, int]:
    """(command, result) of message 77; bytes cut off at the end are zero."""
    command, result = struct.unpack("<HB", payload[:3].ljust(3, b"\0"))
    return command, result
