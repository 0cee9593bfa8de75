"""Binary captures as rows: one capture per input row (path, content), as ``binaryFile`` gives them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skytally.codec import framing, hk
from skytally.codec.dialect import CORE_DIALECT, Message
from skytally.session import ship_package

STATS = ("decoded", "crc_errors", "unknown", "resync_bytes", "lost", "signed", "v1", "endpoints")
HK_STATS = ("frames", "crc_errors", "resync_bytes", "tail_bytes")
#: Rows of an output batch.
ROWS = 20_000


def captures(spark: SparkSession, path: str) -> DataFrame:
    """path and content of capture files; each is one task's unit of work, so record links into files of bounded size."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)


FRAME = "version int, sequence int, system_id int, component_id int, message_id int, incompat int, compat int, payload binary"
FRAME_NAMES = [c.split()[0] for c in FRAME.split(", ")]


def frame_columns(frames: framing.Frames, data: np.ndarray) -> list[pa.Array]:
    """The columns of FRAME."""
    payload, at = frames.payloads(data)
    whole = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(payload.tobytes())])
    return [*(pa.array(c, pa.int32()) for c in frames[1:8]), whole]


def mavlink_frames(spark: SparkSession, df: DataFrame, dialect: dict[int, Message] | None = None) -> DataFrame:
    """path, arrival (place in the capture) and the fields of every valid frame."""
    ship_package(spark)
    known = framing.known(dialect or CORE_DIALECT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                arrival = 0
                for _, data, frames in framing.stretches(content.as_buffer() if content.is_valid else b"", known, framing.Stats()):
                    n = len(frames.at)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(arrival, arrival + n)), *frame_columns(frames, data)], ["path", "arrival", *FRAME_NAMES])
                    arrival += n

    return df.select("path", "content").mapInArrow(run, f"path string, arrival bigint, {FRAME}")


def mavlink_stats(spark: SparkSession, df: DataFrame, dialect: dict[int, Message] | None = None) -> DataFrame:
    """The decoder's counters for each capture."""
    ship_package(spark)
    known = framing.known(dialect or CORE_DIALECT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    stats = framing.Stats()
                    for _ in framing.stretches(content.as_buffer() if content.is_valid else b"", known, stats):
                        pass
                    yield path, *stats.row()

        yield from _batches(rows(), ["path", *STATS], [pa.string(), *[pa.int64()] * len(STATS)])

    return df.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{s} bigint" for s in STATS))


def hk_records(spark: SparkSession, df: DataFrame) -> DataFrame:
    """path, seq, record_type and payload of every valid log record."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    for i, record in enumerate(hk.Decoder().feed(content.as_py() or b"", end=True)):
                        yield path, i, *record

        yield from _batches(rows(), ["path", "seq", "record_type", "payload"], [pa.string(), pa.int32(), pa.int32(), pa.binary()])

    return df.select("path", "content").mapInArrow(run, "path string, seq int, record_type int, payload binary")


def hk_stats(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The log decoder's counters for each capture."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    yield path, *hk.decode(content.as_py() or b"")[1].row()

        yield from _batches(rows(), ["path", *HK_STATS], [pa.string(), *[pa.int64()] * len(HK_STATS)])

    return df.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{s} bigint" for s in HK_STATS))
