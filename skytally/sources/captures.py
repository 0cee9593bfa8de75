"""MAVLink captures as a data source: ``spark.read.format("mavlink").option("splitBytes", ...).load(path)``.

Captures are cut into parts of ``splitBytes``, each a task of its own that reads its part of the file and no more than some
kilobytes before it: ``framing.entry`` tells, from the bytes before a cut, where the first frame of a part begins when the
capture is read from its first byte. Parts so agree without talking to each other, whatever the bytes; a frame belongs to the
part in which it begins. Paths are those that pyarrow's file systems open (local or mounted folders, hdfs, object stores).

Columns: path, offset (of the frame in its capture: the order of frames) and the frame's fields. Sequence gaps are a matter of
``operators.ops``; the counters of damaged bytes come from ``binary.mavlink_stats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skytally.codec import framing
from skytally.codec.dialect import CORE_DIALECT, from_xml
from skytally.session import ship_package
from skytally.sources.binary import FRAME, FRAME_NAMES, frame_columns

SPLIT_BYTES = 128 << 20


@dataclass
class Part(InputPartition):
    path: str
    size: int
    start: int
    stop: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("splitBytes must be positive")
        definitions = [p for p in options.get("dialect", "").split(",") if p]
        self.dialect = CORE_DIALECT | from_xml(*definitions)

    def partitions(self) -> list[Part]:
        files, path = _opened(self.path)
        info = files.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [i for i in files.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
        return [Part(i.path, i.size, a, min(a + self.split, i.size)) for i in sorted(found, key=lambda i: i.path) for a in range(0, max(i.size, 1), self.split)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        known, files = framing.known(self.dialect), _opened(self.path)[0]
        with files.open_input_file(part.path) as file:
            content = lambda a, b: file.read_at(max(0, min(b, part.size) - a), a)
            at = framing.entry(content, part.start, known) if part.start else 0
            while at < part.stop:
                data = np.frombuffer(content(at, min(at + framing.PIECE, part.stop + framing.LONGEST)), np.uint8)
                frames, done = framing.scan(data, known, at + len(data) >= part.size, framing.Stats())
                own = frames.at < part.stop - at
                frames = framing.Frames(*(c[own] for c in frames))
                n = len(frames.at)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(at + frames.at, pa.int64()), *frame_columns(frames, data)], ["path", "offset", *FRAME_NAMES])
                at += done


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mavlink"

    def schema(self) -> str:
        return f"path string, offset bigint, {FRAME}"

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(Captures)
