"""A partitioned record log as a stream source: ``spark.readStream.format("recordlog").load(path)``.

A log is a folder with one folder per partition (``partition=3``), in which segments lie: Arrow files named by the offset of
their first record. Segments are complete when they get their name and never change. Rows have key, value, headers,
timestamp, and partition and offset, as a broker's records do; ``streaming.tables.envelopes`` takes them.

Options: ``startingOffsets`` (earliest or latest, for a query without a checkpoint) and ``maxRecordsPerBatch`` (of all
partitions together, in equal shares). Each segment of a batch is a task of its own. Offsets are kept by Spark's checkpoint, so
that a restart goes on where the last batch ended. But Spark does not tell a reader where a query stands before it asks how
far the next batch may go: the first batch after a start takes all that is there, unless ``positions`` names a folder, one for
each query, in which the reader notes the ends of finished batches. Then it is twice as large as others at most, as the last
note may be missing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from skytally.session import ship_package
from skytally.sources.captures import _opened

RECORD = "key binary, value binary, headers array<struct<key:string,value:binary>>, timestamp timestamp, partition int, offset bigint"
HEADERS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))
ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("headers", HEADERS), ("timestamp", pa.timestamp("us", "UTC"))])


@dataclass
class Segment(InputPartition):
    file: str
    partition: int
    base: int
    start: int
    stop: int


def _segments(path: str) -> dict[int, list[tuple[int, str]]]:
    """Of each partition, the segments' first offsets and files, in order."""
    files, root = _opened(path)
    out: dict[int, list[tuple[int, str]]] = {}
    for info in files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder = info.path.rsplit("/", 2)[-2]
        if info.is_file and info.base_name.endswith(".arrow") and not info.base_name.startswith("_") and folder.startswith("partition="):
            out.setdefault(int(folder[10:]), []).append((int(info.base_name[:-6]), info.path))
    return {p: sorted(s) for p, s in out.items()}


def _read(path: str, file: str) -> pa.Table:
    with _opened(path)[0].open_input_file(file) as f:
        return ipc.open_file(f).read_all()


def append(path: str, partition: int, records: list[tuple]) -> int:
    """Appends a segment of (key, value, headers, timestamp) to a partition, which has one writer; returns its first offset."""
    files, root = _opened(path)
    known = _segments(path).get(partition, [])
    base = known[-1][0] + _read(path, known[-1][1]).num_rows if known else 0
    folder = f"{root}/partition={partition}"
    files.create_dir(folder)
    made = f"{folder}/_{uuid.uuid4().hex}"
    columns = zip(*records, strict=True) if records else [[]] * 4
    table = pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)
    with files.open_output_stream(made) as sink, ipc.new_file(sink, ARROW) as out:
        out.write_table(table)
    files.move(made, f"{folder}/{base:020d}.arrow")
    return base


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.start = options["path"], options.get("startingoffsets", "earliest")
        if self.start not in ("earliest", "latest"):
            raise ValueError("startingOffsets must be earliest or latest")
        self.most, self.positions = int(options.get("maxrecordsperbatch", 0)), options.get("positions")
        self.reached: dict[str, int] | None = None
        self.shares = 1
        if self.positions:
            files, folder = _opened(self.positions)
            note = f"{folder}/ends.json"
            if files.get_file_info(note).is_file:
                with files.open_input_file(note) as f:
                    self.reached, self.shares = json.loads(f.read()), 2
            else:
                self.initialOffset()

    def _ends(self) -> dict[str, int]:
        return {str(p): s[-1][0] + _read(self.path, s[-1][1]).num_rows for p, s in _segments(self.path).items()}

    def initialOffset(self) -> dict:
        self.reached = self._ends() if self.start == "latest" else {str(p): s[0][0] for p, s in _segments(self.path).items()}
        return self.reached

    def latestOffset(self) -> dict:
        ends = self._ends()
        if self.reached is None or not self.most:
            return ends
        share = max(1, self.most // max(1, len(ends))) * self.shares
        return {p: min(end, self.reached.get(p, 0) + share) for p, end in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.reached, self.shares, out = dict(end), 1, []
        known = _segments(self.path)
        for p, stop in end.items():
            segments = known.get(int(p), [])
            first = start.get(p, segments[0][0] if segments else 0)  # a partition that is new since is read from its beginning
            for (base, file), after in zip(segments, [*(b for b, _ in segments[1:]), stop], strict=False):
                a, b = max(first, base), min(stop, after)
                if a < b:
                    out.append(Segment(file, int(p), base, a, b))
        return out

    def read(self, segment: Segment) -> Iterator[pa.RecordBatch]:
        rows = _read(self.path, segment.file).slice(segment.start - segment.base, segment.stop - segment.start)
        n = rows.num_rows
        rows = rows.append_column("partition", pa.array([segment.partition] * n, pa.int32())).append_column("offset", pa.array(range(segment.start, segment.start + n), pa.int64()))
        yield from rows.to_batches()

    def commit(self, end: dict) -> None:
        if self.positions:
            files, folder = _opened(self.positions)
            files.create_dir(folder)
            made = f"{folder}/_{uuid.uuid4().hex}"
            with files.open_output_stream(made) as out:
                out.write(json.dumps(end).encode())
            files.move(made, f"{folder}/ends.json")

    def stop(self) -> None:
        pass


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(RecordLog)
