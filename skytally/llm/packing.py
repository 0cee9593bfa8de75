"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Texts are tokenized with a given tokenizer, closed by an end token and, where longer than ``capacity``, cut into pieces of that
length (the last may be shorter). Pieces and gaps (the room that is left in a sequence) then meet band by band, from the
longest pieces to the shortest: pieces of more than half the capacity open a sequence each; those of more than a quarter come
next, and so on by halves. For each band:

1. Pieces of the band and the gaps that are long enough for any of them are range-sorted together, longest first, gaps before
   pieces. Each partition sweeps its range: a piece takes the shortest gap that is long enough (its successor), whose rest
   becomes a gap again, within reach of the pieces that follow.
2. What a partition has left goes on by counts alone, one row per partition on the driver: its pieces, in their order, get the
   nearest gaps left in ranges of longer ones, each gap promised to one range, by rank. Gaps and pieces so dealt meet in a
   second sweep by range. Only where such gaps have run out does a piece open a sequence.
3. Updated gaps go into the next band's sort. A gap that no remaining piece fits just stays.

With B bands there are 2 B supersteps, whatever the size of the table. Each superstep's table is written, so that a lost
executor repeats tasks of one superstep only; sort keys are total up to interchangeable rows, so repetitions agree. A partition
holds its gaps in memory, of at most ``RANGE_ROWS`` rows or so (more ranges for more rows). Equal lengths, however frequent,
spread over many ranges: a range ends anywhere among them.

White space never is part of a token of this tokenizer, nor joins what is beside it, so a text's ids are the ids of its
stretches without ASCII white space, one after the other; frequent stretches are remembered by the worker process.

A null text is empty, and an empty text one end token. Rows that repeat an id are separate documents, and so are null ids. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import columnar as C
from skytally.session import materialize, scratch, ship_package

CAPACITY, END = 2048, 0
#: Rows of a range; bands by halves before the last one takes all shorter pieces.
RANGE_ROWS, BANDS = 200_000, 6
#: Remembered stretches, and the bytes of the longest one that is.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64
#: The kind of tokenizer whose texts may be taken stretch by stretch, and how it splits them.
KIND = [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stretches of small Latin letters, digits and ASCII marks are split here by the same rule, and only their parts go to the model.
LATIN = "a-zß-öø-ÿ"
PLAIN, PLAIN_SPLIT = re.compile(f"[{LATIN}!-@\\[-`{{-~]+"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")

PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
GAP, ITEM, PLACED = 0, 1, 2
#: Rows of a superstep: what, the piece's columns, its sequence and offset, or a gap's sequence and room, and where it was left.
STEP = f"kind int, size long, {PIECE}, sequence_id long, offset long, part int, place int"
COLUMNS = ["kind", "size", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "place"]


class Stretches(dict):
    """The ids of stretches without white space, as little-endian unsigned 32-bit numbers.

    A tokenizer of another kind than the one described at ``SPLIT`` takes every text as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kind = json.loads(self.tokenizer.to_str())
        steps = [(kind["normalizer"] or {}).get("normalizers"), (kind["pre_tokenizer"] or {}).get("pretokenizers")]
        self.apart = [[x["type"] for x in step or []] for step in steps] == KIND and steps[1][0]["pattern"] == {"Regex": SPLIT} and steps[1][0]["invert"] and not steps[1][1]["add_prefix_space"]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.codes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Of one match of SPLIT."""
        ids = self.parts.get(part)
        if ids is None:
            codes = self.codes
            ids = b"".join([codes[t.id] for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))])
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def __missing__(self, stretch: bytes) -> bytes:
        text = stretch.decode()
        if PLAIN.fullmatch(text) and "<|" not in text and len(stretch) <= REMEMBERED_BYTES:
            ids = b"".join(map(self._part, PLAIN_SPLIT.findall(text)))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(stretch) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self.apart:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        data = text.encode()
        # A-Z may be small before NFC if no combining mark follows one, and special tokens stay as they are.
        if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


@lru_cache(maxsize=2)
def stretches_of(path: str) -> Stretches:
    """One for each worker process, which serves many tasks."""
    return Stretches(path)


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text; with ``ids`` also its tokens, an array."""
    closing = int(end).to_bytes(4, "little")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = PIECE.format(id=kind) + (", ids array<long>" if ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = stretches_of(tokenizer)
        for batch in batches:
            for part in C.pieces(batch, "text"):
                rows, out, tokens = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    data = stretches.ids(text or "") + closing
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        one = data[at : at + 4 * capacity]
                        rows.append(row)
                        out.append((k, at // 4, len(one) // 4, zlib.crc32(one)))
                        if ids:
                            tokens.append(np.frombuffer(one, "<u4").astype(np.int64))
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(tokens, pa.list_(pa.int64()))] if ids else []), ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    ship_package(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


class Gaps:
    """Open sequences by their room, and which rooms there are as the bits of one number."""

    def __init__(self):
        self.bits, self.by_room = 0, defaultdict(list)

    def add(self, room: int, sequence: int) -> None:
        if room:
            self.by_room[room].append(sequence)
            self.bits |= 1 << room

    def successor(self, size: int) -> tuple[int, int] | None:
        """Takes out a gap of the least room from ``size`` on: (room, sequence)."""
        longer = self.bits >> size
        if not longer:
            return None
        room = size + (longer & -longer).bit_length() - 1
        sequence = self.by_room[room].pop()
        if not self.by_room[room]:
            self.bits ^= 1 << room
        return room, sequence

    def rest(self) -> Iterator[tuple[int, int]]:
        for room in sorted((r for r, s in self.by_room.items() if s), reverse=True):
            for sequence in self.by_room[room]:
                yield room, sequence


def sweep(rows: DataFrame, capacity: int, band: int, opens: bool) -> DataFrame:
    """One superstep over partitions whose rows come in ranges (``part``), longest first, gaps before pieces.

    Pieces are placed, or left over (``opens``: open a sequence). A gap that is at least as long as the range's shortest row
    is left with the rank that later ranges get it by (``place``), any other without one.
    """
    whole = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, opened = TaskContext.get().partitionId(), [f.name for f in whole], 0
        part = None
        gaps, left, least, out = Gaps(), [], 0, []

        def close() -> None:
            for k, item in enumerate(left):
                out.append((ITEM, item[1], *item[2:7], None, None, part, k))
            place = 0
            for room, sequence in gaps.rest():
                near = room >= least
                out.append((GAP, room, None, None, None, None, None, sequence, None, part, place if near else None))
                place += near

        def batch_out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], COLUMNS)
            out.clear()
            return done

        types = None
        for batch in batches:
            types = types or [batch.schema.field(c).type for c in COLUMNS]
            for row in zip(*(batch.column(names.index(c)).to_pylist() for c in COLUMNS), strict=True):
                if part != row[9]:
                    if part is not None:
                        close()
                    part, gaps, left = row[9], Gaps(), []
                kind, size = row[:2]
                least = size
                if kind == GAP:
                    gaps.add(size, row[7])
                    continue
                found = gaps.successor(size)
                if found is None and opens:
                    found = capacity, (band << 56) | (task << 32) | opened
                    opened += 1
                if found is None:
                    left.append(row)
                    continue
                room, sequence = found
                out.append((PLACED, size, *row[2:7], sequence, capacity - room, part, None))
                gaps.add(room - size, sequence)
            if out:
                yield batch_out()
        if part is not None:
            close()
            yield batch_out()

    return rows.select(COLUMNS).mapInArrow(run, rows.select(COLUMNS).schema)


def promises(summary: list) -> list[tuple[int, int, int, int]]:
    """(part, from, to, for): gaps ``from`` to ``to`` (by rank) left in a range are promised to range ``for``.

    ``summary``: (part, pieces left, gaps left with a rank), in the order of ranges. A range's pieces get as many gaps, the
    nearest before it first; one with more pieces than that gets all there are.
    """
    out, pool = [], []
    for part, pieces, gaps in summary:
        while pieces and pool:
            at, first, end = pool.pop()
            got = min(pieces, end - first)
            out.append((at, end - got, end, part))
            if first < end - got:
                pool.append((at, first, end - got))
            pieces -= got
        if gaps:
            pool.append((part, 0, gaps))
    return out


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, bands: int = BANDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, start, length (1 to ``capacity``), ids_crc32."""
    with scratch(spark):
        pieces = materialize(spark, pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pack-pieces")
        limits = [capacity >> b for b in range(1, bands)] + [0]
        in_band = [(F.col("length") > low) & (F.col("length") <= high) for low, high in zip(limits, [capacity, *limits], strict=False)]
        counts = pieces.agg(*(F.count_if(c).alias(f"n{b}") for b, c in enumerate(in_band))).first()  # one row
        none = {c: F.lit(None) for c in COLUMNS}
        schema = dict(zip(COLUMNS, [f.dataType for f in spark.createDataFrame([], STEP.format(id=pieces.schema["doc_id"].dataType.simpleString())).schema], strict=True))

        def rows(df: DataFrame, **given) -> DataFrame:
            made = none | {c: F.col(c) for c in df.columns if c in COLUMNS} | given
            return df.select(*(made[c].cast(schema[c]).alias(c) for c in COLUMNS))

        first = pieces.where(in_band[0]).withColumn("sequence_id", F.monotonically_increasing_id())
        placed = rows(first, kind=F.lit(PLACED), size=F.col("length"), offset=F.lit(0))
        gaps = rows(first.where(F.col("length") < capacity), kind=F.lit(GAP), size=capacity - F.col("length")).withColumns({c: F.lit(None).cast(schema[c]) for c in COLUMNS[2:7]})
        step = materialize(spark, placed.unionByName(gaps), "pack-0")
        done, gaps = [step.where(F.col("kind") == PLACED)], step.where(F.col("kind") == GAP)
        n_gaps = counts[0]
        order = [F.col("size").desc(), "kind", "sequence_id", F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "start", "ids_crc32"]
        for band in range(1, len(limits)):
            if not counts[band]:
                continue
            low = limits[band]
            items = rows(pieces.where(in_band[band]), kind=F.lit(ITEM), size=F.col("length"))
            parts = max(1, -(-(counts[band] + n_gaps) // range_rows))
            both = items.unionByName(gaps.where(F.col("size") > low)).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
            step = materialize(spark, sweep(both.sortWithinPartitions(*order), capacity, band, False), f"pack-{band}")
            waiting = gaps.where(F.col("size") <= low)
            done.append(step.where(F.col("kind") == PLACED))
            # One row per range.
            left = step.where("place is not null").groupBy("part").agg(F.count_if(F.col("kind") == ITEM).alias("pieces"), F.count_if(F.col("kind") == GAP).alias("gaps"))
            summary = sorted((r.part, r.pieces, r.gaps) for r in left.collect())
            step_gaps = step.where(F.col("kind") == GAP)
            if any(r[1] for r in summary):
                plan = spark.createDataFrame(promises(summary), "_at int, _from int, _to int, _for int")
                promised = step_gaps.join(F.broadcast(plan), (F.col("part") == F.col("_at")) & (F.col("place") >= F.col("_from")) & (F.col("place") < F.col("_to")), "left")
                again = step.where(F.col("kind") == ITEM).unionByName(promised.where("_for is not null").withColumn("part", F.col("_for")).select(COLUMNS))
                kept = promised.where("_for is null").select(COLUMNS)
                targets = sum(r[1] > 0 for r in summary)
                again = again.repartition(targets, "part").sortWithinPartitions("part", *order)
                second = materialize(spark, sweep(again, capacity, band, True), f"pack-{band}-second")
                done.append(second.where(F.col("kind") == PLACED))
                step_gaps = kept.unionByName(second.where(F.col("kind") == GAP))
            gaps = step_gaps.unionByName(waiting)
            n_gaps += counts[band]
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return materialize(spark, out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), "packed", keep=True)


def assemble(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the tokens of each sequence in order. ``pieces``: of ``token_pieces`` with ``ids``; ids of documents
    must be unique and not null here. A group is one sequence, so it has at most its capacity of tokens."""
    met = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return met.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(spark, token_pieces(documents, public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op13_packing": op13_packing}
ORACLE_SQL: dict[str, str] = {}
