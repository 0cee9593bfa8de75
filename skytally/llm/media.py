"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. At each hit the format's
validator reads the structure that follows (chunk lengths, block chains, checksums) and returns where the media ends, or
that it isn't one. A value that starts with a valid medium has that type, whatever was declared; media that begin further
inside, outside any that was accepted before, are carved out. Walks through chains of blocks share their failures, so that
false starts, however many, cost no more steps together than the value has bytes. All work is a map over rows.

Null bytes give no type and no media; empty bytes likewise. Declared types are corrected, never trusted. Repeated rows give
repeated results; other columns are kept by ``sniff`` and ignored by the query.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skytally.llm import columnar as C
from skytally.session import ship_package

UNIT = 64
#: Magic bytes of the formats.
MAGIC = {
    b"RIFF": "audio/wav",
    b".snd": "audio/basic",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"\xff\xd8\xff": "image/jpeg",
}


class Walks:
    """Where walks through a value's structures failed. What a walk does from a place depends on the place and its state only,
    so one that comes to such a place fails too: all walks of a format take as many steps together as the value has bytes."""

    def __init__(self, size: int):
        self.size, self.flags, self.steps = size, {}, []

    def failed(self, kind: str, state: int, at: int) -> bool:
        """Whether a walk failed from here; if not, the place is kept until this walk ends."""
        flags = self.flags.get(kind)
        if flags is not None and flags[at] & state:
            return True
        self.steps.append((at, state))
        return False

    def ended(self, kind: str, end: int) -> int:
        """The end of a walk, -1 if it failed."""
        if end < 0 and self.steps:
            if kind not in self.flags:
                self.flags[kind] = bytearray(self.size)
            flags = self.flags[kind]
            for at, state in self.steps:
                flags[at] |= state
        self.steps.clear()
        return end


def _wav(b: bytes, at: int, walks: Walks) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return -1
    end, p, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    while p + 8 <= end <= len(b):
        seen.add(b[p : p + 4])
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + size % 2
    return end if {b"fmt ", b"data"} <= seen and p == end else -1


def _au(b: bytes, at: int, walks: Walks) -> int:
    if len(b) < at + 24:
        return -1
    offset, size, encoding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    end = at + offset + size
    return end if 24 <= offset <= 4096 and 1 <= encoding <= 27 and rate and 1 <= channels <= 64 and end <= len(b) else -1


def _png(b: bytes, at: int, walks: Walks) -> int:
    def walk(p: int) -> int:
        first = True
        while p + 12 <= len(b):
            size = struct.unpack_from(">I", b, p)[0]
            kind, end = b[p + 4 : p + 8], p + 12 + size
            if end > len(b) or first != (kind == b"IHDR") or first and size != 13:
                return -1
            if not first and walks.failed("png", 1, p) or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
                return -1
            if kind == b"IEND":
                return end
            p, first = end, False
        return -1

    return walks.ended("png", walk(at + 8))


def _gif(b: bytes, at: int, walks: Walks) -> int:
    def blocks(p: int) -> int:
        while p < len(b):
            if not b[p]:
                return p + 1
            if walks.failed("gif", 2, p):
                return -1
            p += 1 + b[p]
        return -1

    def walk(p: int) -> int:
        while 0 <= p < len(b):
            if b[p] == 0x3B:
                return p + 1
            if walks.failed("gif", 1, p):
                return -1
            if b[p] == 0x21:
                p = blocks(p + 2)
            elif b[p] == 0x2C and p + 10 <= len(b):
                p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
            else:
                return -1
        return -1

    if len(b) < at + 13:
        return -1
    return walks.ended("gif", walk(at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)))


def _bmp(b: bytes, at: int, walks: Walks) -> int:
    if len(b) < at + 26:
        return -1
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return at + size if not zero and header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size and at + size <= len(b) else -1


def _jpeg(b: bytes, at: int, walks: Walks) -> int:
    def walk(p: int) -> int:
        while p + 4 <= len(b) and b[p] == 0xFF:
            kind = b[p + 1]
            if kind == 0xD9:
                return p + 2
            if walks.failed("jpeg", 1, p):
                return -1
            p += 2 + struct.unpack_from(">H", b, p + 2)[0]
            if kind == 0xDA:
                # The scan goes on to the next marker; each place where one might begin is a step.
                while 0 <= (p := b.find(b"\xff", p)) and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                    if walks.failed("jpeg", 2, p):
                        return -1
                    p += 2
                if p < 0:
                    return -1
        return p + 2 if b[p : p + 2] == b"\xff\xd9" else -1

    return walks.ended("jpeg", walk(at + 2))


VALIDATE = {"audio/wav": _wav, "audio/basic": _au, "image/png": _png, "image/gif": _gif, "image/bmp": _bmp, "image/jpeg": _jpeg}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def find(a: ahocorasick.Automaton, data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of the media in the bytes, none inside another."""
    found, free, walks = [], 0, Walks(len(data))
    for last, (size, kind) in a.iter(data.decode("latin-1")):
        start = last - size + 1
        if start >= free and (end := VALIDATE[kind](data, start, walks)) > start:
            found.append((kind, start, end))
            free = end
    return found


def sniff(df: DataFrame, data: str, declared: str | None = None) -> DataFrame:
    """Appends media_type (null if the value isn't media), declared_right, and carved (type, offset and bytes inside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            kinds, right, carved = [], [], []
            said = batch.column(declared).to_pylist() if declared is not None else [None] * batch.num_rows
            for value, says in zip(batch.column(data).to_pylist(), said, strict=True):
                found = find(a, value) if value else []
                whole = found[0][0] if found and found[0][1] == 0 else None
                kinds.append(whole)
                right.append(says == whole if declared is not None else None)
                carved.append([{"type": k, "offset": s, "data": value[s:e]} for k, s, e in found if s or e < len(value)])
            parts = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("data", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(right, pa.bool_()), pa.array(carved, parts)], [*batch.schema.names, "media_type", "declared_right", "carved"])

    data, declared = (df.columns.index(c) if c else None for c in (data, declared))
    df = C.renamed(df, "media_type", "declared_right", "carved")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "media_type string, declared_right boolean, carved array<struct<type:string,offset:bigint,data:binary>>"])
    return df.mapInArrow(run, schema)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its payload: those with zeros up to a positive multiple of the unit."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store_wav(payload: bytes) -> bytes:
    """A WAV file of 8-bit mono samples at 8 kHz."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a valid WAV file."""
    p = 12
    while media[p : p + 4] != b"data":
        size = struct.unpack_from("<I", media, p + 4)[0]
        p += 8 + size + size % 2
    return media[p + 8 : p + 8 + struct.unpack_from("<I", media, p + 4)[0]]


def features(kind: str, samples: bytes, embedded: int) -> str:
    """The confirmed type, then mean, spread, entropy in bits and share of the commonest sample, and media found inside."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    levels = np.arange(256)
    mean = float((n * levels).sum() / len(x))
    spread = float((n * (levels - mean) ** 2).sum() / len(x)) ** 0.5
    return f"{kind};mean={mean:.3f};sd={spread:.3f};entropy={float(-(p * np.log2(p)).sum()):.3f};top={n.max() / len(x):.3f};embedded={embedded}"


def media_table(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Stores every text as a WAV file declared as unknown bytes: doc_id, n_bytes, media, declared."""
    ship_package(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [padded(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([store_wav(r[1]) for r in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Sniffs stored media, reads the payload back and describes it."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                b = value.as_py()
                found = find(a, b)
                if not found or found[0][:2] != ("audio/wav", 0):
                    raise ValueError("stored media did not validate")
                payload = wav_samples(b[: found[0][2]])
                inside = len(find(a, payload))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(b), hashlib.sha256(b).hexdigest(), features(found[0][0], payload, inside)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(media_table(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op9_media": op9_media}

ORACLE_SQL: dict[str, str] = {}
