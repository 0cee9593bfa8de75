"""Arrow text columns as flat numpy bytes: splitting into words and hashing of words without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Odd multipliers of the polynomial hashes (modulo 2^64).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that one numpy step holds; a longer document makes a step of its own. A step has many arrays of a number
#: per byte or word, and what they took stays with the Python worker: operators that run in a row take small steps.
PIECE, SMALL = 2 << 20, 512 << 10


def spare(columns: Iterable[str], name: str) -> str:
    """The name, with as many underscores before it as no column of this name needs."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """Columns that an operator's own columns would clash with get _in_ before their names (and more _, if taken)."""
    out = df
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            out = out.withColumnRenamed(c, spare(out.columns, f"_in_{c}"))
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and where each row starts (one more entry than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of text each, at least one row."""
    _, at = flat(batch.column(column))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


_HELD: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int, base: int = BYTE_BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n at least. A worker holds one table of each base, as long as it was needed."""
    if base not in _HELD or len(_HELD[base][0]) <= n:
        size = next((s + (1 << 17) for s in (SMALL, PIECE) if n <= s + (1 << 17)), 1 << int(n).bit_length())
        _HELD[base] = _powers(size, base)
    return _HELD[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """S with S[b] - S[a] = sum of (data[j] + 1) * base^j over a <= j < b."""
    p, _ = powers(len(data), base)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def ranges_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """Hash of each byte range; equal bytes have equal hashes wherever they are."""
    _, inverse = powers(len(sums) - 1, base)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def lowercase_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_table(excluded: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Which bytes belong to words, given the ranges that don't."""
    table = np.ones(256, bool)
    for a, b in excluded:
        table[a : b + 1] = False
    return table


LOWER = lowercase_table()
#: Words of everything but white space: [^\x20\x09-\x0D]+
NOT_SPACE = word_table(((0x20, 0x20), (0x09, 0x0D)))
#: Words of letters and digits, once A-Z is lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = word_table(((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each row has. Words never cross rows."""
    inside = table[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[at] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    stop[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def shingle_hash(word_hash: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of k words begin (within one row) and their hashes."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    h, factor = np.zeros(len(at), np.uint64), 1
    for j in range(k):
        h += word_hash[at + j] * np.uint64(factor)
        factor = factor * WORD_BASE % (1 << 64)
    return at, mix(h + np.uint64(k))
