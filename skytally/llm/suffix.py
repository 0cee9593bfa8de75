"""Removal of repeated byte strings with the Burrows-Wheeler transform.

Every byte that a string of ``LENGTH`` bytes covers which also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed. A window is one such string. The corpus is dealt by content, so that equal windows meet:

1. Each window has an anchor, its ``K``-byte string of smallest hash (the leftmost, if equal). Neighbouring windows share
   anchors, so a document is a sequence of runs of windows, each run with one anchor. Equal windows have equal anchors at
   equal offsets; anchors that occur once are settled.
2. Of the rest, runs with the same anchor, offset and bytes (by 128 bits of hash) are equal as a whole: all but the earliest
   are repeats.
3. Anchors with several different runs need a closer look at the earliest of each. Their bytes go to blocks by anchor; in a
   block a suffix array gives the Burrows-Wheeler transform, and breadth-first backward extension of intervals derives the
   common prefixes of neighbouring suffixes by increasing value. It stops at LENGTH: suffixes whose value was not derived
   by then share LENGTH bytes or more, and are classes of equal windows.
4. An anchor with more than ``GROUP`` different runs (a common line in many surroundings) is not brought together. Its
   windows are dealt anew by longer anchors (``LONGER``), with steps 2 and 3 for each length: runs of windows become
   shorter, equal ones are merged before the next, and a window whose longer anchor reaches into its own surroundings is
   alone. At LENGTH bytes a window is its own anchor, and a group is one class.

Rows so grow with the windows, never with the square of a group, no block holds more than BLOCK bytes and a group, and keys
that many rows share are split in the joins (``counted_join``).

Matches never cross documents. Null text is empty; texts shorter than LENGTH lose nothing. Rows that repeat id and text are
one document and get the same result each; rows of one id with different texts are documents of their own, in the order of
a hash of their texts. A row with a null doc_id is kept as it is and takes no part. Empty tables give no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import columnar as C
from skytally.llm.joins import counted_join
from skytally.session import materialize, scratch, ship_package

#: Bytes of a repeat, of an anchor, and of text in a block; different runs of an anchor that a block takes at most.
LENGTH, K, BLOCK, GROUP = 100, 32, 128 << 10, 768
#: Anchors of crowded groups, as shares of LENGTH; the last is the whole window.
LONGER = (0.48, 0.64, 0.8, 1.0)
#: Where a run is: the document (rows of one id may have different texts) and the start of its first window.
PLACE = ["doc_id", "copy", "first"]


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """The runs of windows: row, start of the first window, anchor offset from it, windows, anchor hash, run hash."""
    n, w = len(data), length - k + 1
    room = np.maximum(np.diff(at) - length + 1, 0)
    total = int(room.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = C.prefix_sums(data)
    _, inverse = C.powers(n)
    hashes = C.mix((sums[k:] - sums[: n + 1 - k]) * inverse[: n + 1 - k])
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    row = np.repeat(np.arange(len(room)), room)
    start = at[row] + np.arange(total) - np.repeat(np.cumsum(room) - room, room)
    anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    count = np.diff(np.append(first, total))
    begin, anchor = start[first], anchor[first]
    content = C.ranges_hash(sums, begin, begin + count + length - 1)
    content = C.mix(content + (anchor - begin).astype(np.uint64) * np.uint64(C.WORD_BASE))
    return row[first], begin - at[row[first]], anchor - begin, count, hashes[anchor], content


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a small integer text by their first ``depth`` symbols at least: prefix doubling over packed symbols.

    Suffixes that agree further are left in any order.
    """
    n, base = len(text), int(text.max()) + 2
    packed, width = np.zeros(n, np.int64), 0
    while base ** (width + 1) < 1 << 62 and width < 24:
        packed *= base
        packed[: n - width] += text[width:] + 1
        width += 1
    key = packed
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([1], np.cumsum(ordered[1:] != ordered[:-1]) + 1))
        if width >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:]
        width *= 2


def equal_windows(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the positions in the joined strings (each followed by an end mark) by their next ``length`` bytes.

    Returns the class of each position, and where each string starts. Only positions whose window lies within their string
    have a meaningful class.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    text[starts + sizes - 1] = 0  # end marks
    present = np.zeros(257, bool)
    present[text] = True
    text = (np.cumsum(present) - 1)[text]
    order = suffix_array(text, length)
    n = len(text)
    # Row q of the sorted suffixes is row source[q] with its preceding symbol put before it: backward extension keeps the
    # order among rows of one symbol. q shares one symbol more with q - 1 than all rows from source[q - 1] to source[q] do.
    source = np.argsort(text[order - 1], kind="stable")
    edge = np.zeros(n, np.int32)  # whether the common prefix with the row before is derived, to be less than the level
    edge[np.concatenate(([0], np.cumsum(np.bincount(text))[:-1]))] = 1
    open_ = np.flatnonzero(edge == 0)
    low, high = source[open_ - 1], source[open_]
    for _ in range(length - 1):
        # An interval of this level ends between the two: their extensions part one symbol later.
        ends = np.cumsum(edge, dtype=np.int32)
        part = ends[high] > ends[low]
        if not part.any():
            break
        edge[open_[part]] = 1
        open_, low, high = open_[~part], low[~part], high[~part]
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(edge)
    return classes, starts


def _copy(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What tells rows of one id with different texts apart."""
    return (C.ranges_hash(C.prefix_sums(data), at[:-1], at[1:]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _anchors(documents: DataFrame, length: int, k: int, full: bool) -> DataFrame:
    """h for every run of windows; with ``full`` also the run's hash and where it is."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text"):
                data, at = C.flat(part.column("text"))
                row, first, offset, count, h, content = runs(data, at, length, k)
                columns = {"h": pa.array(h.view(np.int64))}
                if full:
                    columns |= {"run": pa.array(content.view(np.int64)), "doc_id": part.column("doc_id").take(pa.array(row)), "copy": pa.array(_copy(data, at)[row]), "first": pa.array(first.astype(np.int32)), "windows": pa.array(count.astype(np.int16))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "h bigint" + (f", run bigint, doc_id {kind}, copy int, first int, windows smallint" if full else "")
    return documents.select("doc_id", "text").mapInArrow(scan, schema)


def _contexts(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs (h, large, place, windows) with their bytes."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "large", "copy", "first", "windows")).alias("runs")).withColumnRenamed("doc_id", "_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text"):
                data, at = C.flat(part.column("text"))
                raw, lists = data.tobytes(), part.column("runs")
                inner, owner = lists.flatten(), np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                own = np.asarray(inner.field("copy")) == _copy(data, at)[owner]
                inner, owner = inner.filter(pa.array(own)), owner[own]
                first, windows = np.asarray(inner.field("first")).astype(np.int64), np.asarray(inner.field("windows")).astype(np.int64)
                start = at[owner] + first
                cuts = [raw[a:b] for a, b in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([inner.field("h"), inner.field("large"), part.column("doc_id").take(pa.array(owner)), *(inner.field(c) for c in ("copy", "first", "windows")), pa.array(cuts, pa.binary())], ["h", "large", *PLACE, "windows", "bytes"])

    found = documents.join(per_doc, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "runs")
    return found.mapInArrow(cut, f"h bigint, large boolean, doc_id {kind}, copy int, first int, windows smallint, bytes binary")


def _finer(runs_: DataFrame, length: int, k: int) -> DataFrame:
    """Cuts runs (place, bytes) into runs by anchors of k bytes: h, run, place, windows, bytes."""
    kind = runs_.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "bytes"):
                data, at = C.flat(part.column("bytes"))
                row, inside, _, count, h, content = runs(data, at, length, k)
                raw, start, rows = data.tobytes(), at[row] + inside, pa.array(row)
                cuts = [raw[a:b] for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
                first = np.asarray(part.column("first"))[row] + inside
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc_id").take(rows), part.column("copy").take(rows), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(cuts, pa.binary())], ["h", "run", *PLACE, "windows", "bytes"])

    # Dealt by place, so that the runs of one anchor, which lie together, are spread over all tasks.
    return runs_.select(*PLACE, "bytes").repartition(*PLACE).mapInArrow(cut, f"h bigint, run bigint, doc_id {kind}, copy int, first int, windows smallint, bytes binary")


def _repeats_in_blocks(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """Ranges (doc_id, copy, start, end) of windows that an earlier run of the same anchor has, by equal_windows on blocks."""
    kind = contexts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> pa.RecordBatch:
            named = list(zip(table["doc_id"].to_pylist(), table["copy"].to_pylist(), strict=True))
            docs = sorted(set(named))
            ranks = {d: i for i, d in enumerate(docs)}
            docs_rank = np.array([ranks[d] for d in named])
            first, windows = (np.asarray(table[c]).astype(np.int64) for c in ("first", "windows"))
            classes, starts = equal_windows(table["bytes"].to_pylist(), length)
            owner = np.repeat(np.arange(len(first)), windows)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            start, doc, cls = first[owner] + inside, docs_rank[owner], classes[starts[owner] + inside]
            order = np.lexsort((start, doc, cls))
            # In sorted order the first place of a class stays; a repeated row repeats its place.
            lead = np.concatenate(([True], cls[order][1:] != cls[order][:-1]))
            heads = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            later = order[(doc[order] != doc[order][heads]) | (start[order] != start[order][heads])] if len(order) else order
            later = later[np.lexsort((start[later], doc[later]))]
            d, s = doc[later], start[later]
            opens = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)))) if len(d) else np.zeros(0, int)
            last = s[np.append(opens[1:], len(s)) - 1] if len(d) else s
            ids, copies = ([docs[i][c] for i in d[opens].tolist()] for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(ids, table.schema.field("doc_id").type), pa.array(copies, pa.int32()), pa.array(s[opens].astype(np.int32)), pa.array((last + length).astype(np.int32))], ["doc_id", "copy", "start", "end"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            h, lengths = np.asarray(batch.column("h")), np.asarray(pc.binary_length(batch.column("bytes"))).astype(np.int64)
            at = 0
            for stop in [*(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), batch.num_rows]:
                new = not held or held[-1].column("h")[-1].as_py() != int(h[at])
                if held and new and size >= block:
                    yield work(pa.Table.from_batches(held))
                    held, size = [], 0
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    size += int(lengths[at:stop].sum())
                at = stop
        if held:
            yield work(pa.Table.from_batches(held))

    rows = contexts.select("h", *PLACE, "windows", "bytes").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, f"doc_id {kind}, copy int, start int, end int")


def _whole(spark: SparkSession, runs_: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Of runs (h, run, place, windows) that share anchors: the ranges of those that an earlier run equals as a whole, and
    the earliest of each kind, with ``large``, where their anchor has several kinds (``large``: more than ``group``)."""
    kinds = runs_.groupBy("h", "run").agg(F.min(F.struct(*PLACE, "windows")).alias("e"), F.count("*").alias("n"))
    kinds = materialize(spark, kinds.select("h", "run", "e.*", "n"), "different-runs")
    earliest = kinds.where("n > 1").select("h", "run", *(F.col(c).alias(f"_{c}") for c in PLACE), "n")
    same = [F.col(c) == F.col(f"_{c}") for c in PLACE]
    later = counted_join(runs_.select("h", "run", *PLACE, "windows"), earliest, ["h", "run"], PLACE).where(~(same[0] & same[1] & same[2]))
    later = later.select("doc_id", "copy", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (length - 1)).alias("end"))
    several = materialize(spark, kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").withColumn("large", F.col("n") > group), "several-runs")
    return later, counted_join(kinds.select("h", *PLACE, "windows"), several, ["h"], PLACE)


def repeats(spark: SparkSession, documents: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Byte ranges (doc_id, copy, start, end; they may overlap) that strings of ``length`` bytes cover which also start earlier."""
    ship_package(spark)
    with scratch(spark):
        return materialize(spark, _repeats(spark, documents, length, k, block, group), "repeats", keep=True)


def _repeats(spark: SparkSession, documents: DataFrame, length: int, k: int, block: int, group: int) -> DataFrame:
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    if texts.groupBy("doc_id").count().where("count > 1").head(1):
        texts = materialize(spark, texts.distinct(), "different-documents")
    with scratch(spark):
        shared = materialize(spark, _anchors(texts, length, k, full=False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared-anchors")
        dup = materialize(spark, counted_join(_anchors(texts, length, k, full=True), shared, ["h"], PLACE), "shared-runs")
        later, wanted = _whole(spark, dup, length, group)
        found = materialize(spark, later, "later-runs", keep=True)
        contexts = materialize(spark, _contexts(texts, wanted, length), "contexts", keep=True)
    for share in LONGER:
        found = found.unionByName(materialize(spark, _repeats_in_blocks(contexts.where("NOT large"), length, block), "later-windows"))
        crowded = contexts.where("large")
        if not crowded.head(1):
            break
        finer = materialize(spark, _finer(crowded, length, max(k, round(share * length))), "finer-runs")
        later, wanted = _whole(spark, finer, length, group)
        found = found.unionByName(materialize(spark, later, "later-runs"))
        contexts = materialize(spark, wanted.join(finer.select(*PLACE, "bytes"), PLACE), "contexts")
    return found


def without_repeats(spark: SparkSession, documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (the maximal removed ranges of bytes), kept (the other bytes, joined)."""
    found = repeats(spark, documents, length).groupBy("doc_id").agg(F.collect_set(F.struct("copy", "start", "end")).alias("found")).withColumnRenamed("doc_id", "_id")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text"):
                data, at = C.flat(part.column("text"))
                spans, kept = [], []
                for i, (copy, ranges) in enumerate(zip(_copy(data, at).tolist(), part.column("found").to_pylist(), strict=True)):
                    own, merged = data[at[i] : at[i + 1]], []
                    for a, b in sorted((r["start"], r["end"]) for r in ranges or () if r["copy"] == copy):
                        if merged and a <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], b)
                        else:
                            merged.append({"start": a, "end": b})
                    keep = np.ones(len(own), bool)
                    for m in merged:
                        keep[m["start"] : m["end"]] = False
                    spans.append(merged)
                    kept.append(own[keep].tobytes() if merged else own.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    texts, named = documents.select("doc_id", "text"), F.col("doc_id").isNotNull()
    joined = texts.where(named).join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "found")
    joined = joined.unionByName(texts.where(~named), allowMissingColumns=True)  # rows without an id need no partner, nor a shuffle
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix": op6_suffix}

#: Every window as hex text; all but the first of each are repeats.
ORACLE_SQL = {
    "op6_suffix": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 512)) AS lo FROM d),
p AS (SELECT doc_id, lo, least(512, length(h) // 2 - 99 - lo) AS n, substr(h, 2 * lo + 1, 1222) AS part FROM c),
w AS (SELECT doc_id, lo + i AS i, substr(part, (2 * i + 1)::INT, 200) AS s FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT t.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, (2 * before + 1)::INT, (2 * (a - before))::INT), '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
