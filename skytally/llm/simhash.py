"""Near duplicates by SimHash and a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, words are runs of anything but white space, shingles of three words (repeats included)
hashed with XXH64 (seed 42); a fingerprint bit is set if over half of the hashes have it. Fingerprints that differ in at
most ``DISTANCE`` bits are linked, and links make components.

The index is a hierarchy of masked bit patterns. Its upper nodes fix the bits of one of DISTANCE + 1 blocks (two linked
fingerprints agree on at least one block); a node with more than ``LEAF`` fingerprints is refined once by blocks of its free
bits. Within a node, fingerprints lie in Gray rank order, and runs of 4, 16, 64, ... neighbours share a pattern: the bits
that all of them have or lack. Two runs are compared by their patterns first: if the shared bits differ in more than
DISTANCE places the whole pair of runs is dropped, if all bits that could differ are at most DISTANCE the whole pair is
linked, else their parts are compared. A node's links leave it as a spanning star, never as pairs.

A node that stays large is a dense cluster. Its fingerprints are first linked in pieces of the Gray order, under several
rotations of the bits, which mostly makes one component of it; then nothing is left to find there. In dense nodes with several
components, what is missing is a link of a stray, a fingerprint outside its node's largest component. Fingerprints at most
DISTANCE bits apart have a third one between them: strays name all codes within ``STRAY_BITS`` bits (2081), the node's other
fingerprints those within the rest (65), and equal names are links. So no code is named by more than so many, however dense
the data, and rows grow with the fingerprints.

Equal fingerprints are one entry, so a third of all rows being copies is one entry as well. Nothing is collected but counts.

Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id get a component like others
(null if no member has an id); the stage keeps one row of a component without ids, and otherwise none that lacks an id. Rows
that repeat an id are one document to the stage: all of them stay or go. Other columns
are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytally.llm import columnar as C
from skytally.llm import copies
from skytally.llm.components import stars
from skytally.llm.joins import counted_join
from skytally.session import materialize, scratch, ship_package

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints that a node of the index holds at most before it is refined, and in a piece of the Gray order.
LEAF = 1024
#: Rotations of the bits under which dense nodes are cut into pieces.
TURNS = range(0, 64, 8)
#: Of the differing bits, how many a stray's names cover.
STRAY_BITS = 2
#: Rows and pairs of runs that one numpy step holds.
STEP, PAIRS = 20_000, 500_000


def simhash(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row."""
    low = C.LOWER[data]
    start, end, per_row = C.words(low, at, C.NOT_SPACE)
    first = np.concatenate(([0], np.cumsum(per_row)))
    # One space after each word, and no other white space: a shingle is then a slice.
    keep = C.NOT_SPACE[low]
    low[~keep] = 0x20
    keep[end[end < len(low)]] = True
    place = np.cumsum(keep) - 1
    raw, start, end = low[keep].tobytes(), place[start] if len(start) else start, place[end - 1] + 1 if len(end) else end
    # Shingle s of a row begins at its word s; a row of fewer words has one, over all of them.
    count = np.where(per_row == 0, 0, np.maximum(per_row - shingle + 1, 1))
    row = np.repeat(np.arange(len(per_row)), count)
    begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(begin + shingle, first[row + 1]) - 1
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(per_row), np.uint64)
    if len(row):
        h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(start[begin].tolist(), end[last].tolist(), strict=True)), np.uint64, len(row))
        full = np.flatnonzero(count)
        offsets = (np.cumsum(count) - count)[full]
        votes = np.empty((len(full), 64), np.int32)
        bits = h.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            votes[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(bits[:, byte : byte + 1], axis=1, bitorder="little"), offsets, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * votes > count[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(spark: SparkSession, documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number)."""
    ship_package(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(simhash(*C.flat(part.column("text")), shingle).view(np.int64))], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; labels become the smallest member of each class."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def link_nodes(codes: np.ndarray, node: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For codes sorted by node and Gray rank: the index of the smallest code that each is connected to within its node."""
    n = len(codes)
    label = np.arange(n)
    if n < 2:
        return label
    begins = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    size = np.diff(np.append(begins, n))
    # Levels of runs: at level l a run has up to 4^l codes of one node. Parents know their first child and how many.
    levels = [(codes, codes, None, None)]
    first, count = begins, size
    while count.max() > 1:
        ones, some, *_ = levels[-1]
        parents = -(-count // 4)
        starts = np.repeat(first, parents) + 4 * (np.arange(parents.sum()) - np.repeat(np.cumsum(parents) - parents, parents))
        ends = np.minimum(starts + 4, np.repeat(first + count, parents))
        levels.append((np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts), starts, ends - starts))
        first, count = np.cumsum(parents) - parents, parents
    grid = np.array([(i, j) for i in range(4) for j in range(4)])
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    todo = [(top, roots[i : i + PAIRS], roots[i : i + PAIRS]) for i in range(0, len(roots), PAIRS)]
    lows = [np.arange(n)]  # the first code under each run
    for _, _, starts, _ in levels[1:]:
        lows.append(lows[-1][starts])
    while todo:
        level, a, b = todo.pop()
        ones, some, starts, children = levels[level]
        if level == 0:
            near = np.bitwise_count(codes[a] ^ codes[b]) <= distance
            _settle(label, a[near], b[near])
            continue
        fixed = ~(ones[a] ^ some[a]) & ~(ones[b] ^ some[b])
        differ = (ones[a] ^ ones[b]) & fixed
        least, most = np.bitwise_count(differ), np.bitwise_count(differ | ~fixed)
        whole = most <= distance  # any two codes below are linked: one star does
        for run in np.unique(np.concatenate([a[whole], b[whole]])) if whole.any() else ():
            lo = lows[level][run]
            hi = lows[level][run + 1] if run + 1 < len(lows[level]) else n
            _settle(label, np.arange(lo + 1, hi), np.full(hi - lo - 1, lo))
        _settle(label, lows[level][a[whole]], lows[level][b[whole]])
        open_ = (least <= distance) & ~whole
        a, b = a[open_], b[open_]
        step = max(1, PAIRS // 16)
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            i, j = grid[:, 0][None, :], grid[:, 1][None, :]
            ok = (i < children[x][:, None]) & (j < children[y][:, None]) & ((x != y)[:, None] | ((i <= j) if level > 1 else (i < j)))
            p, q = (starts[x][:, None] + i)[ok], (starts[y][:, None] + j)[ok]
            if len(p):
                todo.append((level - 1, p, q))
    return label


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int, most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by the first ``keys`` columns, in steps of whole groups of equal keys, each STEP rows or a group at least;
    with ``most``, groups are cut after so many rows, and the last column returned numbers the pieces."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def numbered(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        new = np.zeros(len(rows[0]), bool)
        new[:1] = True
        for key in rows[:keys]:
            new[1:] |= key[1:] != key[:-1]
        node = np.cumsum(new)
        if most:
            begins = np.flatnonzero(new)
            node = node * (1 << 32) + (np.arange(len(node)) - begins[node - 1]) // most
        return (*rows, node)

    for batch in batches:
        held.append(tuple(np.asarray(batch.column(c)) for c in columns))
        size += batch.num_rows
        if size >= STEP:
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            # The last group may go on in the next batch.
            last = np.ones(size, bool)
            for key in rows[:keys]:
                last &= key == key[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if most and not cut:
                cut = size // most * most
            if cut:
                yield numbered(tuple(x[:cut] for x in rows))
            held, size = [tuple(x[cut:] for x in rows)], size - cut
    if size:
        yield numbered(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def _stars_of(codes: np.ndarray, node: np.ndarray, distance: int) -> pa.RecordBatch:
    order = np.lexsort((copies.gray_rank(codes), node))
    codes = codes[order]
    label = link_nodes(codes, node[order], distance)
    other = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(codes[other].view(np.int64)), pa.array(codes[label[other]].view(np.int64))], ["a", "b"])


def _leaves(rows: DataFrame, distance: int) -> DataFrame:
    """rows: path, pattern, fp, each node small. The links of each node as stars: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, fp, node in _groups(batches, ["path", "pattern", "fp"], 2):
            yield _stars_of(fp.view(np.uint64), node, distance)

    return rows.repartition("path", "pattern").sortWithinPartitions("path", "pattern").mapInArrow(run, "a bigint, b bigint")


def _pieces(codes: DataFrame, distance: int, leaf: int) -> DataFrame:
    """The links within pieces of ``leaf`` neighbours in Gray order, under every rotation: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, fp, node in _groups(batches, ["turn", "rank", "fp"], 1, leaf):
            yield _stars_of(fp.view(np.uint64), node, distance)

    turned = codes.select("fp", F.explode(F.array(*map(F.lit, TURNS))).alias("turn"))
    bits = lambda n: F.expr(f"shiftrightunsigned(rank, {n})")
    turned = turned.withColumn("rank", F.expr("shiftleft(fp, turn) | IF(turn = 0, 0L, shiftrightunsigned(fp, 64 - turn))"))
    for n in (1, 2, 4, 8, 16, 32):
        turned = turned.withColumn("rank", F.col("rank").bitwiseXOR(bits(n)))
    return turned.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank").mapInArrow(run, "a bigint, b bigint")


def masks(fixed: int, blocks: int, distance: int) -> list[int]:
    """Masks that fix ``fixed`` and all but ``distance`` of so many blocks of the free bits: two codes that differ in at
    most so many bits, none of them fixed, agree under at least one mask."""
    free = [b for b in range(63, -1, -1) if not fixed >> b & 1]
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(blocks)]
    return [fixed | sum(p for i, p in enumerate(parts) if i not in out) for out in combinations(range(blocks), distance)]


def _ball(rows: DataFrame, radius: int) -> DataFrame:
    """rows: fp, root. Every code within so many bits of each fingerprint: name, fp, root."""
    names = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, step := max(1, PAIRS // len(names))):
                part = batch.slice(k, step)
                fp, root = (np.asarray(part.column(c)) for c in ("fp", "root"))
                near = (fp.view(np.uint64)[:, None] ^ names).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fp, len(names))), pa.array(np.repeat(root, len(names)))], ["name", "fp", "root"])

    return rows.select("fp", "root").mapInArrow(run, "name bigint, fp bigint, root bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(rows: DataFrame, children: dict[int, list[int]]) -> DataFrame:
    """rows: path, fp. A row for each child of its path: path (the child's number), pattern, fp."""
    numbers, table = {}, []
    for path, below in children.items():
        numbers[path] = (len(table), len(table) + len(below) - 1)
        table += below
    first, last = (F.element_at(F.array(*(F.lit(numbers.get(p, (0, 0))[i]) for p in range(max(children) + 1))), F.col("path") + 1) for i in (0, 1))
    all_masks = F.array(*(F.lit(_signed(m)).cast("long") for m in table))
    out = rows.select(F.explode(F.sequence(first, last)).alias("path"), "fp")
    return out.withColumn("pattern", F.col("fp").bitwiseAND(F.element_at(all_masks, F.col("path") + 1)))


def links(spark: SparkSession, codes: DataFrame, distance: int = DISTANCE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links within the distance."""
    paths, found, node = {0: masks(0, distance + 1, distance)}, None, ["path", "pattern"]
    rest = codes.select(F.lit(0).alias("path"), "fp")
    for last in (False, True):
        nodes = _nodes(rest, paths)
        large = nodes.groupBy(*node).agg(F.count("*").alias("n")).where(F.col("n") > leaf).withColumn("large", F.lit(True))
        large = materialize(spark, large, "large-nodes")
        any_large = bool(large.head(1))
        marked = counted_join(nodes, large, node, ["fp"], "left") if any_large else nodes
        edges = _leaves(marked.where("large IS NULL").drop("large") if any_large else nodes, distance)
        found = edges if found is None else found.unionByName(edges)
        if not any_large:
            return found
        rest = materialize(spark, marked.where("large").select("path", "pattern", "fp"), "refined-nodes")
        if not last:
            # A child fixes one more block of its parent's free bits.
            paths = {i: masks(m, distance + 1, distance) for i, m in enumerate(paths[0])}
    dense = materialize(spark, rest.select("fp").distinct(), "dense-codes")
    found = stars(spark, found.unionByName(_pieces(dense, distance, leaf)))
    rooted = rest.join(found, F.col("fp") == F.col("a"), "left").select(*node, "fp", F.coalesce("b", "fp").alias("root"))
    shares = rooted.groupBy(*node, "root").agg(F.count("*").alias("share"))
    open_ = shares.groupBy(*node).agg(F.count("*").alias("roots"), F.sum("share").alias("n"), F.max(F.struct("share", "root")).alias("most")).where("roots > 1")
    open_ = materialize(spark, open_.select(*node, "n", F.col("most.root").alias("main")), "open-nodes")
    if not open_.head(1):
        return found
    left = materialize(spark, counted_join(rooted, open_, node, ["fp"]).groupBy("fp", "root").agg(F.max((F.col("root") != F.col("main")).cast("int")).alias("stray")), "open-codes")
    strays = _ball(left.where("stray = 1"), min(distance, STRAY_BITS)).select("name", F.col("fp").alias("a"), F.col("root").alias("_root"))
    named = _ball(left, max(0, distance - STRAY_BITS))
    # Of all links between a stray and a component one is enough.
    crossing = strays.join(named, "name").where("root != _root").groupBy("a", "root").agg(F.min("fp").alias("b"))
    return found.unionByName(crossing.select("a", "b"))


def near_duplicates(spark: SparkSession, documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: every row of the documents with the smallest doc_id of its component."""
    prints = materialize(spark, fingerprints(spark, documents, shingle), "fingerprints")
    codes = materialize(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "codes")
    with scratch(spark):
        found = materialize(spark, stars(spark, links(spark, codes, distance)), "linked", keep=True)
    rooted = codes.join(found, F.col("fp") == F.col("a"), "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    rooted = materialize(spark, rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root")
    named = rooted.join(smallest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents without those of whose component a document with a smaller id exists.

    SimHash fingerprints of five-word shingles are linked within three bits by the index of ``links``, and the links checked on
    the texts at a similarity of 0.8. At 0.8 about ten bits differ, which no selective mask survives: what the index can't
    reach is added by shared minima and the same check (``copies``).

    Rows without an id go if their component has a row with one. Of a component without any id one row stays: the first by
    text, then by the other columns of atomic types.
    """
    found = copies.components(spark, documents, links)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(C.spare(documents.columns, "_gone"))).distinct()
    gone = materialize(spark, gone, "near-duplicates")
    named = documents.where("doc_id IS NOT NULL").join(gone, F.col("doc_id") == F.col(gone.columns[0]), "left_anti")
    # Rows without an id are known by what their texts hold.
    alone = found.where("doc_id IS NULL AND component_id IS NULL").select(F.col("code").alias("_set"), F.col("root").alias("_root")).distinct()
    order = [F.col("text"), *(F.col(f"`{f.name}`") for f in documents.schema if isinstance(f.dataType, T.AtomicType))]
    packed = documents.where("doc_id IS NULL").select("text", F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))).alias("order"))
    rows = copies.coded(packed).join(alone, F.col("_code") == F.col("_set"))
    kept = rows.groupBy("_root").agg(F.min_by("row", "order").alias("row"))
    return named.unionByName(kept.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns)))


QUERIES = {"op5_simhash": op5_simhash}

ORACLE_SQL: dict[str, str] = {}
