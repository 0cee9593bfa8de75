"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash, MinHash and
exact checks.

Words are those of ``simhash`` (A-Z lower-cased, runs of anything but white space); a text of fewer than five words is one
shingle, a null or empty text the empty set, and equal sets are always linked. Candidates come from an index of the sets'
SimHash fingerprints (``simhash.links``, few differing bits) first. Edits that leave a similarity of 0.8 change about ten of 64
bits, too many for such an index, so further candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each. A pair at
similarity 0.8 misses all keys with probability 2.6e-5, one at 0.85 with 4e-7.

Equal sets are one entry. Entries that the index links, and entries that share a key, are candidates:

1. The index gives stars of fingerprints, and those of one fingerprint make a star. In each key the entries of a key are put in the Gray order of their SimHash fingerprints (of the same shingles). Each meets the next
   ``AHEAD`` and the key's leader, the entry of smallest hash. Of all whom it meets, the one with most minima in common, the
   leaders and those of its stars are checked on the shingles of both texts. Checked links make components; that settles
   nearly all.
2. Keys with several components left are done exactly. Every entry outside the key's largest component meets all entries of
   other components, and the one with most minima in common is checked. Where components are still apart after that, it is
   checked with all entries of the largest component that it has enough minima in common with, and with all others outside.
   Keys and components with more than ``LEAF`` entries are dealt into parts of about that many for it, and what is outside
   goes to every part. Texts of this step go to the tasks once for each component or key that they are checked in. Texts lie
   in buckets of their sets' hashes, so that only those which travel with a pair are shuffled.

Candidates of a key with fewer than ``EQUAL`` of all minima in common are left out: at similarity 0.8 that happens with probability
1e-5.

Rows of the first step grow with the entries. Those of the second are, for each open key, its entries outside the largest
component times its entries / ``LEAF``: one row an entry up to ``LEAF`` of them, but of a key that far more dissimilar texts
share, the square over ``LEAF``. No candidate of a key is left out but by its minima.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import columnar as C
from skytally.llm.components import stars
from skytally.llm.joins import counted_join
from skytally.session import bucketed, lean_workers, materialize, scratch, ship_package

Index = Callable[[SparkSession, DataFrame], DataFrame]
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Followers in Gray order that an entry meets in each of its keys at first.
AHEAD = 2
#: Minima of BANDS * ROWS that candidates have in common at least; entries of a part of a key or component.
EQUAL, LEAF = 48, 2048
#: Bits of the filter that texts pass before they are shuffled.
FILTER = 1 << 24
#: Rows that a step of pairing holds before it works.
STEP = 20_000
_RNG = np.random.default_rng(42)
FLIP, TURN = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64), _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The set of each row's shingle hashes: all hashes, ascending within their rows, and where each row begins (one more)."""
    low = C.LOWER[data]
    start, end, per_row = C.words(low, at, C.NOT_SPACE)
    row = np.repeat(np.arange(len(per_row)), per_row)
    h = C.ranges_hash(C.prefix_sums(low), start, end)
    begin, out = C.shingle_hash(h, row, shingle)
    rows, hashes = [row[begin]], [out]
    for k in range(1, shingle):
        begin, out = C.shingle_hash(h, row, k)
        short = per_row[row[begin]] == k
        rows.append(row[begin][short])
        hashes.append(out[short])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[once], np.searchsorted(row[once], np.arange(len(per_row) + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's set: a hash of the set, the keys (rows x BANDS), and a byte of each minimum. Empty sets have zeros."""
    rows, full = len(at) - 1, np.flatnonzero(np.diff(at))
    code, keys, brief = np.zeros(rows, np.uint64), np.zeros((rows, BANDS), np.uint64), np.zeros((rows, BANDS * ROWS), np.uint8)
    if len(full):
        code[full] = C.mix(np.add.reduceat(C.mix(h), at[full]) + np.diff(at)[full].astype(np.uint64))
        for band in range(BANDS):
            key = np.full(len(full), band, np.uint64)
            for i in range(band * ROWS, band * ROWS + ROWS):
                least = C.mix(np.minimum.reduceat((h ^ FLIP[i]) * TURN[i], at[full]))
                key = C.mix(key + least)
                brief[full, i] = (least & np.uint64(255)).astype(np.uint8)
            keys[full, band] = key
    return code, keys, brief


def prints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each row's set."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros(len(at) - 1, np.uint64)
    if len(full):
        bits, size = C.mix(h).view(np.uint8).reshape(-1, 8), np.diff(at)[full]
        votes = np.empty((len(full), 64), np.int32)
        for byte in range(8):
            votes[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(bits[:, byte : byte + 1], axis=1, bitorder="little"), at[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def coded(documents: DataFrame) -> DataFrame:
    """All columns, with _code (the hash of the text's shingle set, as a signed number), _n (its size), _keys, _brief and
    _rank (of the set's fingerprint in the Gray sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text", C.SMALL):
                h, at = shingles(*C.flat(part.column("text")))
                code, keys, brief = signatures(h, at)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
                listed = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
                rank = pa.array(gray_rank(prints(h, at)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code.view(np.int64)), pa.array(np.diff(at).astype(np.int64)), listed, pa.array([b.tobytes() for b in brief], pa.binary()), rank], [*part.schema.names, "_code", "_n", "_keys", "_brief", "_rank"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), "_code bigint", "_n bigint", "_keys array<bigint>", "_brief binary", "_rank bigint"])
    return documents.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int, step: int) -> Iterator[list]:
    """Rows sorted by the first ``keys`` columns (of numbers), as one array per column, in steps of whole groups of equal
    keys: of ``step`` rows, or of one group."""
    held: list[list] = []
    size = 0
    for batch in batches:
        held.append([np.asarray(batch.column(c)) if pa.types.is_integer(batch.schema.field(c).type) or pa.types.is_boolean(batch.schema.field(c).type) else np.array([*batch.column(c).to_pylist(), None], object)[:-1] for c in columns])
        size += batch.num_rows
        if size >= step:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.ones(size, bool)
            for key in rows[:keys]:
                last &= key == key[-1]
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield [x[:cut] for x in rows]
            held, size = [[x[cut:] for x in rows]], size - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bounds(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Where groups of equal keys begin and end."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return zip(at.tolist(), np.append(at[1:], len(new)).tolist(), strict=True)


def _pairs(members: DataFrame) -> DataFrame:
    """members: key, part, code, n, rank, brief. The first candidates of each part: a, b, both ways: alike (how many minima
    they have in common), led (b is the leader of a's part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, code, n, rank, brief in _grouped(batches, ["key", "part", "code", "n", "rank", "brief"], 2, STEP):
            lefts, rights, ways = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            order_of = C.mix(code.view(np.uint64))
            for lo, hi in _bounds([key, part]):
                order = lo + np.argsort(rank[lo:hi], kind="stable")
                i, j = (np.concatenate([order[s] for s in cuts]) for cuts in zip(*((slice(None, -d), slice(d, None)) for d in range(1, AHEAD + 1)), strict=True))
                leader = lo + int(np.argmin(order_of[lo:hi]))
                others = np.delete(np.arange(lo, hi), leader - lo)
                lefts += [i, j, others]
                rights += [j, i, np.full(len(others), leader)]
                ways += [np.zeros(2 * len(i), bool), np.ones(len(others), bool)]
            i, j, led = np.concatenate(lefts), np.concatenate(rights), np.concatenate(ways)
            fits = np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j])
            i, j, led = i[fits], j[fits], led[fits]
            minima = np.frombuffer(b"".join(brief), np.uint8).reshape(len(brief), -1)
            alike = np.concatenate([np.zeros(0, np.int64), *((minima[i[k : k + 50_000]] == minima[j[k : k + 50_000]]).sum(axis=1) for k in range(0, len(i), 50_000))])
            keep = alike >= EQUAL
            yield pa.RecordBatch.from_arrays([pa.array(code[i[keep]]), pa.array(code[j[keep]]), pa.array(alike[keep].astype(np.int16)), pa.array(led[keep])], ["a", "b", "alike", "led"])

    return members.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a bigint, b bigint, alike smallint, led boolean")


def _checked(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, text, other. Those whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text", C.SMALL):
                (x, at), (y, to) = (shingles(*C.flat(part.column(c))) for c in ("text", "other"))
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    one, two = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                    both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum()) if len(two) else 0
                    keep[i] = both >= SIMILARITY * (len(one) + len(two) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "text", "other").mapInArrow(run, "a bigint, b bigint")


def _across(rows: DataFrame, best: bool) -> DataFrame:
    """rows: key, part, code, n, root, home (the entry belongs to the part), outside (it isn't of the key's largest component),
    brief. For each entry outside: a, a_root, b, root. With ``best``, b is the candidate at home in the part, of any other
    component root, with most minima in common; else, any candidate of the largest component at home in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, code, n, root, home, outside, brief in _grouped(batches, ["key", "part", "code", "n", "root", "home", "outside", "brief"], 2, STEP):
            minima = np.frombuffer(b"".join(brief), np.uint8).reshape(len(brief), -1)
            a, b = [], []
            for lo, hi in _bounds([key, part]):
                at_home = lo + np.flatnonzero(home[lo:hi] if best else home[lo:hi] & ~outside[lo:hi])
                for i in (lo + np.flatnonzero(outside[lo:hi])).tolist():
                    alike = (minima[at_home] == minima[i]).sum(axis=1)
                    alike[(root[at_home] == root[i]) | (np.minimum(n[at_home], n[i]) < SIMILARITY * np.maximum(n[at_home], n[i]))] = 0
                    if len(alike) and alike.max() >= EQUAL:
                        a.append(i)
                        b.append(int(at_home[np.argmax(alike)]))
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code[a]), pa.array(root[a]), pa.array(code[b]), pa.array(root[b])], ["a", "a_root", "b", "root"])

    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(run, "a bigint, a_root bigint, b bigint, root bigint")


def _similar(rows: DataFrame) -> DataFrame:
    """rows: grp, part, code, root (its component), home, asks, text. Links a, b between the entries that ask and those at home
    in the part, of other components, by their shingles: one of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, part, code, root, home, asks, text in _grouped(batches, ["grp", "part", "code", "root", "home", "asks", "text"], 2, 1):
            for lo, hi in _bounds([grp, part]):
                h, at = shingles(*C.flat(pa.array(text[lo:hi].tolist(), pa.string())))
                size, owner = np.diff(at), np.repeat(np.arange(hi - lo), np.diff(at))
                order = np.argsort(h, kind="stable")
                sorted_h, sorted_owner = h[order], owner[order]
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in np.flatnonzero(asks[lo:hi]).tolist():
                    own = h[at[i] : at[i + 1]]
                    x, y = np.searchsorted(sorted_h, own, "left"), np.searchsorted(sorted_h, own, "right")
                    places = np.repeat(x, y - x) + np.arange((y - x).sum()) - np.repeat(np.cumsum(y - x) - (y - x), y - x)
                    both = np.bincount(sorted_owner[places], minlength=hi - lo)
                    near = lo + np.flatnonzero((both >= SIMILARITY * (size[i] + size - both)) & home[lo:hi] & (root[lo:hi] != root[lo + i]))
                    near = near[np.unique(root[near], return_index=True)[1]]
                    a.append(np.full(len(near), code[lo + i]))
                    b.append(code[near])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b)], ["a", "b"])

    return rows.repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(run, "a bigint, b bigint")


def _links_of(spark: SparkSession, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar, by their texts."""
    pairs = materialize(spark, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    one, two = texts.select(F.col("code").alias("_a"), "text"), texts.select(F.col("code").alias("_b"), F.col("text").alias("other"))
    return _checked(pairs.join(one.hint("merge"), F.col("a") == F.col("_a")).join(two.hint("merge"), F.col("b") == F.col("_b")))


def _open(spark: SparkSession, members: DataFrame, found: DataFrame, codes: DataFrame) -> DataFrame | None:
    """The members of keys with several components, dealt for ``_across``; None if there are none. Only they get their minima."""
    rooted = members.select("key", "code", "n", "size").join(found, F.col("code") == F.col("a"), "left").select("key", "code", "n", "size", F.coalesce("b", "code").alias("root"))
    shares = rooted.groupBy("key", "root").agg(F.count("*").alias("share"))
    open_ = shares.groupBy("key").agg(F.count("*").alias("roots"), F.sum("share").alias("n"), F.max(F.struct("share", "root")).alias("most")).where("roots > 1")
    open_ = materialize(spark, open_.select("key", "n", F.col("most.root").alias("main")), "open-keys")
    if not open_.head(1):
        return None
    parts = F.ceil(F.col("size") / LEAF).cast("long")
    left = counted_join(rooted, open_, ["key"], ["code"]).withColumns({"outside": F.col("root") != F.col("main"), "_home": F.pmod(F.xxhash64("code", "key"), parts)})
    left = left.withColumn("part", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array("_home"))))
    left = left.select("key", "part", "code", "n", "root", (F.col("part") == F.col("_home")).alias("home"), "outside")
    return materialize(spark, left.join(codes.select("code", "brief"), "code"), "open-members")


def _maybe(spark: SparkSession, rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows whose _code may be among the needed codes: all of these, and of the others about as many as the share of ``FILTER``
    bits that are set. The bits go to the driver and to every task, 2 MiB whatever the size of the tables; where most are set,
    nothing is gained, and nothing lost."""
    bit = needed.select(F.pmod(F.xxhash64("code"), F.lit(FILTER)).alias("_bit"))
    words = bit.groupBy(F.expr("_bit DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_bit % 64 AS INT)))").alias("bits")).toPandas()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    held, names = spark.sparkContext.broadcast(bits), rows.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("_bit"))
            seen = held.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(seen.astype(bool))).select(names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_bit", F.pmod(F.xxhash64("_code"), F.lit(FILTER))).mapInArrow(pick, schema)


def indexed(spark: SparkSession, codes: DataFrame, index: Index) -> DataFrame:
    """codes: code, n, rank. Candidates a, b of fitting sizes: along the links that the index finds between fingerprints, the
    least code of each, and every other code of a fingerprint with the least."""
    named = materialize(spark, codes.select("code", "n", F.expr("rank ^ shiftrightunsigned(rank, 1)").alias("fp")), "named-prints")
    least = materialize(spark, named.groupBy("fp").agg(F.min(F.struct("code", "n")).alias("m")).select("fp", "m.code", "m.n"), "distinct-prints")
    edges = materialize(spark, index(spark, least.select("fp")).select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct(), "linked-prints")
    one, two = (least.select(F.col("fp").alias(f"_{c}"), F.col("code").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    across = edges.join(one, "_a").join(two, "_b").select("a", "n_a", "b", "n_b")
    within = named.join(two, F.col("fp") == F.col("_b")).where("code != b").select(F.col("code").alias("a"), F.col("n").alias("n_a"), "b", "n_b")
    fits = F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    return materialize(spark, across.unionByName(within).where(fits).select("a", "b"), "indexed")


def links(spark: SparkSession, prints: DataFrame, index: Index) -> DataFrame:
    """prints: text, _code, _n, _keys, _brief, _rank. The components of similar sets, as ``stars`` of their codes."""
    codes = prints.groupBy(F.col("_code").alias("code")).agg(F.first("_n").alias("n"), F.first("_keys").alias("keys"), F.first("_brief").alias("brief"), F.first("_rank").alias("rank"))
    codes = bucketed(spark, codes.where("n > 0"), "sets", "code")
    near = indexed(spark, codes, index)
    # Of the keys of all sets only their hashes travel; the rest joins those that share one.
    rows = codes.select(F.explode("keys").alias("key"), "code")
    crowd = materialize(spark, rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "shared-keys")
    sharing = materialize(spark, counted_join(rows, crowd, ["key"], ["code"]), "sharing")
    members = materialize(spark, sharing.join(codes.select("code", "n", "rank", "brief").hint("merge"), "code"), "members")
    # One text of each entry that is a candidate. Texts meet the entries by a shuffle at any size, and go no further here.
    needed = materialize(spark, sharing.select("code").unionByName(near.select(F.explode(F.array("a", "b")).alias("code"))).distinct(), "needed")
    texts = _maybe(spark, prints.select("_code", "text"), needed).join(needed.hint("merge"), F.col("_code") == F.col("code")).groupBy("code").agg(F.first("text").alias("text"))
    texts = bucketed(spark, texts, "texts", "code")
    part = F.pmod(F.xxhash64("code", "key"), F.ceil(F.col("size") / LEAF).cast("long"))
    met = materialize(spark, _pairs(members.select("key", part.alias("part"), "code", "n", "rank", "brief")).distinct(), "met")
    nearest = met.groupBy("a").agg(F.max(F.struct("alike", "b")).alias("m")).select("a", "m.b")
    found = stars(spark, _links_of(spark, texts, met.where("led").select("a", "b").unionByName(nearest).unionByName(near)))
    open_ = _open(spark, members, found, codes)
    if open_ is None:
        return found
    found = stars(spark, found.unionByName(_links_of(spark, texts, _across(open_, best=True).select("a", "b"))))
    open_ = _open(spark, members, found, codes)
    if open_ is None:
        return found
    # Entries outside against the largest components, dealt by these ...
    asked = materialize(spark, _across(open_, best=False).select("a", "a_root", "root").distinct(), "asked")
    roots = members.select("code").distinct().join(found, F.col("code") == F.col("a"), "left").select("code", F.coalesce("b", "code").alias("root"))
    inside = roots.join(asked.select("root").distinct(), "root", "left_semi")
    sizes = materialize(spark, inside.groupBy("root").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / LEAF).cast("long")), "open-roots")
    here = counted_join(inside, sizes, ["root"], ["code"]).select(F.col("root").alias("grp"), F.pmod(F.xxhash64("code"), F.col("parts")).alias("part"), "code", "root", F.lit(True).alias("home"), F.lit(False).alias("asks"))
    there = asked.join(sizes.drop("n"), "root").select(F.col("root").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("code"), F.col("a_root").alias("root"), F.lit(False).alias("home"), F.lit(True).alias("asks"))
    # ... and against each other, dealt by keys.
    apart = open_.where("outside").select(F.col("key").alias("grp"), "part", "code", "root", "home", F.lit(True).alias("asks"))
    rest = [_similar(x.join(texts.hint("merge"), "code")) for x in (here.unionByName(there), apart)]
    return stars(spark, found.unionByName(rest[0]).unionByName(rest[1]))


def components(spark: SparkSession, documents: DataFrame, index: Index) -> DataFrame:
    """doc_id, code, root (of the code's component), component_id: every row with the smallest doc_id of its component.

    index: finds the links (a, b) between fingerprints ``fp``, as ``simhash.links`` does."""
    ship_package(spark)
    lean_workers(spark)
    with scratch(spark):
        return materialize(spark, _components(spark, documents, index), "near-copies", keep=True)


def _components(spark: SparkSession, documents: DataFrame, index: Index) -> DataFrame:
    prints = materialize(spark, coded(documents.select("doc_id", "text")), "prints")
    found = links(spark, prints, index)
    firsts = prints.groupBy(F.col("_code").alias("code")).agg(F.min("doc_id").alias("first"))
    rooted = materialize(spark, firsts.join(found, F.col("code") == F.col("a"), "left").select("code", "first", F.coalesce("b", "code").alias("root")), "rooted-sets")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root")
    named = rooted.join(smallest, F.col("root") == F.col("_root")).select("code", "root", "component_id")
    return prints.select("doc_id", "_code").join(named, F.col("_code") == F.col("code")).select("doc_id", "code", "root", "component_id")
