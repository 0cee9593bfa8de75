"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of 13 consecutive words (a shorter item is one window). A window is a set of
word shingles, and a document contains it only if it contains all of them, so at full containment one shingle of each
window is a sufficient prefix. All shingles of the benchmark are counted over all documents; each window's prefix is its
rarest one. Documents offer only occurrences of prefix shingles, with the words around them; these meet the windows in an
equi-join on the shingle, the window's place in the document follows from the shingle's offset (positional bound) and must
lie inside the document (length bound), and the words are compared one by one. Shingles with many occurrences are split in the
join by their counts.

The benchmark goes to the tasks in blocks of at most ``block_shingles`` shingle hashes (8 bytes each), whatever its size;
each block is one pass over the documents. Document text is never shuffled, only the neighbourhood of prefix occurrences.

Null or word-free texts have no words and are never contaminated. Rows that repeat both doc_id and text count as one
document; rows with the same doc_id and other text stay apart. A null item_id takes part in hits, not in the item list.
An empty benchmark or document table gives no hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytally.llm import columnar as C
from skytally.llm.joins import counted_join
from skytally.session import lean_workers, materialize, ship_package

WINDOW, SHINGLE = 13, 5
BLOCK_SHINGLES = 4_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hashed(batch: pa.RecordBatch) -> tuple:
    """Bytes, row starts, words (start, end, per row), each word's row and hash."""
    data, at = C.flat(batch.column("text"))
    low = C.LOWER[data]
    start, end, per_row = C.words(low, at, C.ALNUM)
    row = np.repeat(np.arange(len(per_row)), per_row)
    return low, at, start, end, per_row, row, C.ranges_hash(C.prefix_sums(low), start, end)


def _found(vocabulary: dict[int, np.ndarray], hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle length: the word indexes at which shingles of the (sorted) vocabulary begin, and their hashes."""
    for k, known in vocabulary.items():
        at, h = C.shingle_hash(hashes, row, k)
        if len(known) and len(h):
            seen = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            yield k, at[seen], h[seen]


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per window of every item: item_id, words, k (words of its shingles). Equal windows of an item are one."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct().withColumn("k", F.least(F.size("words"), F.lit(shingle)))


def _shingles(wins: DataFrame) -> DataFrame:
    """Each window's shingles with their offsets and hashes."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text", C.SMALL):
                *_, per_row, row, h = _hashed(part)
                out: list[list[int]] = [[] for _ in range(part.num_rows)]
                ks = np.asarray(part.column("k"))
                for k in np.unique(ks):
                    at, sh = C.shingle_hash(h, row, int(k))
                    first = np.concatenate(([0], np.cumsum(per_row)))
                    for i, s in zip(at.tolist(), sh.view(np.int64).tolist(), strict=True):
                        if ks[row[i]] == k:
                            out[row[i]].append((i - int(first[row[i]]), s))
                rows = [(w, k, o, s) for w, k, got in zip(part.column("window").to_pylist(), ks.tolist(), out, strict=True) for o, s in got]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["window", "k", "offset", "token"])

    texts = wins.select(F.concat_ws(" ", "words").alias("window"), "k").distinct().withColumn("text", F.col("window"))
    return texts.mapInArrow(hashes, "window string, k int, offset int, token bigint")


def _vocabulary(tokens: DataFrame) -> dict[int, np.ndarray]:
    """Sorted shingle hashes by shingle length, for one block (bounded by its size)."""
    got = tokens.select("k", "token").distinct().toPandas()
    return {int(k): np.sort(g["token"].to_numpy().astype(np.int64).view(np.uint64)) for k, g in got.groupby("k")}


def frequencies(documents: DataFrame, vocabulary: dict[int, np.ndarray]) -> DataFrame:
    """How often each shingle of the vocabulary occurs in all documents: k, token, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, v in vocabulary.items()}
        for batch in batches:
            for part in C.pieces(batch, "text", C.SMALL):
                *_, row, h = _hashed(part)
                for k, _, got in _found(vocabulary, h, row):
                    totals[k] += np.bincount(np.searchsorted(vocabulary[k], got), minlength=len(totals[k]))
        for k, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(vocabulary[k][seen].view(np.int64)), pa.array(n[seen])], ["k", "token", "n"])

    return documents.select("text").mapInArrow(count, "k int, token bigint, n bigint").groupBy("k", "token").agg(F.sum("n").alias("n"))


def _occurrences(documents: DataFrame, prefixes: dict[int, np.ndarray], window: int) -> DataFrame:
    """A row per document (k is 0, the token spreads such rows), and one per occurrence of a prefix shingle with the words around it."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text", C.SMALL):
                low, at, start, end, per_row, row, h = _hashed(part)
                raw, first = low.tobytes(), np.concatenate(([0], np.cumsum(per_row)))
                copy = C.ranges_hash(C.prefix_sums(C.flat(part.column("text"))[0]), at[:-1], at[1:]).view(np.int64)
                rows, pos, tokens, froms, around, ks = [np.arange(part.num_rows)], [], copy.tolist(), [], [], [0] * part.num_rows
                for k, i, got in _found(prefixes, h, row):
                    rows.append(row[i])
                    own = first[row[i]]
                    lo, hi = np.maximum(i - (window - k), own), np.minimum(i + window, first[row[i] + 1])
                    pos += (i - own).tolist()
                    froms += (lo - own).tolist()
                    ks += [k] * len(i)
                    tokens += got.view(np.int64).tolist()
                    around += [" ".join(raw[s:e].decode() for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                rows, none = np.concatenate(rows), [None] * part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), pa.array(copy[rows]), pa.array(per_row[rows].astype(np.int64)), pa.array(ks, pa.int32()), pa.array(tokens, pa.int64()), pa.array(none + pos, pa.int32()), pa.array(none + froms, pa.int32()), pa.array(none + around, pa.string())],
                    ["doc_id", "copy", "n_words", "k", "token", "pos", "from", "around"],
                )

    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, copy bigint, n_words bigint, k int, token bigint, pos int, from int, around string")


def contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item_ids), contaminated: see the module's docstring."""
    ship_package(spark)
    lean_workers(spark)
    wins = windows(benchmark, window, shingle).select("item_id", F.concat_ws(" ", "words").alias("window"), F.size("words").alias("w_len"))
    tokens = materialize(spark, _shingles(windows(benchmark, window, shingle)), "benchmark-shingles")
    blocks = max(1, -(-tokens.count() // block_shingles))
    found = None
    for b in range(blocks):
        mine = tokens.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        counts = frequencies(documents, _vocabulary(mine))
        rank = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "token", "offset")
        prefix = mine.join(counts, ["k", "token"], "left").withColumn("rank", F.row_number().over(rank)).where("rank = 1")
        # One row per prefix shingle, with the windows of the benchmark that it stands for and how often it occurs.
        prefix = prefix.join(wins, "window").groupBy("k", "token").agg(F.coalesce(F.first("n"), F.lit(0)).alias("n"), F.collect_list(F.struct("window", "item_id", "w_len", "offset")).alias("at"))
        prefix = materialize(spark, prefix, "benchmark-prefixes")
        seen = _occurrences(documents, _vocabulary(prefix), window)
        # A shingle that many documents hold is split by its count.
        placed = counted_join(seen, prefix, ["k", "token"], ["doc_id", "copy", "pos"], "left").select(*seen.columns, F.explode_outer("at").alias("at"))
        placed = placed.select(*seen.columns, "at.*").withColumn("start", F.col("pos") - F.col("offset"))
        fits = (F.col("start") >= F.col("from")) & (F.col("start") + F.col("w_len") <= F.col("n_words"))
        same = F.array_join(F.slice(F.split("around", " "), F.greatest(F.col("start") - F.col("from") + 1, F.lit(1)), F.col("w_len")), " ") == F.col("window")
        hit = F.coalesce(fits & same, F.lit(False))
        part = placed.groupBy("doc_id", "copy", "n_words").agg(F.collect_set(F.when(hit, F.struct("start", "w_len"))).alias("at"), F.collect_set(F.when(hit, F.col("item_id"))).alias("items"))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("doc_id", "copy", "n_words").agg(F.flatten(F.collect_list("at")).alias("at"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # Lengths of the union of the word ranges, taken in order of their starts.
    union = F.aggregate(F.array_sort("at"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(x["start"] + x["w_len"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["start"] + x["w_len"]).alias("end")))["n"]
    out = found.select("doc_id", "copy", "n_words", union.cast("long").alias("n_hit"), F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(spark, documents, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _with_copy(documents: DataFrame) -> DataFrame:
    """All columns, with _copy: the hash of the text that ``contamination`` tells copies by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "text", C.SMALL):
                data, at = C.flat(part.column("text"))
                copy = C.ranges_hash(C.prefix_sums(data), at[:-1], at[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(copy)], [*part.schema.names, "_copy"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), "_copy bigint"])
    return documents.mapInArrow(run, schema)


def decontaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were. Rows of an id stay or go together; rows
    without an id are judged by their own text.
    """
    name = C.spare(documents.columns, "_bad")
    bad = contamination(spark, documents.select("doc_id", "text"), benchmark).where("contaminated").select(F.col("doc_id").alias(name), F.col("copy").alias("_bad_copy")).distinct()
    bad = materialize(spark, bad, "contaminated")
    named = documents.where("doc_id IS NOT NULL").join(bad.select(name).distinct(), F.col("doc_id") == F.col(name), "left_anti")
    packed = documents.where("doc_id IS NULL").select("text", F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    rest = _with_copy(packed).join(bad.where(F.col(name).isNull()).select("_bad_copy"), F.col("_copy") == F.col("_bad_copy"), "left_anti")
    return named.unionByName(rest.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns)))


QUERIES = {"op7_decontaminate": op7_decontaminate}

ORACLE_SQL = {
    "op7_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM wins),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens)),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN wins USING (win)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)""",
}
