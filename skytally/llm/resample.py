"""Importance resampling towards a target distribution, by partition-local tries of words.

Features are all runs of 1 to ``n`` consecutive words, repeats counted; a feature's bucket is its CRC-32 modulo ``buckets``.

1. Each partition grows a trie of its texts' features. A node holds the feature's count and its CRC state, from which a child
   goes on with the bytes of one more word, so no feature is ever joined or hashed from its start. A full trie (``NODES``)
   adds its counts to the partition's bucket totals and starts anew; a partition gives at most ``buckets`` numbers, which are
   merged by an ordinary aggregation, of the corpus and of the target.
2. A bucket's gain is the logarithm of target share over corpus share, smoothed, in whole thousandths. A second pass walks the
   same trie paths with the gains attached to the nodes: a document's weight is the mean gain of its features.
3. Seeded Gumbel noise is added to the weights, and the highest scores among the documents of enough words are drawn: a draw
   without replacement in which a document's odds grow with its weight. The rank comes from a range partitioning by score and
   the partitions' row counts, not from one sorted task.

To the driver come ``buckets`` totals of each side and one row count per range partition.

A null or word-free text has no features and the weight 0. A null id makes noise as an empty one and ranks after the others
of its score; rows that repeat an id are separate documents with the same noise. Without a target (or corpus) rows the gains
come from the smoothing alone. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytally.llm import columnar as C
from skytally.session import materialize, scratch, ship_package

N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Nodes of a trie before its counts are added up and it is cleared; rows of a range partition when ranking.
NODES, RANKED_ROWS = 1_000_000, 500_000
#: A-Z become lower case, and what is no part of a word a blank.
LETTERS = bytes(int(C.LOWER[b]) if C.ALNUM[C.LOWER[b]] else 0x20 for b in range(256))


class Trie(dict):
    """Features of a partition. Nodes are numbers, the root is 0; an entry leads from (node, word) to the next node."""

    def __init__(self, gains: list[int] | None = None):
        super().__init__()
        self.crc, self.gains, self.gain = [0], gains, [0]

    def __missing__(self, key: tuple[int, bytes]) -> int:
        parent, word = key
        crc = zlib.crc32(b" " + word if parent else word, self.crc[parent])
        self.crc.append(crc)
        if self.gains:
            self.gain.append(self.gains[crc % len(self.gains)])
        node = self[key] = len(self.crc) - 1
        return node

    def walk(self, words: list[bytes], n: int) -> list[int]:
        """The node of every feature of the text, repeats included."""
        level = [self[0, w] for w in words]
        nodes = level
        for k in range(1, n):
            level = list(map(self.__getitem__, zip(level, words[k:], strict=False)))
            nodes = nodes + level
        return nodes


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for part in C.pieces(batch, "text"):
            yield part, [(t or "").encode().translate(LETTERS).split() for t in part.column("text").to_pylist()]


def bucket_totals(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, total: how often features of the bucket occur in all of the ``text`` column. Buckets without features are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie, counts = np.zeros(buckets, np.int64), Trie(), np.zeros(1, np.int64)

        def add() -> None:
            np.add.at(totals, np.array(trie.crc[: len(counts)], np.int64) % buckets, counts)

        for _, rows in _texts(batches):
            seen = np.bincount(np.fromiter((node for words in rows for node in trie.walk(words, n)), np.int64), minlength=len(trie.crc))
            seen[: len(counts)] += counts
            counts = seen
            if len(counts) > NODES:
                add()
                trie, counts = Trie(), np.zeros(1, np.int64)
        add()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], ["bucket", "total"])

    ship_package(texts.sparkSession)
    return texts.select("text").mapInArrow(count, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(corpus: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    sides = []
    for texts in (corpus, target):
        side = [0.0] * buckets
        for row in bucket_totals(texts, n, buckets).collect():  # one row per bucket
            side[row.bucket] = float(row.total)
        sides.append(side)
    (s, t), (of_s, of_t) = sides, map(sum, sides)
    return [math.floor(1000 * math.log((b + 1) * (of_s + buckets) / ((a + 1) * (of_t + buckets)))) for a, b in zip(s, t, strict=True)]


def weights(documents: DataFrame, gained: list[int], n: int = N) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain of the features, 0 without any)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gained)
        for part, rows in _texts(batches):
            out: list[tuple[int, int, int]] = []
            for words in rows:
                nodes = trie.walk(words, n)
                out.append((len(words), len(nodes), sum(map(trie.gain.__getitem__, nodes)) // max(1, len(nodes))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[c] for r in out], pa.int64()) for c in range(3))], ["doc_id", "n_words", "n_features", "weight"])
            if len(trie.crc) > NODES:
                trie = Trie(gained)

    ship_package(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(spark: SparkSession, rows: DataFrame, take: int) -> DataFrame:
    """Adds rank: 1, 2, 3... by descending score (equal ones: smaller doc_id) for the first ``take`` rows, null for the others."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    parts = max(1, -(-rows.count() // RANKED_ROWS))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(spark, placed, "resample-ranked").withColumn("_range", F.shiftright("_place", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row per range
    rank = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(starts), "_range").withColumn("rank", F.when(rank <= take, rank)).drop("_range", "_place", "_start")


def resample(spark: SparkSession, documents: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document."""
    with scratch(spark):
        noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / float(1 << 32))))
        scored = weights(documents, gains(documents, target, n, buckets), n).withColumn("score", F.col("weight") + gumbel)
        scored = materialize(spark, scored, "resample-scores")
        enough = F.col("n_words") >= least_words
        eligible = scored.where(enough)
        drawn = ranked(spark, eligible, eligible.count() * percent // 100)
        return materialize(spark, drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))), "resampled", keep=True)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return resample(spark, read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_resample": op11_resample}
#: CRC-32 of each different word: eight shifts for a table of 256 remainders, then one step a byte.
ORACLE_SQL = {
    "op11_resample": r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(r ORDER BY i) AS steps FROM bits),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
used AS (SELECT doc_id, unnest(w) AS word FROM doc),
counted AS (SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT word, count(*) AS s, 0 AS t FROM used GROUP BY 1 UNION ALL SELECT word, 0, count(*) FROM bench GROUP BY 1) GROUP BY 1),
hexed AS (SELECT *, hex(encode(word)) AS x FROM counted),
hashed AS (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda k: ('0x' || x[2 * k + 1 : 2 * k + 2])::BIGINT)), lambda c, b: xor(c >> 8, tab.steps[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab),
totals AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM totals),
summed AS (SELECT doc_id, sum(g)::BIGINT AS g FROM used JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
weighed AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(floor(summed.g::DOUBLE / len(w))::BIGINT, 0) AS weight FROM doc LEFT JOIN summed USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM placed
""",
}
