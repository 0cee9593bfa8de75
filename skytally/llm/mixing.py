"""Mixing sources to target weights by Sainte-Laguë apportionment, all in DataFrame operations.

1. Sizes are word counts. Sources in code point order (null last) weigh 5, 2, 1, repeating; their targets share 150 % of all
   sizes by weight and stop at twice the source's size, the excess going to the others by weight (water filling: the level
   is found from running sums over the sources, sorted by the level at which each is full).
2. Documents fall into shards by a hash of their ids and texts; the number of shards grows with the corpus. The words of a
   source within a shard, documents in the order of a seeded hash, are a stream that is cut into blocks of nearly equal
   length (about ``BLOCK`` words).
3. Blocks go to sources by Sainte-Laguë: a source has its target, in blocks, as votes, all blocks that the targets are worth
   are the seats, and the highest quotients v/1, v/3, v/5, ... win them, up to twice a source's blocks. A source's blocks go
   to its shards in the same way (v: blocks of the shard), so every shard has an integer quota. A divisor that undershoots
   gives nearly all seats at once, so that only about as many quotients as there are parties are ranked.
4. A shard's stream is taken whole as often as its quota allows; the rest of the quota goes to blocks picked by a seeded
   permutation of the block numbers. A document's words in picked blocks are what the mix takes of it.

Windows are partitioned by source and shard, or hold one row per shard or per source; no group holds a source's documents.
The windows over all sources (targets, seats) are one task of a row per source, good for many thousands of sources.
Null text is empty; a null source is a source; rows that repeat an id are separate documents in the order of their texts'
hashes and sizes, and so are rows without an id.
Empty tables give no rows, sources without words a target of zero. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytally.session import materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Words of a block; words of a shard, and shards at least.
BLOCK, SHARD_WORDS, LEAST_SHARDS = 32, 16_000_000, 64
SEED = "mix-1"
#: A prime above any number of blocks in a shard, and so coprime to it: multiplying by it permutes block numbers.
PRIME = 2147483647


def text_size(text: str = "text") -> Column:
    """Words: runs of anything but white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """A seeded number below 2^32 from the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    # At a level L a source gets min(MOST * size, L * weight); it is full from L = MOST * size / weight on.
    weighed = weighed.withColumn("full_at", MOST * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    summed = weighed.withColumn("total", SHARE * F.sum("source_size").over(everything)).withColumn("full", F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0.0)))
    summed = summed.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level, if exactly the sources before this one are full; the first that then stays open gives it.
    summed = summed.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    summed = summed.withColumn("place", F.row_number().over(Window.orderBy("full_at", F.col("source").asc_nulls_last())))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)["level"]
    return summed.withColumn("level", level).select("source", "source_size", F.least(MOST * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, key: list[str]) -> DataFrame:
    """Sainte-Laguë within each group: adds quota, with the group's quotas summing to its seats. Parties without votes get none.

    parties: one row per party with its votes and its group's seats; key orders equal quotients. With n parties and V votes,
    the divisor V / (seats - n/2) gives at most the seats, and every seat it gives belongs to one of the highest quotients;
    at most n seats remain for the next quotients, of which party v needs v * n / V + 2 at most.
    """
    all_of = Window.partitionBy(*group)
    p = parties.withColumn("_v", F.sum(votes).over(all_of)).withColumn("_n", F.sum((F.col(votes) > 0).cast("long")).over(all_of))
    surely = F.when((F.col(seats) * 2 > F.col("_n")) & (F.col("_v") > 0), F.floor(F.col(votes) * (F.col(seats) - F.col("_n") / 2) / F.col("_v") + 0.5 - 1e-9)).otherwise(F.lit(0))
    p = p.withColumn("_sure", F.greatest(surely, F.lit(0)).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(all_of))
    more = F.when((F.col("_left") > 0) & (F.col(votes) > 0), F.sequence(F.lit(0).cast("long"), F.least(F.col("_left"), F.ceil(F.col(votes) * F.col("_n") / F.col("_v")).cast("long") + 2)))
    q = p.withColumn("_k", F.explode_outer(more)).withColumn("_quotient", F.col(votes) / (2 * (F.col("_sure") + F.col("_k")) + 1))
    rank = Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), *key, "_k")
    won = F.coalesce((F.row_number().over(rank) <= F.col("_left")) & F.col("_k").isNotNull(), F.lit(False))
    q = q.withColumn("_won", won)
    return q.groupBy(*parties.columns).agg((F.first("_sure") + F.sum(F.col("_won").cast("long"))).alias("quota"))


def mix(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: see the module's docstring."""
    sizes = documents.select("doc_id", "source", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("salt"))
    sizes = materialize(spark, sizes, "mix-sizes")
    aims = targets(sizes)
    words = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()["words"]  # one number
    shards = max(LEAST_SHARDS, -(-words // SHARD_WORDS))
    name = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("salt").cast("string")]
    docs = sizes.withColumn("shard", _hash(F.lit("shard"), *name) % shards)
    order = Window.partitionBy("source", "shard").orderBy(_hash(F.lit("order"), *name), "doc_id", "salt", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("end", F.sum("size").over(order))
    streams = docs.groupBy("source", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / BLOCK))).otherwise(0).cast("long"))
    streams = materialize(spark, streams, "mix-streams")
    # What a source is due, in its own blocks: the votes. Seats: all blocks that are due.
    due = streams.groupBy("source").agg(F.sum("blocks").alias("all_blocks")).join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    due = due.withColumn("votes", F.coalesce(F.col("target") * F.col("all_blocks") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    due = due.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy())).cast("long"))
    seats = apportion(due, [], "votes", "seats", ["source"])
    seats = seats.select(F.col("source").alias("_source"), "source_size", "target", F.least("quota", 2 * F.col("all_blocks")).alias("seats"))
    parties = streams.join(seats, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    quotas = apportion(parties, ["source"], "blocks", "seats", ["shard"]).withColumn("quota", F.least("quota", 2 * F.col("blocks")))
    quotas = quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "words", "blocks", "quota")
    placed = docs.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    # Block b holds the words from b * words div blocks on; word w is in block ((w + 1) * blocks - 1) div words.
    start, per = F.col("end") - F.col("size"), F.nullif(F.col("blocks"), F.lit(0))
    first = F.floor(((start + 1) * F.col("blocks") - 1) / F.nullif("words", F.lit(0)))
    last = F.floor((F.col("end") * F.col("blocks") - 1) / F.nullif("words", F.lit(0)))
    offset = _hash(F.lit("blocks"), F.coalesce("source", F.lit("\x00")), F.col("shard").cast("string"))
    placed = placed.withColumns({"_start": start, "_first": first, "_last": last, "_turn": offset, "_rest": F.col("quota") % per})
    edge = lambda b: F.floor(b * F.col("words") / F.col("blocks"))
    overlap = lambda b: F.least("end", edge(b + 1)) - F.greatest("_start", edge(b))
    picked = lambda b: (b * PRIME + F.col("_turn")) % F.col("blocks") < F.col("_rest")
    extra = F.aggregate(F.sequence("_first", "_last"), F.lit(0).cast("long"), lambda a, b: a + F.when(picked(b), overlap(b)).otherwise(0))
    taken = F.when(F.col("size") > 0, F.floor(F.col("quota") / per) * F.col("size") + extra).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL: dict[str, str] = {}
