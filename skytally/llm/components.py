"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.session import materialize, scratch


def stars(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """For an edge table (a, b): a row (a, b) for every vertex a but the smallest of each component, b being that one.

    Each round hangs every vertex onto the smallest one in reach; the number of rounds grows with the logarithm of the
    component sizes. Minima are pre-aggregated before the shuffle, so that the hub of a large star is no hot key there.
    Every round is written to the shared folder, so lineage stays short.
    """
    with scratch(spark):
        return materialize(spark, _rounds(spark, edges), "stars", keep=True)


def _rounds(spark: SparkSession, edges: DataFrame) -> DataFrame:
    edges = materialize(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not state[0] or state == before:
            return edges
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        large = both.join(smallest, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(spark, large, "large-star")
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        joined = large.join(smallest, F.col("a") == F.col("_a")).select("b", "m")
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select(F.col("_a").alias("a"), F.col("m").alias("b"))).distinct()
        edges = materialize(spark, small, "small-star")
