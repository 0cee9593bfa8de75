"""Equi-joins whose larger side may hold hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No part of a key is larger than one in HOT of all rows, and so there are at most HOT keys that need parts.
HOT = 1000


def counted_join(rows: DataFrame, counted: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Inner (or left) join on ``keys``. ``counted`` is a written table with one row per key and ``n``, how many of the rows have it.

    Keys of more than a HOT-th of the rows are dealt into parts of that size at most by a hash of the ``spread`` columns;
    their rows of ``counted`` are repeated for each part. Only these keys are broadcast: by their counts they are at most HOT.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0  # one number
    parts = F.ceil(F.col("n") * HOT / F.lit(max(1, total))).cast("int")
    split = F.broadcast(counted.select(*(F.col(k).alias(f"_hot_{k}") for k in keys), parts.alias("_parts")).where("_parts > 1"))
    dealt = rows.join(split, [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    dealt = dealt.select(*rows.columns, F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int").alias("_part"))
    every = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(every.drop("n"), [*keys, "_part"], how).drop("_part")
