"""Periodic runs of words, by matching aligned blocks within each document.

A run is a stretch with smallest period q, at least ``copies`` times as long (and ``least`` words at least), that no
neighbouring word extends. For each power of two B, runs of periods B to 2B - 1 contain an aligned block of B words that
occurs again one period later, at a distance of that scale:

1. Aligned blocks of B words become the keys of an automaton over integer sequences (words numbered within the document). A
   block in a run of this scale has each of its words again within less than 2B words; other blocks are left out, and so are
   the stretches that no remaining block can match.
2. The automaton runs over those stretches. Of each occurrence only one aligned block lies B to 2B - 1 words before it; if it
   is the same block, the distance is a candidate period, and the pair is the seed of an exact comparison word by word to both
   sides. A stretch is compared once for each period.
3. Long enough stretches whose period is the smallest are runs: none of its quotients by a prime divisor may be a period.
   Seeds within a run found at a smaller scale are skipped, and blocks all of whose seeds would be: two periods that fit into
   such a stretch together have a common divisor as period, so it belongs to that run.

A document is looked at by itself, in one task, without a shuffle; a batch's texts pass in pieces of some megabytes. Work is
proportional to n log n for n words. With 4 copies, B <= q makes an aligned block and its successor fit into every run; fewer
copies than 3 would not.

A null or word-free text has no runs and collapses to an empty one. Rows are independent: repeated ones give equal results.
An empty table gives no rows. Columns named like results get _in_ before their names, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytally.llm import columnar as C
from skytally.session import ship_package

COPIES, LEAST = 4, 6
RUNS = "array<struct<start:long,length:long,period:long>>"
WORD = r"[^\x20\x09-\x0D]+"


def _equal_ahead(x: np.ndarray, i: int, d: int) -> int:
    """The first place from i on where the word d later differs, or where there is none."""
    end, step = len(x) - d, 64
    while i < end:
        same = x[i : min(i + step, end)] == x[i + d : min(i + step, end) + d]
        stop = int(same.argmin())
        if not same[stop]:
            return i + stop
        i, step = i + len(same), step * 2
    return end


def _equal_back(x: np.ndarray, i: int, d: int) -> int:
    """The first place of the stretch before i in which the word d later is equal."""
    step = 64
    while i > 0:
        low = max(0, i - step)
        same = (x[low:i] == x[low + d : i + d])[::-1]
        stop = int(same.argmin())
        if not same[stop]:
            return i - stop
        i, step = low, step * 2
    return 0


def _prime_divisors(q: int) -> Iterator[int]:
    f = 2
    while f * f <= q:
        if q % f == 0:
            yield f
            while q % f == 0:
                q //= f
        f += 1
    if q > 1:
        yield q


def _next_same(x: np.ndarray) -> np.ndarray:
    """How far ahead the same word comes next (beyond any distance, if it does not)."""
    order = np.argsort(x, kind="stable")
    ahead = np.full(len(x), len(x) * 4, np.int64)
    again = x[order[1:]] == x[order[:-1]]
    ahead[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return ahead


def _seeds(x: np.ndarray, ahead: np.ndarray, until: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(aligned block, distance) of each occurrence of a block of ``size`` words at a distance of its scale, by block.

    ``until``: how far a known run goes on from each place; blocks whose seeds would all lie in it are left out.
    """
    near = ahead[: len(x) // size * size].reshape(-1, size).max(axis=1) < 2 * size
    at = np.flatnonzero(near) * size
    at = at[until[at] < np.minimum(at + 3 * size - 1, len(x))]
    if not len(at):
        return
    # Blocks whose searched stretches touch are searched together.
    cuts = np.flatnonzero(np.diff(at) > 2 * size) + 1
    words, block_of = tuple(x.tolist()), {}
    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for a in at.tolist():
        key = words[a : a + size]
        keys.add_word(key, block_of.setdefault(key, len(block_of)))
    keys.make_automaton()
    number = {a: block_of[words[a : a + size]] for a in at.tolist()}
    for group in np.split(at, cuts):
        low = int(group[0]) + size
        for last, block in keys.iter(words[low : int(group[-1]) + 3 * size - 1]):
            j = low + last - size + 1
            a = (j - size) // size * size
            if number.get(a) == block:
                yield a, j - a


def find_runs(x: np.ndarray, copies: int = COPIES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the sequence, by start, then period."""
    n, size, runs = len(x), 1, []
    ahead = _next_same(x)
    until = np.zeros(n, np.int64)
    while size * copies <= n and size * 2 <= n:
        found, compared = [], {}
        for a, d in _seeds(x, ahead, until, size):
            if a < compared.get(d, 0) or until[a] >= a + size + d:
                continue
            start, stop = _equal_back(x, a, d), _equal_ahead(x, a + size, d)
            compared[d] = stop
            if stop + d - start >= max(least, copies * d):
                one = x[start : start + d]
                if not any((one[: d - d // f] == one[d // f :]).all() for f in _prime_divisors(d)):
                    found.append((start, stop + d - start, d))
        for start, length, _ in found:
            until[start : start + length] = np.maximum(until[start : start + length], start + length)
        runs += found
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def periodic_runs(df: DataFrame, text: str = "text", copies: int = COPIES, least: int = LEAST) -> DataFrame:
    """Adds runs (array of start, length, period, in words) and collapsed: the words joined by one space, without those that a
    run repeats after its first period. The text column itself is kept."""
    if copies < 3:
        raise ValueError("copies: 3 at least")
    kept = C.renamed(df, "runs", "collapsed")
    name = kept.columns[df.columns.index(text)]
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, name):
                runs, texts = [], []
                for t in part.column(name).to_pylist():
                    words = (t or "").encode().split()
                    ids: dict[bytes, int] = {}
                    found = find_runs(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64), copies, least)
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                    if found:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for s, m, q in found:
                            edge[s + q] += 1
                            edge[s + m] -= 1
                        words = [w for w, dropped in zip(words, np.cumsum(edge).tolist(), strict=False) if not dropped]
                    texts.append(b" ".join(words).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(runs, kind), pa.array(texts, pa.string())], [*part.schema.names, "runs", "collapsed"])

    ship_package(df.sparkSession)
    return kept.mapInArrow(find, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The text with the repetition that the query's contract puts into every document whose id's CRC-32 is divisible by ten."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (place(i) + 1).cast("int"))))

    some = F.coalesce((h % 10 == 0) & F.regexp_like(text, F.lit(WORD)), F.lit(False))
    return F.when(some, F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), repeat), 1)).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))).drop("text")
    # By start, then period: a later run wins only with a greater length / period.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic": op12_periodic}
ORACLE_SQL: dict[str, str] = {}
