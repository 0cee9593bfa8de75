"""Bounded samples of labelled documents, and a small logistic calibration, for the operators that learn."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a sampled document that a model learns from at most, and the windows that a longer one gives.
DOC_BYTES, SLICES = 16 << 10, 8


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, doc_bytes: int = DOC_BYTES) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``per_class`` learnable documents of each label, picked by a hash of their ids.

    Ids with a null or contradictory label don't count. An id gives one row, however often it occurs: its smallest text. A
    text of more than ``doc_bytes`` bytes gives evenly spread windows of about so many in all. The sample has therefore at
    most 2 * per_class rows and 2 * per_class * (doc_bytes + 8) bytes of text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
    known = known.where((F.col("label") == F.col("other")) & ~held_out(modulus, remainder)).select(F.col("doc_id").alias("_id"), "label")
    order = F.xxhash64("_id")
    picked = None
    for value in (0, 1):
        one = known.where(F.col("label") == value).orderBy(order, "_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # Broadcast: 2 * per_class ids, a bound that is a parameter.
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    text, width = F.coalesce("text", F.lit("")), max(1, doc_bytes // (4 * SLICES))  # a character has four bytes at most
    step = (F.length(text) - width) / (SLICES - 1)
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(width)))
    rows = rows.select("doc_id", F.when(F.octet_length(text) <= doc_bytes, text).otherwise(F.array_join(slices, "\n")).alias("text"), "label")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fitted(rows: DataFrame, train: Callable[[list[str], np.ndarray], Any]) -> Any:
    """What ``train`` makes of the texts and labels of a sample (in the order of its ids), in one task on an executor.

    The sample's size is bounded by its parameters, whatever the corpus; only the model comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True)]
        got.sort(key=lambda r: r[0])
        model = train([r[1] for r in got], np.array([r[2] for r in got], float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    models = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else train([], np.zeros(0))


def share(sizes: np.ndarray, budget: int) -> int:
    """The largest bound on each size at which they sum to the budget at most, and 1 at least."""
    left, rest = budget, np.sort(np.asarray(sizes, np.int64))
    for i, size in enumerate(rest.tolist()):
        if size * (len(rest) - i) > left:
            return max(1, left // (len(rest) - i))
        left -= size
    return max(1, int(rest[-1])) if len(rest) else 1


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (the last for a constant) of a ridge logistic regression by Newton steps; without both classes, a constant."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    if len(y):
        # Platt's targets: no certainty beyond what the counts support.
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        penalty = np.eye(len(w)) * ridge
        penalty[-1, -1] = 1e-6
        for _ in range(steps):
            p = sigmoid(x @ w)
            grad = x.T @ (p - t) + penalty @ w
            hess = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
