"""Text quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on a bounded sample of labelled documents, one on good texts and one on bad. Every whole text
is compressed with each, in blocks of ``BLOCK`` bytes that start from the dictionary alone (a long text otherwise soon
compresses by itself, whatever the dictionary). The difference of the two sizes over their sum is the raw score; how far
the text compresses at all tells repetition, which both dictionaries miss. A logistic fit on these two and their squares,
on documents left out of the dictionaries' training, turns them into a probability.

Scoring is a map over partitions without a shuffle; the model, fitted in one task on an executor from a sample whose rows and
bytes are bounded by parameters, is a closure of fixed size. Null and empty texts have no
difference and get the calibrated score of zero. Repeated rows score alike. Without labels of both kinds the score is the
base rate of what there is (0.5 without any). Other columns are ignored and kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import columnar as C
from skytally.llm.labelled import fitted, held_out, logistic, sample, share, sigmoid
from skytally.session import ship_package

#: Labelled documents of each class that the model learns from at most, and bytes of each class in dictionary training.
SAMPLE_PER_CLASS, TRAIN_BYTES = 2000, 3 << 20
DICTIONARY, BLOCK, LEVEL = 110 << 10, 1024, 3
MODULUS, REMAINDER = 3, 1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    calibration: np.ndarray  # of the features, constant
    middle: np.ndarray
    scale: np.ndarray


class Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compress = []
        for content in (good, bad):
            data = zstandard.ZstdCompressionDict(content)
            data.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def measure(self, text: str | None) -> tuple[float, float]:
        """The normalised size difference (positive: the good dictionary fits better), and the log of the mean ratio."""
        raw = (text or "").encode()
        if not raw:
            return 0.0, 0.0
        good, bad = (sum(len(compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for compress in self.compress)
        return (bad - good) / (bad + good), float(np.log((good + bad) / (2 * len(raw) + 40)))


def features(model_middle: np.ndarray, model_scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model_middle) / model_scale, -6, 6)
    return np.column_stack([z, z[:, :1] ** 2, z[:, 1:] ** 2, z[:, :1] * z[:, 1:]])


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary from blocks of these texts; raw content where there is too little.

    Every text has an equal share of TRAIN_BYTES, and what short ones leave goes to the others; a longer one gives blocks
    spread evenly over it.
    """
    raws = [t.encode() for t in texts]
    cap, blocks = share(np.array([len(r) for r in raws], np.int64), TRAIN_BYTES), []
    for raw in raws:
        if len(raw) <= cap:
            blocks += [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        else:
            width = min(BLOCK, cap)
            blocks += [raw[i : i + width] for i in np.linspace(0, len(raw) - width, cap // width).astype(int).tolist()]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:] or b"\n" * 8


def train(texts: list[str], label: np.ndarray) -> Model:
    """Fits dictionaries on half of the different texts and the calibration on the other half. label: 1 is good."""
    once = {t: i for i, t in reversed(list(enumerate(texts)))}
    first = np.array(sorted(once.values()), np.int64)
    texts, label = [texts[i] for i in first], label[first]
    half = np.arange(len(texts)) % 2 == 0
    good, bad = (_dictionary([texts[i] for i in np.flatnonzero(half & (label == v))]) for v in (1, 0))
    sizes, rest = Sizes(good, bad), ~half if (~half).any() else half
    x = np.array([sizes.measure(texts[i]) for i in np.flatnonzero(rest)]).reshape(-1, 2)
    middle, scale = (np.median(x, axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(2), np.ones(2))
    return Model(good, bad, logistic(features(middle, scale, x), label[rest]), middle, scale)


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model, from at most ``per_class`` labelled documents of each class that are not held out."""
    ship_package(spark)
    return fitted(sample(documents, labels, "quality", MODULUS, REMAINDER, per_class), train)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns, with score (0 to 1) and predicted appended; columns of those names become _in_score, _in_predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            x = np.array([sizes.measure(t.as_py()) for t in batch.column("text")]).reshape(-1, 2)
            value = sigmoid(features(model.middle, model.scale, x) @ model.calibration[:-1] + model.calibration[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "score"])

    documents = C.renamed(documents, "score", "predicted")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), "score double"])
    return documents.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(documents.select("doc_id", "text"), fit(spark, documents, labels))
    return scored.select("doc_id", held_out(MODULUS, REMAINDER).alias("held_out"), "score", "predicted")


QUERIES = {"op2_quality": op2_quality}

ORACLE_SQL: dict[str, str] = {}
