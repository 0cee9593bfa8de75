"""Toxic spans by a linear-chain conditional random field, and a document score from its marginals.

Labels mark documents, so the labelled tokens are derived first: in a bounded sample of labelled documents, a word or word
prefix that occurs in toxic documents far more often than chance allows (likelihood ratio against all others, corrected
for the number of features tested, copies counted once) marks its tokens in toxic documents; every token of a clean document is clean. The CRF
(states clean/toxic; hashed word and prefix features, transitions) is trained on these by gradient steps over exact
forward-backward expectations. Scoring runs forward-backward over every token of every text: tokens whose toxic marginal
is 0.5 or more form spans (code point offsets), and the sum and maximum of the marginals, calibrated on the sample, form
the score. Scoring is a map over partitions without a shuffle. The model is fitted in one task on an executor, from a sample
whose rows and bytes are bounded by parameters, and goes to the tasks as the weights of the features in use.

Null and empty texts score like a text without toxic tokens. Repeated rows are scored alike, each on its own. Without
labels of both kinds the score is the base rate of what there is (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import columnar as C
from skytally.llm.labelled import fitted, held_out, logistic, sample, share, sigmoid
from skytally.session import lean_workers, ship_package

#: Labelled documents of each class that the model learns from at most, and the tokens that the CRF is trained on at most.
SAMPLE_PER_CLASS, TRAIN_TOKENS = 1500, 300_000
#: Tokens of a window of a text that is longer than its share of TRAIN_TOKENS.
WINDOW = 50
#: Hash buckets of the features; lengths in bytes of the prefixes.
BITS, PREFIXES = 22, (4, 5, 6)
BUCKETS = 1 << BITS
#: A prefix is a feature from so many words on.
MIN_WORDS = 3
MODULUS, REMAINDER = 5, 0


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # buckets with a weight, ascending
    weights: np.ndarray  # of each of them, toxic against clean
    bias: float  # of the toxic state at any token
    start: np.ndarray  # log potentials of a document's first state
    trans: np.ndarray  # log potentials [from, to]
    calibration: np.ndarray  # of log(1 + sum of marginals), maximum, constant


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row, and features (tokens x feature kinds, hashed; -1 where a word is too short for a prefix)."""
    low = C.LOWER[data]
    start, end, per_row = C.words(low, at, C.ALNUM)
    sums, row = C.prefix_sums(low), np.repeat(np.arange(len(per_row)), per_row)
    kinds = [C.ranges_hash(sums, start, end)]
    for n in PREFIXES:
        kinds.append(np.where(end - start > n, C.ranges_hash(sums, start, np.minimum(start + n, end)) + np.uint64(n), np.uint64(0)))
    features = np.empty((len(start), len(kinds)), np.int32)
    for i, h in enumerate(kinds):
        features[:, i] = (C.mix(h + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int32)
        if i:
            features[end - start <= PREFIXES[i - 1], i] = -1
    return start, end, row, features


def _unary(weights: np.ndarray, bias: float, features: np.ndarray) -> np.ndarray:
    """weights has one entry more than there are features, zero, which index -1 (no feature) reads."""
    return weights[features].sum(axis=1) + bias


def _products(m: np.ndarray) -> np.ndarray:
    """m: (steps, 4, chunks), a 2x2 matrix per step and chunk. Running products along the steps, each scaled to sum 1."""
    out = np.empty_like(m)
    out[0] = m[0] / m[0].sum(axis=0)
    for t in range(1, len(m)):
        a, b, c, d = out[t - 1]
        e, f, g, h = m[t]
        o = out[t]
        o[0], o[1], o[2], o[3] = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        o /= o.sum(axis=0)
    return out


def forward_backward(unary: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta (2 x tokens) and the step matrices (4 x tokens) of all documents at once.

    The documents are one chain: at a document's first token the step matrix has equal rows, which forgets what came
    before. The chain is cut into about sqrt(tokens) chunks; products within chunks run side by side, and only one small
    vector per chunk is carried from chunk to chunk.
    """
    n = len(unary)
    size = max(1, int(np.sqrt(n)))
    chunks = -(-n // size)
    e1 = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
    e = np.stack([1 - e1, e1])
    t, s = np.exp(trans), np.exp(start)
    m = np.empty((4, chunks * size))
    for i in (0, 1):
        for j in (0, 1):
            m[2 * i + j, :n] = np.where(first, s[j], t[i, j]) * e[j]
    m[:, n:] = 0.5
    steps = np.ascontiguousarray(m.reshape(4, chunks, size).transpose(2, 0, 1))
    forward = _products(steps)
    carry, alphas = (0.5, 0.5), np.empty((2, chunks))
    for k, (a, b, c, d) in enumerate(forward[-1].T.tolist()):
        alphas[:, k] = carry
        x, y = carry[0] * a + carry[1] * c, carry[0] * b + carry[1] * d
        carry = (x / (x + y), y / (x + y))
    alpha = np.stack([alphas[0] * forward[:, 0] + alphas[1] * forward[:, 2], alphas[0] * forward[:, 1] + alphas[1] * forward[:, 3]])
    alpha = alpha.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    # Backward: beta[t] = M[t+1] beta[t+1]; products of transposed matrices in reverse order are the same recursion.
    backward = _products(np.ascontiguousarray(steps[::-1][:, [0, 2, 1, 3]]))
    carry, betas = (1.0, 1.0), np.empty((2, chunks))
    for k, (a, b, c, d) in list(enumerate(backward[-1].T.tolist()))[::-1]:
        betas[:, k] = carry
        x, y = carry[0] * a + carry[1] * c, carry[0] * b + carry[1] * d
        carry = (x / (x + y), y / (x + y))
    at = np.stack([betas[0] * backward[:, 0] + betas[1] * backward[:, 2], betas[0] * backward[:, 1] + betas[1] * backward[:, 3]])
    at = at[:, ::-1].transpose(0, 2, 1).reshape(2, -1)[:, :n]  # M[t] beta[t]: what token t-1 sees
    beta = np.ones((2, n))
    beta[:, :-1] = at[:, 1:]
    last = np.append(first[1:], True) if n else np.zeros(0, bool)
    beta[:, last] = 1.0
    return alpha / alpha.sum(axis=0), beta, m[:, :n]


def marginals(unary: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The probability of the toxic state at each token."""
    if not len(unary):
        return np.zeros(0)
    alpha, beta, _ = forward_backward(unary, first, start, trans)
    p = alpha * beta
    return p[1] / p.sum(axis=0)


def _first(row: np.ndarray) -> np.ndarray:
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    return first


def marked_features(features: np.ndarray, n: int, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each of n features is bound to toxic documents: by a likelihood ratio on counts of its contexts.

    A feature counts once for each word that it follows, on either side, so that copies of one document weigh as one.
    """
    before = np.where(_first(row), -1, np.roll(features[:, 0], 1)).astype(np.uint64)
    counts = []
    for side in (toxic[row], ~toxic[row]):
        seen = np.zeros(n)
        for i in range(features.shape[1]):
            pick = side & (features[:, i] >= 0)
            f = features[pick, i]
            _, once = np.unique(C.mix(f.astype(np.uint64) + before[pick] * np.uint64(C.WORD_BASE)), return_index=True)
            seen += np.bincount(f[once], minlength=n)
        counts.append(seen)
    a, b = counts
    n1, n0 = max(a.sum(), 1), max(b.sum(), 1)
    share = (a + b) / (n1 + n0)
    ratio = 2 * (a * np.log(np.maximum(a / n1, 1e-12) / np.maximum(share, 1e-12)) + b * np.log(np.maximum(b / n0, 1e-12) / np.maximum(share, 1e-12)))
    tested = max(2, int(((a + b) > 0).sum()))
    bound = 2 * np.log(tested / 0.01)  # a chi-squared tail of about 0.01 over all features together
    return (ratio > bound) & (a / n1 > 8 * (b + 0.5) / n0)


def training_tokens(row: np.ndarray, marked: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens the CRF is trained on, and which of them open a sequence.

    Every document has an equal share of TRAIN_TOKENS, and what short ones leave goes to the others. A longer one gives
    windows of WINDOW tokens, half of them those with marked tokens if it has so many, the rest by a hash.
    """
    sizes = np.bincount(row, minlength=rows)
    cap = share(sizes, TRAIN_TOKENS)
    width = min(WINDOW, cap)
    begins = np.cumsum(sizes) - sizes
    pick, opens = (sizes <= cap)[row], _first(row)
    for r in np.flatnonzero(sizes > cap):
        a, windows = int(begins[r]), int(sizes[r]) // width
        spread = np.argsort(C.mix(np.arange(windows, dtype=np.uint64)), kind="stable")
        hot = np.unique(np.flatnonzero(marked[a : a + windows * width]) // width)
        take = cap // width
        some = spread[np.isin(spread, hot)][: (take + 1) // 2]
        chosen = np.concatenate([some, spread[~np.isin(spread, some)]])[:take]
        for w in chosen.tolist():
            pick[a + w * width : a + (w + 1) * width] = True
            opens[a + w * width] |= w - 1 not in chosen
    return pick, opens


def train(texts: list[str], labels: np.ndarray, steps: int = 50) -> Model:
    """Fits the model to documents and their labels (1: toxic)."""
    rows, kinds, done = [np.zeros(0, np.int64)], [np.zeros((0, 1 + len(PREFIXES)), np.int32)], 0
    for part in C.pieces(pa.RecordBatch.from_pydict({"text": pa.array([t or "" for t in texts], pa.string())}), "text", C.SMALL):
        _, _, row, features = tokens(*C.flat(part.column("text")))
        rows.append(row + done)
        kinds.append(features)
        done += part.num_rows
    row, features = np.concatenate(rows), np.concatenate(kinds)
    del rows, kinds
    toxic = labels.astype(bool)
    # Features by their place among those of the sample; no array is as large as all buckets.
    buckets, compact = np.unique(features, return_inverse=True)
    none = int(len(buckets) > 0 and buckets[0] == -1)
    buckets, features = buckets[none:], (compact.reshape(features.shape) - none).astype(np.int32)
    weights, bias, start, trans = np.zeros(len(buckets) + 1, np.float32), 0.0, np.zeros(2), np.zeros((2, 2))
    if len(row) and toxic.any() and not toxic.all():
        known = features.copy()
        # A prefix tells more than its words only where several share it, none with most of its occurrences.
        for i in range(1, known.shape[1]):
            pairs, n = np.unique((known[:, i].astype(np.int64) << BITS | known[:, 0])[known[:, i] >= 0], return_counts=True)
            prefix, begins = np.unique(pairs >> BITS, return_index=True)
            most, total, words = np.maximum.reduceat(n, begins), np.add.reduceat(n, begins), np.diff(np.append(begins, len(n)))
            shared = np.zeros(len(buckets) + 1, bool)
            shared[prefix[(words >= MIN_WORDS) & (2 * most <= total)]] = True
            known[~shared[known[:, i]], i] = -1
        hot = np.append(marked_features(known, len(buckets), row, toxic), False)
        y_all = hot[known].any(axis=1) & toxic[row]
        pick, opens_window = training_tokens(row, y_all, len(toxic))
        f, y, first = known[pick], y_all[pick], opens_window[pick]
        n = max(1, len(y))
        valid = f >= 0
        used, flat_f = np.unique(f[valid], return_inverse=True)
        owner, compact = np.nonzero(valid)[0], np.full(f.shape, -1)
        compact[valid] = flat_f
        w, bias = np.zeros(len(used) + 1), -2.0
        last_y = np.roll(y, 1)
        cells = np.array([(~last_y & ~y & ~first).sum(), (~last_y & y & ~first).sum(), (last_y & ~y & ~first).sum(), (last_y & y & ~first).sum()], float)
        opens = np.array([(first & ~y).sum(), (first & y).sum()], float)
        g2w, g2b, g2t, g2s = np.full(len(used), 1e-8), 1e-8, np.full(4, 1e-8), np.full(2, 1e-8)
        for _ in range(steps):
            alpha, beta, m = forward_backward(_unary(w, bias, compact), first, start, trans)
            p = alpha * beta
            p = p[1] / p.sum(axis=0)
            g = np.bincount(flat_f, weights=(p - y)[owner], minlength=len(used)) + 1e-3 * w[:-1]
            gb = (p - y).mean()
            before = np.empty_like(alpha)
            before[:, 1:], before[:, 0] = alpha[:, :-1], 0.5
            pair = np.stack([before[0] * m[0] * beta[0], before[0] * m[1] * beta[1], before[1] * m[2] * beta[0], before[1] * m[3] * beta[1]])
            pair = (pair / pair.sum(axis=0))[:, ~first].sum(axis=1) if (~first).any() else np.zeros(4)
            gt = (pair - cells) / n + 1e-4 * trans.ravel()
            gs = (np.array([(1 - p[first]).sum(), p[first].sum()]) - opens) / n
            g2w += g * g
            g2b += gb * gb
            g2t += gt * gt
            g2s += gs * gs
            w[:-1] -= g / np.sqrt(g2w)
            bias -= 0.5 * gb / np.sqrt(g2b)
            trans -= 0.3 * (gt / np.sqrt(g2t)).reshape(2, 2)
            start -= 0.3 * gs / np.sqrt(g2s)
        weights[used] = w[:-1]
    total, top = np.zeros(len(texts)), np.zeros(len(texts))
    for lo in range(0, len(texts), 100):  # a few at a time, for memory
        a, b = np.searchsorted(row, [lo, lo + 100])
        n = min(100, len(texts) - lo)
        total[lo : lo + n], top[lo : lo + n], _ = document_values(_unary(weights, bias, features[a:b]), start, trans, row[a:b] - lo, n)
    used = np.flatnonzero(weights[:-1])
    return Model(buckets[used], weights[used], bias, start, trans, logistic(np.column_stack([np.log1p(total), top]), labels.astype(float)))


def unaries(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    """The unary potentials of tokens by their features."""
    places, weights = np.full(BUCKETS + 1, len(model.features), np.int32), np.append(model.weights, 0)
    places[model.features] = np.arange(len(model.features))
    return lambda features: _unary(weights, model.bias, places[features])


def document_values(unary: np.ndarray, start: np.ndarray, trans: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and maximum of the marginals of each row, and the marginals."""
    p = marginals(unary, _first(row), start, trans)
    top = np.zeros(rows)
    if len(row):
        begins = np.flatnonzero(_first(row))
        top[row[begins]] = np.maximum.reduceat(p, begins)
    return np.bincount(row, weights=p, minlength=rows), top, p


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model, from at most ``per_class`` labelled documents of each class that are not held out."""
    ship_package(spark)
    lean_workers(spark)
    return fitted(sample(documents, labels, "toxic", MODULUS, REMAINDER, per_class), train)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns, with score (0 to 1), spans (array of start and end, in code points) and predicted appended; columns of
    those names become _in_score, _in_spans, _in_predicted.
    """
    documents = C.renamed(documents, "score", "spans", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unary = unaries(model)
        for batch in batches:
            for part in C.pieces(batch, "text", C.SMALL):
                data, at = C.flat(part.column("text"))
                start, end, row, features = tokens(data, at)
                total, top, p = document_values(unary(features), model.start, model.trans, row, part.num_rows)
                value = sigmoid(np.column_stack([np.log1p(total), top, np.ones(part.num_rows)]) @ model.calibration)
                bad = p >= 0.5
                opens = np.flatnonzero(bad & (_first(row) | ~np.append(False, bad[:-1]))) if len(bad) else np.zeros(0, int)
                closes = np.flatnonzero(bad & (np.append(_first(row)[1:], True) | ~np.append(bad[1:], False))) if len(bad) else np.zeros(0, int)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                base = points[at[row[opens]]]
                spans = pa.StructArray.from_arrays([pa.array((points[start[opens]] - base).astype(np.int32)), pa.array((points[end[closes]] - base).astype(np.int32))], ["start", "end"])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row[opens], minlength=part.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.ListArray.from_arrays(pa.array(offsets), spans)], [*part.schema.names, "score", "spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), "score double", "spans array<struct<start:int,end:int>>"])
    return documents.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(spark, documents, labels)
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out(MODULUS, REMAINDER).alias("held_out"), "score", "predicted", "spans")


def clean(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a model fitted to these labels doesn't call toxic, with their columns as they were."""
    scored = score(documents, fit(spark, documents, labels)).where("predicted = 0")
    # The first columns are the documents' own, some under other names.
    return scored.select(*(F.col(f"`{n}`").alias(c) for c, n in zip(documents.columns, scored.columns, strict=False)))


QUERIES = {"op10_toxicity": op10_toxicity}

ORACLE_SQL: dict[str, str] = {}
