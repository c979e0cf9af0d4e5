"""Toxicity (op2): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes, modulo 2**DIM_BITS, of a text's words, of its word
pairs and of its pairs with one word between.  The learner keeps one learning rate
per coordinate; L1 leaves few non-zero weights, which are broadcast (at most 2**18
weights of 8 bytes, a proven 2 MB).

The fit uses at most FIT_ROWS labelled rows, the lowest by a hash of the id among
those allowed, and of these only the first whose features take FIT_BYTES together; both bounds
are parameters, and everything else reads all rows.  The features of those rows are computed on
the executors, and repeats of an id are dropped there.  Scoring reads whole texts.

Defined cases: null or empty text scores the intercept alone; conflicting labels of
one id count as toxic if any says so, and of several texts of one id one is learned; null labels and null ids are not learned from;
without any usable label every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .common import byte_bound, crc_mod, drop_staged, staged

DIM_BITS, FIT_ROWS, FIT_BYTES, EPOCHS, THRESHOLD = 18, 12000, 64 << 20, 5, 0.7
ALPHA, BETA, L2 = 3.0, 1.0, 0.02


def l1_for(positives: int) -> float:
    """L1 in proportion to the toxic rows learned from: a word seen in few of them gets no weight."""
    return min(15.0, max(1.0, positives / 80))


def features(h: np.ndarray) -> np.ndarray:
    """Distinct feature indices of the word hashes of one text."""
    mask = np.uint64((1 << DIM_BITS) - 1)
    return np.unique((np.concatenate([h, tc.ngrams(h, 2), tc.ngrams(h, 2, skip=1)]) >> np.uint64(20)) & mask).astype(np.int32)


def _word_rows(arr) -> Iterator[np.ndarray]:
    word, fold = tc.class_table(tc.ALNUM), tc.fold_table()
    buf, offs = tc.text_bytes(arr)
    for a, b in tc.row_groups(offs):
        h, _, _, rows = tc.words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], word, fold)
        for i in range(b - a):
            yield h[rows[i] : rows[i + 1]]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([features(h).tobytes() for h in _word_rows(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), x], ["doc_id", "toxic", "x"])


class Ftrl:
    """FTRL-proximal for a logistic loss; one learning rate per coordinate."""

    def __init__(self, dim: int, alpha: float = ALPHA, beta: float = BETA, l1: float = 1.0, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, x: np.ndarray, y: int) -> None:
        i = np.append(x, len(self.z) - 1)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, allowed, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> np.ndarray:
    """Weights (the last is the intercept) from labelled rows for which the column `allowed` holds."""
    byte_bound(docs.sparkSession)
    usable = labels.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most fit_rows rows of 12 bytes
    known = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(_featurise, "doc_id long, toxic int, x binary")
    known = staged(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("x").alias("x")).withColumn("turn", F.xxhash64("doc_id")), "features")
    sizes = known.select("turn", F.octet_length("x").alias("n")).orderBy("turn").toPandas()  # at most fit_rows rows of 12 bytes
    last = sizes["turn"][(sizes["n"].cumsum() <= fit_bytes) | (sizes.index == 0)].max() if len(sizes) else 0
    rows = known.where(F.col("turn") <= F.lit(int(last))).select("doc_id", "toxic", "x").toPandas()  # at most fit_bytes of features, or one row
    drop_staged(known)
    if len(rows):
        model = Ftrl(1 << DIM_BITS, l1=l1_for(int((rows["toxic"] > 0).sum())))
        rows = rows.sort_values("doc_id")
        xs, ys = [np.frombuffer(x, np.int32) for x in rows["x"]], rows["toxic"].to_numpy()
        rng = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(xs)):
                model.learn(xs[k], int(ys[k] > 0))
        return model.weights(slice(None))
    empty = np.zeros((1 << DIM_BITS) + 1)
    empty[-1] = -np.inf
    return empty


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, value, bias = sent.value
        w = np.zeros(1 << DIM_BITS)
        w[index] = value
        for batch in batches:
            z = np.array([w[features(h)].sum() for h in _word_rows(batch.column("text"))]) + bias
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700)))), pa.float64())], [*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score for every row of docs."""
    byte_bound(docs.sparkSession)
    index = np.flatnonzero(weights[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((index, weights[index], weights[-1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(sent), "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only where crc32(doc_id) mod 3 is not 1."""
    weights = fit(docs, labels, crc_mod("doc_id", 3) != 1)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
