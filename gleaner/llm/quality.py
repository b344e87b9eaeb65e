"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates.

Features of a text are its words (folded to lower case), word pairs, and the same for word
shapes (runs of capitals, letters, digits and each sign; whether a word repeats the one
before), hashed into 2**BITS places.  Their values are shares of the text's words, so that
long and short texts compare.  A score is the sparse dot product with the weights.

It is fitted on at most SAMPLE labelled documents; every document is scored whole.

Defined results: null and empty texts score by the bias alone; without labels of both kinds,
every score is the share of label 1 among them (1 if there are none); null labels are not
learned from; repeated rows get the same score; other columns are passed through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled

BITS, SAMPLE, EPOCHS, THRESHOLD = 18, 8000, 4, 0.7
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 1e-4, 1e-4, 20.0
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def mixed(a: np.ndarray, salt: int) -> np.ndarray:
    a = (a ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((a ^ a >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Arrays of feature places, each in step with the words, and where each text starts."""
    words, ids, offsets = labelled.indexed_words(texts)
    raw = [w.encode("utf-8", "replace") for w in words]
    word = labelled.crcs([w.lower() for w in raw]).astype(np.uint64)[ids]
    shape = labelled.crcs([_RUN.sub(rb"\1", w.translate(_SHAPE)) for w in raw]).astype(np.uint64)[ids]
    start = np.zeros(len(ids), bool)
    start[offsets[:-1][offsets[:-1] < len(ids)]] = True
    before = lambda x: np.where(start, np.uint64(1), np.concatenate([x[:1], x[:-1]]))
    shape2 = shape | (word == before(word)).astype(np.uint64) << np.uint64(33)
    pair = lambda a, b: a * np.uint64(0x2545F4914F6CDD1D) + b
    s1 = before(shape2)
    return [mixed(word, 1), mixed(pair(before(word), word), 2), mixed(shape2, 3), mixed(pair(s1, shape2), 4), mixed(pair(pair(before(s1), s1), shape2), 5)], offsets


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias.  Features are made on executors; what comes to the driver is bounded by SAMPLE."""

    def run(batches):
        for whole in batches:
            for b in common.slices(whole):
                places, offsets = features(b.column("text").to_pylist())
                idx, val = [], []
                for a, e in zip(offsets[:-1], offsets[1:]):
                    i, n = np.unique(np.concatenate([p[a:e] for p in places]), return_counts=True)
                    idx.append(i)
                    val.append((n * (SCALE / max(1, e - a))).astype(np.float32))
                yield pa.RecordBatch.from_arrays([b.column("picked"), b.column("y"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["picked", "y", "i", "x"])

    got = rows.mapInArrow(run, "picked long, y int, i array<int>, x array<float>").toArrow()
    y = got.column("y").to_numpy()
    size = 1 << BITS
    w = np.zeros(size)
    if len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 1.0
        return w, 30.0 if p == 1 else -30.0
    # Rows stay where Arrow has them, in order of picked: a copy of each would stay in the driver's memory.
    by = np.argsort(got.column("picked").to_numpy(), kind="stable")
    y = y[by]
    chunk = np.repeat(np.arange(got.column("i").num_chunks), [len(c) for c in got.column("i").chunks])[by]
    start, end = (np.concatenate([c.offsets.to_numpy()[k : len(c) + k] for c in got.column("i").chunks])[by] for k in (0, 1))
    places, values = ([c.values.to_numpy() for c in got.column(name).chunks] for name in "ix")
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # both labels count alike
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = bias = 0.0
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(y)).tolist():
            at = slice(start[k], end[k])
            i, x = places[chunk[k]][at], values[chunk[k]][at].astype(np.float64)
            own = np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(own @ x + bias, -35, 35)))
            g = (p - y[k]) * weight[k]
            gx = g * x
            root = np.sqrt(n[i] + gx * gx)
            z[i] += gx - (root - np.sqrt(n[i])) / ALPHA * own
            n[i] += gx * gx
            s = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA
            bias_z += g - s * bias
            bias_n += g * g
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    del got, places, values, i, x
    common.freed(rows.sparkSession)
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)), bias


def score(docs: DataFrame, weights: np.ndarray, bias: float, column: str = "score") -> DataFrame:
    """Adds the score of every whole text."""
    kept = docs.drop(column)
    w32, text = weights.astype(np.float32), "text"
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, text):
                places, offsets = features(b.column(text).cast(pa.string()).to_pylist())
                each = np.zeros(int(offsets[-1]) + 1)
                for p in places:
                    each[1:] += w32[p]
                sums = np.cumsum(each)[offsets]
                margin = np.diff(sums) * SCALE / np.maximum(np.diff(offsets), 1) + bias
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], [*b.schema.names, column])

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """The rows of docs with held_out, score and predicted."""
    weights, bias = train(labelled.sample(docs, labels, "quality", parts, part, SAMPLE))
    done = score(docs.drop("held_out", "predicted"), weights, bias)
    return done.withColumn("held_out", labelled.held_out(F.col("doc_id"), parts, part)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject."""
    return classify(docs, labels).where("predicted = 1").select(*docs.columns)
