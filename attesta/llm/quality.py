"""Text quality by ordinal regression: one weight vector, ordered thresholds between grades.

P(grade <= k) = sigmoid(threshold_k - w.x). The features x are hashed words and hashed runs
of three character classes, log-counted and scaled to length 1. The model gives the expected
grade of a document and the probability of each tail, by which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, BYTE_VALUE, LOWER, names_apart, row_slices, small_batches, table, window_hashes, word_hashes, word_spans
from .toxicity import held_out, training_sample

WORD_FEATURES = 1 << 15
SHAPE_FEATURES = 1 << 12
#: The model is fitted on this many labelled documents of each grade at most, of this many bytes at most.
TRAIN_DOCS = 2000
TRAIN_BYTES = 1 << 16
EPOCHS = 150

#: Bytes by class: capitals, small letters, digits and bytes beyond ASCII are one each, others are themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 128


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the entries that aren't 0, by row."""
    n, dims = len(off) - 1, WORD_FEATURES + SHAPE_FEATURES
    low = LOWER[data]
    s, e, row = word_spans(low, off, ALNUM_BYTES)
    word = row * dims + (word_hashes(low, s, e) % np.uint64(WORD_FEATURES)).astype(np.int64)
    shape = (window_hashes(BYTE_VALUE[SHAPE[data]], 3) % np.uint64(SHAPE_FEATURES)).astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(off))
    inside = of[: len(shape)] == of[2:] if len(shape) else np.zeros(0, bool)
    shape = (of[: len(shape)] * dims + WORD_FEATURES + shape)[inside]
    key, count = np.unique(np.concatenate([word, shape]), return_counts=True)
    row, feature, value = key // dims, key % dims, np.log1p(count)
    # Words and shapes are scaled apart, so that neither drowns the other.
    part = row * 2 + (feature >= WORD_FEATURES)
    norm = np.sqrt(np.bincount(part, value * value, 2 * n))
    return row, feature, value / norm[part]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than grades
    grades: np.ndarray  # rising

    def latent(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, feature, value = features(data, off)
        return np.bincount(row, self.weights[feature] * value, len(off) - 1)

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """By row, the probability of each grade but the lowest, or a higher one."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -30, 30)))


def fit_ordinal(row, feature, value, grade: np.ndarray, n_grades: int, weight: np.ndarray, epochs: int = EPOCHS, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood (Adam, all rows at a time). ``grade`` counts from 0; thresholds
    are a first one and positive gaps, so they stay in order."""
    n, dims = len(grade), WORD_FEATURES + SHAPE_FEATURES
    share = np.clip(np.cumsum(np.bincount(grade, weight, n_grades))[:-1] / weight.sum(), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    x = np.concatenate([np.zeros(dims), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    at = np.arange(n)
    for t in range(1, epochs + 1):
        gaps = np.exp(x[dims + 1 :])
        thresholds = np.concatenate([[-np.inf], x[dims] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        latent = np.bincount(row, x[feature] * value, n)
        upper, lower = sigmoid(thresholds[grade + 1] - latent), sigmoid(thresholds[grade] - latent)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = weight * upper * (1 - upper) / p / n, weight * lower * (1 - lower) / p / n
        by_threshold = np.zeros(n_grades + 1)
        np.add.at(by_threshold, grade[at] + 1, -du)
        np.add.at(by_threshold, grade[at], dl)
        inner = by_threshold[1:-1]
        g = np.concatenate([np.bincount(feature, (du - dl)[row] * value, dims) + decay * x[:dims], [inner.sum()], np.cumsum(inner[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:dims], x[dims] + np.concatenate([[0], np.cumsum(np.exp(x[dims + 1 :]))])


def fit_quality(docs: DataFrame, ratings: DataFrame, per_grade: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> OrdinalModel:
    """From ``ratings`` (doc_id, grade; up to 16 grades) of documents that aren't held out. With fewer than two
    grades every document gets the grade there is (0 where there is none)."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, ratings, F.col("grade"), per_grade, max_bytes)
    schema = "grade int, feature array<int>, value array<float>"

    def extract(batches):
        for batch in batches:
            grade = batch.column("grade")
            for i, j, data, off in row_slices(batch.column("text")):
                row, feature, value = features(data, off)
                cut = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x, kind)) for x, kind in ((feature, pa.int32()), (value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([grade.slice(i, j - i).cast(pa.int32()), *lists], ["grade", "feature", "value"])

    found = sample.select("grade", "text").mapInArrow(extract, schema).toPandas()
    grades, grade = np.unique(found.grade.to_numpy(), return_inverse=True)
    dims = WORD_FEATURES + SHAPE_FEATURES
    if len(grades) < 2:
        return OrdinalModel(np.zeros(dims), np.zeros(0), grades if len(grades) else np.zeros(1))
    row = np.repeat(np.arange(len(found)), found.feature.map(len))
    feature, value = np.concatenate(found.feature.to_list()), np.concatenate(found.value.to_list())
    # The sample has as many of each grade as it can; weigh the grades as all ratings have them.
    n = {r.grade: r.n for r in ratings.where(~held_out(F.col("doc_id"))).groupBy("grade").agg(F.count(F.lit(1)).alias("n")).where("grade is not null").collect()}
    share = np.array([n.get(int(g), 1) for g in grades]) / np.bincount(grade)
    weight = share[grade] / share[grade].mean()
    return OrdinalModel(*fit_ordinal(row, feature, value, grade, len(grades), weight), grades)


@names_apart("_qc")
def with_quality(docs: DataFrame, model: OrdinalModel, keep_grade: int, keep_probability: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of ``keep_grade`` or more) and kept. Columns of these names are
    replaced. Null and empty texts have no features and get what the thresholds alone say."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected:double,tail:double>")
    def rate(text: pa.Array) -> pa.Array:
        m = held.value
        latent = [m.latent(data, off) for _, _, data, off in row_slices(text)]
        tails = m.tails(np.concatenate(latent) if latent else np.zeros(0))
        expected = m.grades[0] + tails @ np.diff(m.grades).astype(float)
        above = np.flatnonzero(m.grades[1:] >= keep_grade)
        tail = tails[:, above[0]] if len(above) and m.grades[0] < keep_grade else np.full(len(tails), float(m.grades[0] >= keep_grade))
        return pa.StructArray.from_arrays([pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], ["expected", "tail"])

    rated = docs.withColumn("_qc", rate("text"))
    return rated.withColumns({"expected_grade": F.col("_qc.expected"), "tail_probability": F.col("_qc.tail"), "kept": F.col("_qc.tail") >= keep_probability}).drop("_qc")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, rated by a model of three grades: 0 of low quality, 1 good but toxic, 2 good. Kept: likely 1 or 2."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    rated = with_quality(docs, fit_quality(docs, ratings), keep_grade=1)
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept")
