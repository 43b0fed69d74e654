"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all grades and ordered thresholds t_1 < t_2 < ...
x holds the hashed n-grams of the whole text's UTF-8 bytes in lower case, as 1 + log(count), scaled to
length 1, and how varied the text is for its length.  The result has the expected grade and the tail probability P(grade >= select_grade), by which rows are selected.
The labelled sample is bounded by ``most`` documents; everything else reads all texts.

Defined results: null and empty texts count as a blank; repeated rows get equal scores; a null id is
scored too; without labels the tail is 0.5 at each grade; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._chargrams import grams
from ._fit import Sparse, adam, fold_of, labelled_sample, sigmoid
from ._store import ship
from ._words import release


def fit_cumulative_link(x: Sparse, y: np.ndarray, n_grades: int, steps: int = 150, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) that maximise the likelihood of grades y in 0..n_grades-1."""
    k = n_grades - 1
    rates = np.clip([(y >= j + 1).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    t0 = -np.log(rates / (1 - rates))
    steps_up = np.log(np.maximum(np.diff(t0), 1e-2))
    start = np.concatenate((np.zeros(x.width), t0[:1], steps_up))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((p[x.width : x.width + 1], np.exp(p[x.width + 1 :]))))

    def gradient(p: np.ndarray) -> np.ndarray:
        t = thresholds(p)
        z = x.dot(p[: x.width])
        upper = np.append(-np.inf, t)[y]  # the grade is at least y
        lower = np.append(t, np.inf)[y]  # and below y + 1
        a, b = sigmoid(z - upper), sigmoid(z - lower)
        a, b = np.where(np.isinf(upper), 1.0, a), np.where(np.isinf(lower), 0.0, b)
        prob = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / prob, b * (1 - b) / prob
        n = len(y)
        dt = np.array([(da[y == j + 1].sum() - db[y == j].sum()) / n for j in range(k)])
        after = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate((x.back(-(da - db) / n) + decay * p[: x.width], after[:1], after[1:] * np.exp(p[x.width + 1 :])))
        return g

    p = adam(start, gradient, steps, rate)
    return p[: x.width].astype(np.float32), thresholds(p)


def _values(count: np.ndarray) -> np.ndarray:
    """1 + log(count), scaled to length 1; half for the feature of count 0."""
    value = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0)
    return np.where(count > 0, value / np.sqrt((value * value).sum() or 1), 0.5).astype(np.float32)


def expected_quality(
    docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (2, 3), bits: int = 16,
    most: int = 4000, select_grade: int = 1, select_tail: float = 0.5, held_fold: int = 2,
) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail, keep) for each row of ``docs``.

    grade: an integer expression over ``labels`` (doc_id, ...) from 0 to n_grades - 1.  keep: tail >= select_tail.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("label"))

    def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for g in grams(column, sizes, bits):
            count = np.bincount(g, minlength=1 << bits)
            at = np.flatnonzero(count).astype(np.int32)
            # One more feature, of count 0, for how varied a text of this length is, which scaling hides.
            varied = (1 << bits) + len(g).bit_length() * 17 + len(at) * 16 // max(len(g), 1)
            yield np.append(at, np.int32(varied)), np.append(count[at], 0)

    sample = labelled_sample(docs, labels, F.col("label"), fold_of(F.col("doc_id")) != held_fold, most, features)
    width = (1 << bits) + 64 * 17
    weight, cut = np.zeros(width, np.float32), np.zeros(n_grades - 1)
    if len(sample.labels):
        weight, cut = fit_cumulative_link(Sparse(((at, _values(count)) for at, count in sample), width), np.clip(sample.labels, 0, n_grades - 1), n_grades)
    release()
    model = spark.sparkContext.broadcast((weight, cut))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = model.value
        for batch in batches:
            z = np.array([float(w[at] @ _values(count)) for at, count in features(batch.column(1))], float)
            tails = sigmoid(z[:, None] - t[None, :])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, select_grade - 1])], names=["doc_id", "expected_grade", "tail"])

    scored = docs.mapInArrow(score, "doc_id long, expected_grade double, tail double")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == held_fold).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= select_tail).alias("keep"))
