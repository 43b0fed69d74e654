"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams of the UTF-8 bytes of the whole text, in lower case.
On the labelled sample each gets the log ratio of its smoothed document rates
in toxic and other texts; ratios of rare or indifferent n-grams are 0.  A logistic regression on the
scaled features gives the weights.  The sample is bounded by ``most`` documents; everything else reads all texts.

Defined results: null and empty texts have no n-gram but the blanks around them and get a score from the bias;
repeated rows get equal scores; a null id is scored too (held_out null); without labels all scores are 0.5; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chargrams import distinct, grams
from ._fit import Sparse, adam, fold_of, labelled_sample, sigmoid
from ._store import ship
from ._words import release

SCALE = 0.05


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sizes: tuple[int, ...] = (5, 6), bits: int = 20,
    most: int = 4000, min_docs: int = 8, min_ratio: float = 1.0, threshold: float = 0.3, held_fold: int = 2, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, held_out, score, predicted, *keep) for each row of ``docs``; keep: columns to carry, ``text`` may be among them."""
    spark = docs.sparkSession
    ship(spark)
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label"))

    def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flags = np.zeros(1 << bits, bool)
        for g in grams(column, sizes, bits):
            at = distinct(g, flags)
            yield at, np.zeros(0, np.int32)

    sample = labelled_sample(docs.select("doc_id", "text"), labels, F.col("label"), fold_of(F.col("doc_id")) != held_fold, most, features)
    y = (sample.labels > 0).astype(float)
    weight, bias = np.zeros(1 << bits, np.float32), 0.0
    if len(y):
        toxic, other = np.ones(1 << bits), np.ones(1 << bits)
        for (at, _), t in zip(sample, y):
            (toxic if t else other)[at] += 1
        ratio = np.log(toxic / (y.sum() + 2)) - np.log(other / (len(y) - y.sum() + 2))
        ratio[(toxic + other - 2 < min_docs) | (np.abs(ratio) < min_ratio)] = 0
        used = np.flatnonzero(ratio)
        number = np.full(1 << bits, -1, np.int32)
        number[used] = np.arange(len(used))
        kept = (number[at[ratio[at] != 0]] for at, _ in sample)
        x = Sparse(((n, (SCALE * ratio[used[n]]).astype(np.float32)) for n in kept), len(used))

        def gradient(w: np.ndarray) -> np.ndarray:
            g = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / len(y)
            return np.append(x.back(g) + 1e-4 * w[:-1], g.sum())

        fitted = adam(np.zeros(len(used) + 1), gradient, 120, 0.05)
        weight[used] = fitted[:-1] * ratio[used] * SCALE
        bias = float(fitted[-1])
        del x, toxic, other
    release()
    model = spark.sparkContext.broadcast((weight, bias))  # 4 * 2**bits bytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            z = [float(w[distinct(g, flags)].sum()) + b for g in grams(batch.column("text"), sizes, bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(np.array(z, float)), pa.float64())], names=[*batch.schema.names, "score"])

    # Only what the result carries goes through Python.
    sent = docs if "text" not in keep else docs.drop(f"k{keep.index('text')}")
    scored = sent.mapInArrow(score, sent.schema.simpleString()[7:-1].replace(":", " ") + ", score double")
    out = [F.col("text" if c == "text" else f"k{i}").alias(c) for i, c in enumerate(keep)]
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *out)
