"""What the text classifiers share: a bounded labelled sample as hashed features, and a small optimiser."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)).cast("int")


class Sample:
    """Labelled rows of sparse features (sorted places, counts), held compressed and unpacked one row at a time."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        self.rows = rows
        self.labels = np.array([r[0] for r in rows], np.int64)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, places, counts in self.rows:
            yield np.cumsum(np.frombuffer(zlib.decompress(places), np.int32), dtype=np.int32), np.frombuffer(zlib.decompress(counts), np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, usable: Column, most: int, features: FEATURES) -> Sample:
    """At most ``most`` labelled documents, those of least hashed id: bounded, and the same at each run.

    docs: (doc_id, text).  Null labels do not count; of several labels of an id the largest does.
    """
    wanted = labels.where(usable).select("doc_id", label.cast("int").alias("label")).where("doc_id is not null and label is not null")
    wanted = wanted.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"])
    pack = lambda x: zlib.compress(x.astype(np.int32).tobytes(), 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(pack(np.diff(at, prepend=0)), pack(count)) for at, count in features(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.binary()), pa.array([c for _, c in got], pa.binary())],
                names=["doc_id", "label", "places", "counts"],
            )

    found = rows.mapInArrow(make, "doc_id long, label int, places binary, counts binary").collect()  # at most `most` rows
    found.sort(key=lambda r: r["doc_id"])
    return Sample([(r["label"], bytes(r["places"]), bytes(r["counts"])) for r in found])


class Sparse:
    """Rows of sparse features: products with weights and their transposed."""

    def __init__(self, rows: Iterable[tuple[np.ndarray, np.ndarray]], width: int):
        rows = list(rows)
        self.width, self.n = width, len(rows)
        self.at = np.concatenate([x for x, _ in rows]) if rows else np.zeros(0, np.int32)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float32) if rows else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x, _ in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at] * self.value, minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row] * self.value, minlength=self.width)


def adam(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
