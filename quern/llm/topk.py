"""Exact top-k inner products by pivot-table elimination.

Components become floor(scale * x).  All rows get their distances to a set of pivots (chosen farthest-first from a
bounded sample).  For a query q and a row x the triangle inequality gives
``d(q, x) >= max over pivots |d(q, p) - d(x, p)|``, and with
``q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2`` an upper bound of the score.  Rows are
evaluated in the order of their bounds, until the best bound left is below the k-th score found; so the result is exact.

Queries are met in blocks: a block of at most about ``block`` queries is broadcast (a fixed size), and each partition
of rows keeps its k best for each query of the block; the partitions' lists are then merged.

Products are exact: vectors with components beyond ``sqrt(2**62 / dimension)``, whose products may not fit 64 bits, are
kept apart and evaluated with Python's integers; a result's score that does not fit a long is an error.

Defined results: vectors null, or with null or non-finite components, take no part; a shorter vector counts as if followed by zeros;
equal scores go to the smaller id; rows with the query's own id are no candidates; of several rows of a query's id one is the query;
a null id takes no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import ship, written

PIVOT_SAMPLE = 2048


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists of doubles, padded by zeros."""
    off = column.offsets.to_numpy()
    lens = np.diff(off)
    flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]] if len(column) else np.zeros(0)
    if (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], lens)] = flat
    return out


def _integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(scale * x) as int64, and the rows whose products may not fit, which are zero there, as Python's integers."""
    limit = math.isqrt((1 << 62) // max(x.shape[1], 1))
    large = np.flatnonzero((np.abs(x) > limit / scale - 1).any(1)) if x.size else []
    exact = {int(i): [math.floor(Fraction(c) * scale) if abs(c) * scale >= 1 << 52 else math.floor(c * scale) for c in x[i].tolist()] for i in large}
    plain = x.copy()
    plain[list(exact)] = 0
    return np.floor(plain * scale).astype(np.int64), exact


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(float), pivots.astype(float)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first from the sample's first row."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]), np.int64)
    chosen = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64) for _ in range(n)]
        self.id = [np.zeros(0, np.int64) for _ in range(n)]

    def floor(self, q: int) -> float:
        return self.score[q][-1] if len(self.score[q]) == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[q], score)), np.concatenate((self.id[q], ids))
        if s.dtype == object:
            order = sorted(range(len(s)), key=lambda k: (-int(s[k]), i[k]))[: self.k]
        else:
            order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]

    def rows(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """How many each query has, and all ids and scores."""
        for s in self.score:
            if s.dtype == object and any(not -(1 << 63) <= int(v) < 1 << 63 for v in s):
                raise OverflowError("a score does not fit 64 bits")
        none = np.zeros(0, np.int64)
        return [len(s) for s in self.score], np.concatenate(self.id or [none]), np.concatenate([s.astype(np.int64) for s in self.score] or [none])


def search_block(
    best: _Best, q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray, ids: np.ndarray, x: np.ndarray, x_table: np.ndarray, q_large: dict | None = None, x_large: dict | None = None
) -> int:
    """Meet a block of queries with rows; the number of scores that were evaluated."""
    q_large, x_large = q_large or {}, x_large or {}
    evaluated = _search_large(best, q_ids, q, ids, x, q_large, x_large) if q_large or x_large else 0
    apart = list(x_large)
    q_norm, x_norm = (q.astype(float) ** 2).sum(1), (x.astype(float) ** 2).sum(1)
    columns = [np.ascontiguousarray(x_table[:, p]) for p in range(x_table.shape[1])]
    for i in range(len(q)):
        if i in q_large:
            continue
        low = np.zeros(len(x))
        gap = np.empty(len(x))
        for p, column in enumerate(columns):
            np.subtract(column, q_table[i, p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        total = q_norm[i] + x_norm
        low = np.maximum(low - 1e-6 * (1 + np.sqrt(total)), 0)  # rounding of the distances
        bound = (total - low * low) / 2 + 1e-6 * (1 + total)
        bound[ids == q_ids[i]] = -np.inf
        bound[apart] = -np.inf
        left = np.flatnonzero((bound >= best.floor(i)) & (bound > -np.inf))
        step = 64
        while len(left):
            if len(left) > step:
                top = left[np.argpartition(-bound[left], step - 1)[:step]]
                # Everything with the bounds of this step is evaluated before anything below.
                cut = bound[top].min()
                take = bound[left] >= cut
                top, left = left[take], left[~take]
            else:
                top, left = left, left[:0]
            best.add(i, x[top] @ q[i], ids[top])
            evaluated += len(top)
            left = left[bound[left] >= best.floor(i)]
            step *= 2
    return evaluated


def _search_large(best: _Best, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, q_large: dict, x_large: dict) -> int:
    """All pairs in which a vector is large, of other ids."""
    evaluated = 0
    for i in range(len(q)):
        rows = range(len(x)) if i in q_large else x_large
        mine = q_large.get(i) or q[i].tolist()
        met = [k for k in rows if ids[k] != q_ids[i]]
        if met:
            score = [sum(a * b for a, b in zip(mine, x_large.get(k) or x[k].tolist())) for k in met]
            best.add(i, np.array(score, object), ids[met])
            evaluated += len(met)
    return evaluated


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, n_pivots: int = 24, block: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` (over ``vec_id``) holds, against all rows."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = written(v.where(fine).select("vec_id", "v"), "vectors")
    dim = v.agg(F.max(F.size("v"))).first()[0] or 0
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    pivots = choose_pivots(_integers(_matrix(sample.column("v").combine_chunks(), dim), scale)[0] if len(sample) else np.zeros((0, dim), np.int64), n_pivots)
    queries = v.where(is_query).dropDuplicates(["vec_id"])
    n_blocks = math.ceil(queries.count() / block)
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(n_blocks, 1)))), "queries")
    merged: DataFrame | None = None
    for b in range(n_blocks):
        mine = queries.where(F.col("block") == b).toArrow()  # about `block` rows
        q, q_large = _integers(_matrix(mine.column("v").combine_chunks(), dim), scale)
        shared = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), q, _distances(q, pivots), q_large, pivots))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, q_table, q_large, pivots = shared.value
            best = _Best(len(q), k)
            for batch in batches:
                x, x_large = _integers(_matrix(batch.column(1), dim), scale)
                search_block(best, q_ids, q, q_table, batch.column(0).to_numpy(), x, _distances(x, pivots), q_large, x_large)
            n, found, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        found = v.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long")
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        top = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "top")
        merged = top if merged is None else merged.union(top)
    if merged is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return merged.select("query_id", "rank", "vec_id", "score")
