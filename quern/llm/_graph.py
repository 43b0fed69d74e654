"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ONE_TASK_ROWS, drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.inline(ends))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    )


def _small_star(edges: DataFrame, one: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = moved.union(least.select("u", F.col("m").alias("v")))
    return (out.coalesce(1) if one else out).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v: long).

    The component is its smallest node.  Self-loops and repeated edges do not
    matter; an empty table gives an empty one.  Each pass is written to the
    shared folder; the loop ends when a pass changes no edge.  All steps are
    keyed aggregations with map-side combine and plain equi-joins, whose skew
    (a node with very many links) adaptive execution splits.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    n, seen = now.count(), None
    while True:
        one = n <= ONE_TASK_ROWS  # few edges: the same steps in one task, without any shuffle
        nxt = written(_small_star(_large_star(now.coalesce(1) if one else now), one), "cc")
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now, n = nxt, mark[0]
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
