"""Graphs as edge tables: components, groups by evidence, hops and closures.  Lineage is cut by checkpoint()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import close_hashes
from quern.sources.shipping import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in spark.checkpoint.dir; only where that is unset, on one machine as in tests, in a folder of our own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id of the edges (a, b).

    Rounds of large and small stars: each links neighbours to the smallest neighbour, so paths shrink by about half a round.  A node
    with very many edges is never gathered: its minimum is aggregated and joined back.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = cut(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def evidence_groups(df: DataFrame, id_col: str, hash_col: str, radius: int, bits: int, by: str, meta: str | None = None) -> DataFrame:
    """(id, component, size): rows of one ``by`` linked by an equal hash, a hash within ``radius`` bits, or an equal ``meta`` key.

    Rows without hash or key are alone.  Each key's rows are linked to its smallest id, so that copies make no pairs.
    """
    stars = []
    for key in [hash_col] + ([meta] if meta else []):
        rows = df.where(F.col(key).isNotNull()).select(F.col(id_col).alias("a"), F.col(by).alias("_by"), F.col(key).alias("_key"))
        stars.append(rows.join(rows.groupBy("_by", "_key").agg(F.min("a").alias("b")), ["_by", "_key"]).select("a", "b"))
    near = close_hashes(df, id_col, hash_col, radius, bits, [by]).select("a", "b")
    found = components(reduce(DataFrame.union, stars, near)).withColumnRenamed("id", id_col)
    out = df.select(id_col).join(found, id_col, "left").withColumn("component", F.coalesce("component", F.col(id_col)))
    return out.join(out.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select(id_col, "component", "size")


def hops(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, hop): ids first reached from the seeds in 0 to ``most`` steps along undirected edges (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for i in range(most):
        last = seen.where(F.col("hop") == i).select(F.col("id").alias("a"))
        new = both.join(last, "a", "left_semi").select(F.col("b").alias("id")).distinct()
        seen = cut(seen.union(new.join(seen, "id", "left_anti").withColumn("hop", F.lit(i + 1))))
    return seen


def supported(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Ids of ``items`` that stay when those whose needed ids (id, needs) are not kept are dropped, until none drops."""
    kept = cut(items.select("id").distinct())
    n = kept.count()
    while True:
        bad = needs.join(kept.select(F.col("id").alias("needs")), "needs", "left_anti").select("id").distinct()
        kept = cut(kept.join(bad, "id", "left_anti"))
        left = kept.count()
        if left == n:
            return kept
        n = left
