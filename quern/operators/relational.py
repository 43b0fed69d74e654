"""Joins, grouping, ordering and sampling operators.  Everything is planned by Catalyst; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators.ordered import hash_place


def left_join_checked(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """LEFT 1:N join that keeps each childless parent once; parents must have unique keys and no column name in common."""
    if clash := set(parent.columns) & set(child.columns) - {key}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    checked = parent.withColumn("_n", n).withColumn(key, F.when(F.assert_true(F.col("_n") == 1, "parent key is not unique").isNull(), F.col(key))).drop("_n")
    return checked.join(child, key, "left")


def first_of_equal(df: DataFrame, same: Column, order: str) -> DataFrame:
    """One row for each value of ``same``: the one first by ``order``; aggregated, so a value with very many rows is no hot task."""
    rest = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(same.alias("_same")).agg(F.min_by(rest, F.col(order)).alias("r")).select("r.*")


def close_hashes(df: DataFrame, id_col: str, hash_col: str, radius: int, bits: int = 64, by: list[str] | None = None) -> DataFrame:
    """(a, n_a, b, n_b, distance), a < b: pairs of different ``bits``-bit hashes within ``radius`` bits, by the smallest id of each hash.

    Exact: two such hashes agree in one of radius + 1 blocks of bits.  Rows of an equal hash are one class (its smallest id and its
    size), so large groups of copies make no pairs; the pair is taken from the first block in which it meets.
    With ``by``, only hashes of equal ``by`` meet.
    """
    cut = [round(i * bits / (radius + 1)) for i in range(radius + 2)]
    block = lambda h, i: F.shiftrightunsigned(h, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1 if cut[i + 1] - cut[i] < 64 else -1))
    classes = df.where(F.col(hash_col).isNotNull()).groupBy(F.struct(F.lit(0), *(by or [])).alias("by"), F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    keyed = classes.select("id", "n", "h", "by", F.posexplode(F.array(*[block(F.col("h"), i) for i in range(radius + 1)])).alias("block", "value"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & F.col("a.by").eqNullSafe(F.col("b.by")) & (F.col("a.id") < F.col("b.id")))
    differ = F.col("a.h").bitwiseXOR(F.col("b.h"))
    first = F.lit(radius + 1)
    for i in range(radius, -1, -1):
        first = F.when(block(differ, i) == 0, F.lit(i)).otherwise(first)
    distance = F.bit_count(differ)
    return met.where((distance <= radius) & (F.col("a.block") == first)).select(
        F.col("a.id").alias("a"), F.col("a.n").alias("n_a"), F.col("b.id").alias("b"), F.col("b.n").alias("n_b"), distance.alias("distance")
    )


def distances(df: DataFrame, id_col: str, hash_col: str, radius: int, bits: int = 64) -> DataFrame:
    """(distance, pairs): how many pairs of rows are 0 to ``radius`` bits apart; multiplied out from classes, no pair is made."""
    n = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count(F.lit(1)).alias("n"))
    same = n.select(F.lit(0).alias("distance"), F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    near = close_hashes(df, id_col, hash_col, radius, bits).select("distance", (F.col("n_a") * F.col("n_b")).alias("pairs"))
    return same.union(near).groupBy("distance").agg(F.sum("pairs").alias("pairs"))


def stratified_sample(groups: DataFrame, group: str, stratum: str, size: int, seed: str) -> DataFrame:
    """Whole groups by stratum in seeded hash order; larger sizes contain smaller ones.  Adds G_h and n_h."""
    total = groups.agg(F.count(F.lit(1)).alias("population"))
    per = groups.groupBy(stratum).agg(F.count(F.lit(1)).alias("G_h")).crossJoin(F.broadcast(total))  # one row
    per = per.withColumn("n_h", S.allocate(F.col("G_h"), size, F.col("population"))).drop("population")
    placed = hash_place(groups, [stratum], group, seed).withColumn("place", F.col("place").cast("int"))
    return placed.join(per, stratum).where("place <= n_h")


def rule_lookup(queries: DataFrame, rules: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each query's clause: equal keys and lo <= value < hi.  state: ok, none or multiple (different clauses)."""
    hit = F.col("lo").isNull() | (F.col(value) >= F.col("lo"))
    hit &= F.col("hi").isNull() | (F.col(value) < F.col("hi"))
    joined = queries.join(rules, keys, "left").withColumn("hit", F.coalesce(hit & F.col("clause").isNotNull(), F.lit(False)))
    out = joined.groupBy(*queries.columns).agg(F.count_distinct(F.when(F.col("hit"), F.col("clause"))).alias("n"), F.min(F.when(F.col("hit"), F.col("clause"))).alias("clause"))
    state = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "ok").otherwise("multiple")
    return out.select(*queries.columns, F.when(F.col("n") == 1, F.col("clause")).alias("clause"), state.alias("state"))


def interval_faults(rules: DataFrame, by: list[str]) -> DataFrame:
    """Gaps and overlaps between consecutive half-open intervals (lo, hi) of a group."""
    w = W.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    kind = F.when(F.col("lo") > before, "gap").when(F.col("lo") < before, "overlap")
    return rules.withColumn("before", before).select(*by, "lo", "hi", kind.alias("fault")).where("fault is not null")


def mutual_best(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are the only best of each other, with a score above 0; ties give no pair."""
    good = pairs.where(F.col(score) > 0)
    def best(k: str) -> DataFrame:
        most = good.groupBy(k).agg(F.max(score).alias("m"))
        top = good.join(most, k).where(F.col(score) == F.col("m"))
        return top.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.first(b if k == a else a).alias("o")).where("n = 1")
    left, right = best(a).select(a, F.col("o").alias(b)), best(b).select(b, F.col("o").alias(a))
    return left.join(right, [a, b])
