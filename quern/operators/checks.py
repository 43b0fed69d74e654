"""Checks as tables: every violation is a row (check, key), every reason of a row is kept, nothing stops at the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(found: dict[str, DataFrame]) -> DataFrame:
    """(check, key) of one-column tables of offending keys."""
    return reduce(DataFrame.unionByName, [df.toDF("key").select(F.lit(k).alias("check"), F.col("key").cast("string").alias("key")) for k, df in found.items()])


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct child keys without parent; a null key is one."""
    return child.select(key).distinct().join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def several(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Groups with more than one value; null is a value."""
    hidden = df.select(group, F.struct(value.alias("v")).alias("v")).distinct()
    return hidden.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(group)


def count_mismatch(parent: DataFrame, key: str, declared: str, child: DataFrame, child_key: str) -> DataFrame:
    """Parent keys whose declared number of children is not the real one."""
    n = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias("_n"))
    return parent.select(key, declared).join(n, key, "left").where(~F.col(declared).eqNullSafe(F.coalesce("_n", F.lit(0)))).select(key)


def compare_full(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) of keys on one side only (left, right) and of keys with different values (differs)."""
    x, y = a.select(key, F.col(value).alias("x"), F.lit(1).alias("_x")), b.select(key, F.col(value).alias("y"), F.lit(1).alias("_y"))
    state = F.when(F.col("_y").isNull(), "left").when(F.col("_x").isNull(), "right").when(~F.col("x").eqNullSafe(F.col("y")), "differs")
    return x.join(y, key, "full").select(key, state.alias("state")).where("state is not null")


def reasons(rules: dict[str, Column]) -> Column:
    """All names whose condition holds, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """(reason, n) over arrays; rows without any count as 'accepted'."""
    each = F.explode(F.when(F.size(reason) == 0, F.array(F.lit("accepted"))).otherwise(F.col(reason)))
    return df.select(each.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def capabilities(df: DataFrame, flags: dict[str, Column], num: int, den: int) -> DataFrame:
    """(flag, n_with, n, on): on if the condition holds for at least num / den of the rows."""
    n = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n_with")) for k in flags])
    return n.select("n", F.inline(rows)).select("flag", "n_with", "n", (F.col("n_with") * den >= F.col("n") * num).alias("on"))


def missing_grid(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) of the distinct values of both columns that no row has: the grid is as large as a ledger should be."""
    one, two = rows.select(a).distinct(), rows.select(b).distinct()
    lists = two.agg(F.collect_set(b).alias("_b"))  # clients: few
    return one.crossJoin(lists).select(a, F.explode("_b").alias(b)).join(rows.select(a, b).distinct(), [a, b], "left_anti")


def shared_content(df: DataFrame, content: Column, label: Column) -> DataFrame:
    """One row: contents that several rows share, those rows, and the contents whose rows differ in label."""
    t = df.select(content.alias("c"), label.alias("l")).where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("lo"), F.max("l").alias("hi")).where("n > 1")
    return t.agg(F.count(F.lit(1)).alias("contents"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicts"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def tagged_union(parts: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """Candidate pairs of several sources as unordered pairs (a < b) with the sorted names of their sources."""
    each = [df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), F.lit(k).alias("source")) for k, df in parts.items()]
    return reduce(DataFrame.union, each).where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def key_paths(df: DataFrame, json: str) -> DataFrame:
    """(path, n): how often each top-level key of a JSON object occurs; rows that are no object have none."""
    return df.select(F.explode(F.json_object_keys(json)).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
