"""Running sums and everything that follows from them: prefixes of a seeded order, shares, exact quantiles.

A running sum over one window is one task for a key that holds most rows.  Here rows are dealt by (key, part), where the part is
monotone in the order (the first digits of a hash, a place among quantiles of a number); sums of parts, a bounded number for each key, are run first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scalars as S

BEFORE = (W.unboundedPreceding, -1)
STEPS = 256


def sum_before(df: DataFrame, by: list[str], part: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` (nulls are a key) that come before in ``order``."""
    rows = df.withColumn("_part", part).withColumn("_value", value)
    names = [f"_by{i}" for i in range(len(by))]
    sums = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_part").alias("_p")).agg(F.sum("_value").alias("_s"))
    above = F.sum("_s").over(W.partitionBy(*names).orderBy("_p").rowsBetween(*BEFORE))
    sums = sums.withColumn("_above", F.coalesce(above, F.lit(0)))
    inside = F.sum("_value").over(W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(*BEFORE))
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for c, n in zip(by, names):
        same &= F.col(c).eqNullSafe(F.col(n))
    joined = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, same)
    return joined.select(*df.columns, (F.col("_above") + F.col("_inside")).alias(out))


def spread(df: DataFrame, value: str, bins: int = 4096) -> tuple[DataFrame, Column]:
    """The rows with a part beside that is monotone in a numeric column (nulls lowest, NaN highest).

    The parts are ``bins`` in number at most: equal widths between STEPS quantiles, so however the values lie, a part holds little more than one STEPS-th
    of the rows, but for equal values.
    """
    v = F.col(value).cast("double")
    finite = F.when(F.abs(v) < float("inf"), v)
    each = max(1, bins // STEPS)
    ends = df.agg(F.coalesce(F.percentile_approx(finite, [i / STEPS for i in range(STEPS + 1)], 10_000), F.array(F.lit(0.0))).alias("_ends"))  # one row
    # The segment of a value in two steps of comparisons, the place in it by its width.
    few = math.isqrt(STEPS)
    below = lambda at, n: F.size(F.filter(F.slice("_ends", at, n), lambda x: x <= v))
    tops = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(STEPS), F.lit(few)), lambda i: F.get("_ends", i - 1)), lambda x: x <= v))
    rows = df.crossJoin(F.broadcast(ends)).withColumn("_tops", F.greatest(tops, F.lit(1)))
    rows = rows.withColumn("_seg", (F.col("_tops") - 1) * few + F.greatest(below((F.col("_tops") - 1) * few + 1, F.lit(few)), F.lit(1)))
    lo, hi = F.get("_ends", F.col("_seg") - 1) / 2, F.get("_ends", F.col("_seg")) / 2
    share = F.when(hi > lo, F.least(F.greatest((v / 2 - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    place = F.when(F.isnan(v) | (v == float("inf")), each).when(share.isNotNull(), F.least(F.floor(share * each), F.lit(each - 1))).otherwise(0)
    return rows.withColumn("_spread", F.when(v.isNull(), -1).otherwise(F.col("_seg") * (each + 1) + place).cast("long")).drop("_ends", "_tops", "_seg"), F.col("_spread")


def previous(df: DataFrame, by: list[str], number: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Adds ``out``: the number before, of the same ``by`` (nulls are a key); whole numbers, dealt by (by, bin of ``width``)."""
    rows = df.withColumn("_bin", F.floor(F.col(number) / width))
    names = [f"_by{i}" for i in range(len(by))]
    tops = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_bin").alias("_b")).agg(F.max(number).alias("_top"))
    tops = tops.withColumn("_below", F.lag("_top").over(W.partitionBy(*names).orderBy("_b"))).drop("_top")
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for c, n in zip(by, names):
        same &= F.col(c).eqNullSafe(F.col(n))
    inside = F.lag(number).over(W.partitionBy(*by, "_bin").orderBy(number))
    return rows.withColumn("_inside", inside).join(tops, same).select(*df.columns, F.coalesce("_inside", "_below").alias(out))


def run_starts(df: DataFrame, by: list[str], number: str, most_gap: int, width: int = 1 << 16) -> DataFrame:
    """Adds run_start: the first number of the row's run; a run ends where the next number is more than ``most_gap`` higher.

    Dealt as in previous(); a bin without a start of its own before a row takes the last start of the bins below.
    """
    rows = previous(df, by, number, "_prev", width)
    gap = F.col(number) - F.col("_prev")
    rows = rows.withColumn("_start", F.when(gap.isNull() | (gap > most_gap), F.col(number))).withColumn("_bin", F.floor(F.col(number) / width))
    names = [f"_by{i}" for i in range(len(by))]
    last = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_bin").alias("_b")).agg(F.max("_start").alias("_s"))
    last = last.withColumn("_carried", F.max("_s").over(W.partitionBy(*names).orderBy("_b").rowsBetween(*BEFORE))).drop("_s")
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for c, n in zip(by, names):
        same &= F.col(c).eqNullSafe(F.col(n))
    own = F.max("_start").over(W.partitionBy(*by, "_bin").orderBy(number).rangeBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(last, same).select(*df.columns, F.coalesce("_own", "_carried").alias("run_start"))


def hash_place(df: DataFrame, by: list[str], key: str, seed: str, out: str = "place") -> DataFrame:
    """Adds the row's place, from 1, in the seeded hash order of its ``by``; ties by ``key``."""
    h = S.order_key(seed, F.col(key))
    keyed = df.withColumn("_h", h)
    placed = sum_before(keyed, by, F.substr("_h", F.lit(1), F.lit(3)), [F.col("_h"), F.col(key)], F.lit(1), "_n")
    return placed.select(*df.columns, (F.col("_n") + 1).alias(out))


def strata_sizes(df: DataFrame, stratum: str, out: str) -> DataFrame:
    return df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias(out))


def prefix_by_stratum(df: DataFrame, stratum: str, key: str, seed: str, wanted: Column) -> DataFrame:
    """The first rows of each stratum in hash order; ``wanted`` is a column over the stratum's size N.  Adds N and place."""
    sizes = strata_sizes(df, stratum, "N")
    placed = hash_place(df, [stratum], key, seed)
    return placed.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum"))).where(F.col("place") <= wanted).drop("_stratum")


def review_size(least: int, num: int, den: int) -> Column:
    """max(min(least, N), ceil(N * num / den)) on integers."""
    return F.greatest(F.least(F.lit(least), F.col("N")), F.floor((F.col("N") * num + den - 1) / den))


def budget_size(num: int, den: int, window: int) -> Column:
    """ceil(N * num / den / window) whole windows, at most N."""
    return F.least(F.col("N"), F.ceil(F.col("N") * num / (den * window)) * window)


def running_share(df: DataFrame, label: str, key: str, size: str, seed: str, permille: int) -> DataFrame:
    """Adds side: 'a' while the sizes before in the label's hash order are below permille / 1000 of its total, then 'b'."""
    total = df.groupBy(F.col(label).alias("_l")).agg(F.sum(size).alias("_total"))
    run = sum_before(df.withColumn("_h", S.order_key(seed, F.col(key))), [label], F.substr("_h", F.lit(1), F.lit(3)), [F.col("_h"), F.col(key)], F.col(size), "_before")
    side = F.when(F.col("_before") * 1000 < F.col("_total") * permille, "a").otherwise("b")
    return run.join(total, F.col(label).eqNullSafe(F.col("_l"))).select(*df.columns, side.alias("side"))


def quantile_cuts(df: DataFrame, value: str, k: int, bins: int = 4096) -> DataFrame:
    """One row: the distinct exact k-quantile cut points of the non-null values, with linear interpolation, as an array."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    wide, part = spread(v, "v", bins)
    run = sum_before(wide, [], part, [F.col("v")], F.col("n"), "first")
    at = F.explode(F.sequence(F.lit(1), F.lit(k - 1)))
    want = v.agg(F.sum("n").alias("total")).select(at.alias("i"), "total").withColumn("rank", F.col("i") * (F.col("total") - 1) / k)
    want = want.select("i", (F.col("rank") - F.floor("rank")).alias("f"), F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("r"), F.floor("rank").alias("low"))
    hit = run.join(F.broadcast(want), (F.col("r") >= F.col("first")) & (F.col("r") < F.col("first") + F.col("n")))  # 2 (k - 1) rows
    lo, hi = F.min("v"), F.max("v")
    cuts = hit.groupBy("i").agg((lo + (hi - lo) * F.max("f")).alias("cut"))
    return cuts.agg(F.array_sort(F.collect_set("cut")).alias("cuts"))


def bin_of(x: Column, cuts: Column) -> Column:
    """How many cut points are at most x."""
    return F.size(F.filter(cuts, lambda c: c <= x))


def label_ranks(rows: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label, n, rank): labels of each ``by`` from the rarest on, ties by label; the window runs over distinct labels."""
    n = rows.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("n", label)))


def group_strata(rows: DataFrame, group: str, by: str, label: str) -> DataFrame:
    """Each group's stratum ``by|label`` by the rarest label among its rows, rarity counted within ``by``."""
    ranked = rows.select(group, by, label).distinct().join(label_ranks(rows, by, label), [by, label])
    return ranked.groupBy(group).agg(F.min_by(F.concat_ws("|", F.col(by), F.col(label)), F.struct("rank", by)).alias("stratum"))


def share_report(rows: DataFrame, stratum: str, chosen: Column, num: int, den: int) -> DataFrame:
    """Per stratum its rows, chosen rows, and whether the share is within 2 points of num / den."""
    t = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.sum(chosen.cast("int")).alias("n_chosen"))
    off = F.abs(F.col("n_chosen") * den - F.col("n") * num) * 50
    return t.withColumn("within", off <= F.col("n") * den)


def gap_report(df: DataFrame, by: str, number: str, cap: int) -> DataFrame:
    """Per ``by``: distinct ids, gaps, gaps of more than ``cap`` missing ids, ids missing in the others, and runs."""
    ids = previous(df.select(by, number).distinct(), [by], number, "_prev")
    d = ids.withColumn("missing", F.col(number) - F.col("_prev") - 1)
    gap = F.col("missing") > 0
    small = gap & (F.col("missing") <= cap)
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("gaps"), F.count_if(F.col("missing") > cap).alias("gaps_over"),
        F.coalesce(F.sum(F.when(small, F.col("missing"))), F.lit(0)).alias("missing_small"), (F.count_if(gap) + 1).alias("runs"),
    )


def close_numbers(df: DataFrame, by: str, number: str, span: int) -> DataFrame:
    """(by, a, b): distinct whole numbers of one ``by`` with 1 <= b - a <= span.

    Joined on bins of ``span`` numbers, each a meeting its own and the next bin: at most span partners for each number.
    """
    ids = df.select(by, F.col(number).cast("long").alias("b")).distinct().withColumn("_bin", F.floor(F.col("b") / span))
    left = ids.select(by, F.col("b").alias("a"), F.explode(F.array("_bin", F.col("_bin") + 1)).alias("_bin"))
    return left.join(ids, [by, "_bin"]).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= span)).select(by, "a", "b")
