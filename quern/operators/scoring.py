"""Set scores, ranking scores and resampled intervals over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.ordered import hash_place, spread, sum_before


def count_table(gold: DataFrame, predicted: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, label, tp, fp, fn) from two tables of distinct (unit, label)."""
    g, p = gold.select(unit, label).distinct().withColumn("g", F.lit(1)), predicted.select(unit, label).distinct().withColumn("p", F.lit(1))
    both = g.join(p, [unit, label], "full")
    one = lambda c: c.cast("int")
    has_g, has_p = F.col("g").isNotNull(), F.col("p").isNotNull()
    return both.select(unit, label, one(has_g & has_p).alias("tp"), one(~has_g & has_p).alias("fp"), one(has_g & ~has_p).alias("fn"))


def label_scores(counts: DataFrame, label: str, weight: Column | None = None) -> DataFrame:
    """Per label: tp, fp, fn, support and F1 as 2tp / (2tp + fp + fn); null without support."""
    w = F.lit(1) if weight is None else weight
    t = counts.groupBy(label).agg(*[F.sum(F.col(c) * w).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.when(F.col("tp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return t.select(label, "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), f1.alias("f1"))


def unit_jaccard(counts: DataFrame, unit: str, population: DataFrame | None = None) -> DataFrame:
    """(unit, jaccard); with ``population`` also for its units that neither side names: two empty sets are equal, 1.0."""
    found = counts.groupBy(unit).agg((F.sum("tp") / F.sum(F.col("tp") + F.col("fp") + F.col("fn"))).alias("jaccard"))
    if population is None:
        return found
    return population.select(unit).distinct().join(found, unit, "left").select(unit, F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


def f1_by(counts: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, macro_f1 over labels with support, micro_f1, micro_recall, labels); null where nothing has support."""
    t = counts.groupBy(*by, label).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(tp + fn > 0, 2 * tp / (2 * tp + fp + fn))
    over = lambda n, m: F.when(m > 0, n / m)
    return t.groupBy(*by).agg(
        F.avg(f1).alias("macro_f1"), over(F.sum(2 * tp), F.sum(2 * tp + fp + fn)).alias("micro_f1"), over(F.sum(tp), F.sum(tp + fn)).alias("micro_recall"), F.count_if(tp + fn > 0).alias("labels")
    )


def stratified(units: DataFrame, gold: DataFrame, predicted: DataFrame, unit: str, stratum: str, label: str) -> DataFrame:
    """(stratum, size, pure, majority, macro_f1, baseline, lift): the model's macro F1 in each stratum of ``units`` (unit, stratum), and
    that of predicting the stratum's most frequent gold set (sorted, joined by ;, ties to the smaller text) for all its units.

    pure: all units have one set, so nothing can be told apart.  Without any gold label in a stratum the scores are null.
    """
    codes = units.join(gold.select(unit, label).distinct(), unit, "left").groupBy(stratum, unit).agg(F.array_join(F.array_sort(F.collect_set(label)), ";").alias("codes"))
    n = codes.groupBy(stratum, "codes").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(stratum).agg(F.min_by("codes", F.struct(-F.col("n"), "codes")).alias("majority"), (F.count(F.lit(1)) == 1).alias("pure"), F.sum("n").alias("size"))
    each = units.join(best.select(stratum, "majority"), stratum).select(unit, F.explode(F.filter(F.split("majority", ";"), lambda x: x != "")).alias(label))

    def score(p: DataFrame, name: str) -> DataFrame:
        mine = lambda df: df.select(unit, label).distinct().join(units, unit)
        both = mine(gold).withColumn("a", F.lit(1)).join(mine(p).withColumn("b", F.lit(1)), [unit, stratum, label], "full")
        a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
        c = both.select(stratum, label, (a * b).alias("tp"), ((1 - a) * b).alias("fp"), (a * (1 - b)).alias("fn"))
        return f1_by(c, [stratum], label).select(stratum, F.col("macro_f1").alias(name))

    out = best.join(score(predicted, "macro_f1"), stratum, "left").join(score(each, "baseline"), stratum, "left")
    return out.withColumn("lift", F.col("macro_f1") - F.col("baseline"))


def label_frequencies(units: DataFrame, gold: DataFrame, unit: str, stratum: str, label: str, labels: list[str]) -> DataFrame:
    """(stratum, label, n_with, n): units of a stratum that have a label, for all labels."""
    n = units.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).select("*", F.explode(F.array(*[F.lit(x) for x in labels])).alias(label))
    some = gold.select(unit, label).distinct().join(units, unit).groupBy(stratum, label).agg(F.count(F.lit(1)).alias("n_with"))
    return n.join(some, [stratum, label], "left").select(stratum, label, F.coalesce("n_with", F.lit(0)).alias("n_with"), "n")


def average_precision(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """Non-interpolated average precision; rows of equal score count together, rows of null score not at all."""
    ties = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(positive).alias("pos"))
    wide, part = spread(ties, "s")
    order = [F.col("s").desc()]
    run = sum_before(sum_before(wide, [], -part, order, F.col("n"), "n0"), [], -part, order, F.col("pos"), "hits0")
    hits, n = F.col("hits0") + F.col("pos"), F.col("n0") + F.col("n")
    return run.agg((F.sum(F.col("pos") * hits / n) / F.sum("pos")).alias("ap"))


def crosstab(df: DataFrame, bucket: Column, passed: Column) -> DataFrame:
    """Per bucket (null: n/a) rows in, passed, failed and the pass rate to 4 places."""
    t = df.groupBy(F.coalesce(bucket, F.lit("n/a")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_in"), F.sum(passed.cast("int")).alias("n_pass"))
    return t.select("bucket", "n_in", "n_pass", (F.col("n_in") - F.col("n_pass")).alias("n_fail"), F.round(F.col("n_pass") / F.col("n_in"), 4).alias("pass_rate"))


def majority_set(df: DataFrame, by: str, unit: str, label: str) -> DataFrame:
    """Per ``by`` the most frequent set of labels of its units (as sorted text); ties go to the smaller text."""
    sets = df.groupBy(by, unit).agg(F.array_join(F.array_sort(F.collect_set(label)), ";").alias("codes"))
    n = sets.groupBy(by, "codes").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min_by(F.struct("codes", "n"), F.struct((-F.col("n")).alias("m"), F.col("codes"))).alias("b")).select(by, "b.codes", "b.n")


def draw_multiplicities(groups: DataFrame, group: str, draws: int, seed: str) -> DataFrame:
    """(draw, group, m): how often each draw takes each group, with replacement; groups that a draw does not take have no row.

    Each draw has as many picks as there are groups; pick i of a draw takes the group whose number, in seeded hash order, is a hash
    of (draw, i) modulo the number of groups, so any engine with SHA-256 can repeat it.
    """
    numbered = hash_place(groups.select(group).distinct(), [], group, seed).withColumn("k", F.col("place") - 1)
    n = groups.agg(F.count_distinct(group)).first()[0]
    if not n:
        return numbered.select(F.lit(0).cast("long").alias("draw"), group, F.col("place").alias("m"))
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("i").cast("string")), 256)
    pick = F.conv(F.substr(key, F.lit(1), F.lit(12)), 16, 10).cast("long") % n
    each = groups.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("i"))
    picks = each.select("draw", pick.alias("k")).groupBy("draw", "k").agg(F.count(F.lit(1)).alias("m"))
    return picks.join(numbered, "k").select("draw", group, "m")


def bootstrap_ratio(units: DataFrame, group: str, num: str, den: str, draws: int, seed: str) -> DataFrame:
    """Cluster bootstrap of sum(num) / sum(den): (draw, num, den) with whole groups drawn with replacement; groups are summed first."""
    sums = units.groupBy(group).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    taken = draw_multiplicities(sums, group, draws, seed).join(sums, group)
    return taken.groupBy("draw").agg(F.sum(F.col("m") * F.col("num")).alias("num"), F.sum(F.col("m") * F.col("den")).alias("den"))


def macro_f1_draws(counts: DataFrame, group: str, label: str, labels: list[str], draws: int, seed: str) -> DataFrame:
    """(draw, macro_f1) over a fixed list of labels, all drawn with the same groups; null if a draw leaves a label without support."""
    sums = counts.where(F.col(label).isin(labels)).groupBy(group, label).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    taken = draw_multiplicities(counts, group, draws, seed).join(sums, group)
    t = taken.groupBy("draw", label).agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.when(F.col("tp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return t.withColumn("f1", f1).groupBy("draw").agg(F.when(F.count("f1") == len(labels), F.avg("f1")).alias("macro_f1"))


def seed_spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per ``by`` the values' number, sample sd and coefficient of variation; null sd below two values."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), (F.stddev_samp(value) / F.avg(value)).alias("cv"))


def rank_interval(draws: DataFrame, value: str) -> DataFrame:
    """Order statistics without interpolation at ranks floor((n-1)*25/1000) and (n-1) minus it."""
    per = draws.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    wide, part = spread(per, "v")
    run = sum_before(wide, [], part, [F.col("v")], F.col("n"), "r")
    k = F.floor((F.col("total") - 1) * 25 / 1000)
    within = lambda at: F.max(F.when((F.col("r") <= at) & (at < F.col("r") + F.col("n")), F.col("v")))
    ranked = run.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total"))))  # one row
    return ranked.agg(within(k).alias("lo"), within(F.col("total") - 1 - k).alias("hi"))