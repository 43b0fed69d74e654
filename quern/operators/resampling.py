"""Resampling by groups: draws with replacement, intervals of order statistics, and the verdicts that follow from them.

A draw is a table (draw, [stratum,] group, m): how often a draw takes a group.  Statistics are sums, so groups are summed once and draws
multiply the sums.  Picks are hashes that any engine with SHA-256 repeats.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scalars as S

STATES = ("finite", "pos_inf", "neg_inf", "absent")


def stratum_draws(groups: DataFrame, stratum: str, group: str, draws: int, seed: str) -> DataFrame:
    """(draw, stratum, group, m): each draw picks as many groups of a stratum, with replacement, as it has.

    Groups of a stratum are numbered in seeded hash order; pick i of a draw takes the one whose number is a hash of (stratum, draw, i)
    modulo their number.
    """
    g = groups.select(stratum, group).distinct()
    key = S.order_key(seed, F.col(group))
    numbered = g.withColumn("_k", F.row_number().over(W.partitionBy(stratum).orderBy(key, group)) - 1)
    n = g.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    each = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    hexes = F.substr(F.sha2(F.concat_ws("|", F.lit(seed), F.col(stratum).cast("string"), F.col("draw").cast("string"), F.col("_i").cast("string")), 256), F.lit(1), F.lit(12))
    picks = each.select("draw", stratum, (F.conv(hexes, 16, 10).cast("long") % F.col("_n")).cast("int").alias("_k")).groupBy("draw", stratum, "_k").agg(F.count(F.lit(1)).alias("m"))
    return picks.join(numbered, [stratum, "_k"]).select("draw", stratum, group, "m")


def design_faults(units: DataFrame, side: DataFrame, unit: str, group: str, stratum: str) -> DataFrame:
    """(check, key): units without a side row or a group, groups in several strata, strata whose drawn groups are not n_h."""
    j = units.select(unit, group).join(side.select(unit, stratum, "n_h"), unit, "left")
    fault = lambda df, name, key: df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key")).distinct()
    per = j.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count_distinct(group).alias("n"), F.min("n_h").alias("lo"), F.max("n_h").alias("hi"))
    several = j.groupBy(group).agg(F.count_distinct(stratum).alias("n")).where("n > 1")
    out = fault(j.where(F.col(stratum).isNull()), "no side row", unit).union(fault(j.where(F.col(group).isNull()), "no group", unit))
    return out.union(fault(several, "group in several strata", group)).union(fault(per.where("n <> lo or n <> hi"), "n_h differs", stratum))


def draw_weights(draws: DataFrame, units: DataFrame, side: DataFrame, unit: str, group: str) -> DataFrame:
    """(draw, unit, weight): the multiplicity of a unit's group times G_h / n_h; units of groups that a draw does not take have no row."""
    w = units.select(unit, group).join(side.select(unit, (F.col("G_h") / F.col("n_h")).alias("_w")), unit)
    return draws.join(w, group).select("draw", unit, (F.col("m") * F.col("_w")).alias("weight"))


def weighted_macro_f1(counts: DataFrame, weights: DataFrame, unit: str, label: str, labels: list[str], by: list[str]) -> DataFrame:
    """Per ``by`` (columns of ``weights``) the macro F1 over a fixed list of labels; null if any of them has no support."""
    t = counts.where(F.col(label).isin(labels)).join(weights, unit).groupBy(*by, label).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.when(F.col("tp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return t.withColumn("_f", f1).groupBy(*by).agg(F.when(F.count("_f") == len(labels), F.avg("_f")).alias("macro_f1"))


def state_of(x: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(x.isNull(), "absent").when(x == inf, "pos_inf").when(x == -inf, "neg_inf").otherwise("finite")


def half_width(lo: Column, hi: Column) -> tuple[Column, Column]:
    """(value, state) of half the distance of two ends: absent if one is, undefined between equal infinities, infinite with one."""
    a, b = state_of(lo), state_of(hi)
    state = F.when((a == "absent") | (b == "absent"), "absent").when((a == "finite") & (b == "finite"), "finite").when(a == b, "undefined").otherwise("infinite")
    return F.when(state == "finite", (hi - lo) / 2), state


def rank_intervals(draws: DataFrame, by: list[str], value: str, permille: int = 25) -> DataFrame:
    """(by, lo, lo_state, hi, hi_state, half_width, half_state, n): the draws of rank k = floor((n - 1) * permille / 1000) from both ends.

    No interpolation, infinities are values.  NaN is an error; null draws are none.  A group of ``by`` without draws is absent.  The draws
    of one group (some thousands, a parameter of the resampling) are sorted together.
    """
    v = F.col(value).cast("double")
    checked = F.when(F.assert_true(F.coalesce(~F.isnan(v), F.lit(True)), "a draw is NaN").isNull(), v)
    t = draws.groupBy(*by).agg(F.sort_array(F.collect_list(checked)).alias("x")).withColumn("n", F.size("x"))
    k = F.floor((F.col("n") - 1) * permille / 1000).cast("int")
    end = lambda i: F.when(F.col("n") > 0, F.get("x", i))
    t = t.select(*by, "n", end(k).alias("_lo"), end(F.col("n") - 1 - k).alias("_hi"))
    width, state = half_width(F.col("_lo"), F.col("_hi"))
    finite = lambda c: F.when(state_of(F.col(c)) == "finite", F.col(c))
    return t.select(*by, finite("_lo").alias("lo"), state_of(F.col("_lo")).alias("lo_state"), finite("_hi").alias("hi"), state_of(F.col("_hi")).alias("hi_state"), width.alias("half_width"), state.alias("half_state"), "n")


def defined_intervals(draws: DataFrame, by: list[str], value: str, permille: int = 25) -> DataFrame:
    """``rank_intervals`` of a statistic that is undefined (NaN) for some draws: these are left out and counted; infinities are errors."""
    v = F.col(value).cast("double")
    ok = F.assert_true(F.coalesce(F.abs(v) < float("inf"), F.lit(True)) | F.coalesce(F.isnan(v), F.lit(False)), "a draw is infinite")
    d = draws.withColumn(value, F.when(ok.isNull() & ~F.isnan(v), v))
    out = rank_intervals(d, by, value, permille)
    return out.join(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_draws")), by).withColumn("n_undefined", F.col("n_draws") - F.col("n")).drop("n_draws")


def percentile_intervals(draws: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """(by, lo, hi, n, n_undefined): linearly interpolated percentiles of the defined draws."""
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    t = draws.groupBy(*by).agg(F.percentile(x, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.count(x).alias("n"), F.count(F.lit(1)).alias("draws"))
    return t.select(*by, F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "n", (F.col("draws") - F.col("n")).alias("n_undefined"))


def equivalence(intervals: DataFrame, clusters: DataFrame, by: list[str], margin: float, least: int = 20) -> DataFrame:
    """Intervals of a difference with a verdict: undecided with fewer than ``least`` clusters, equivalent strictly inside +-margin."""
    inside = (F.col("lo") > -margin) & (F.col("hi") < margin)
    verdict = F.when(F.col("clusters") < least, "undecided").when(F.coalesce(inside, F.lit(False)), "equivalent").otherwise("not_equivalent")
    return intervals.join(clusters, by).withColumn("verdict", verdict)


def lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return scale * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(p: float, df: int) -> float:
    """Where the chi-square distribution reaches p, by bisection."""
    lo, hi = 0.0, max(1.0, 2.0 * df)
    while lower_gamma(df / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower_gamma(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def c4(n: int) -> float:
    """The expectation of a sample deviation of n normal values, in units of the true one."""
    return math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2))


def sd_diagnostics(values: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """(by, n, sd, unbiased, lo, hi, cv, reliable): a sample deviation, without its bias, its chi-square interval, its own relative deviation.

    reliable: at least ten values.  Below two values all but n is null.  Constants are made for each number of values that occurs.
    """
    t = values.groupBy(*by).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"))
    sizes = [r["n"] for r in t.where("n > 1").select("n").distinct().limit(10_001).collect()]
    if len(sizes) > 10_000:
        raise ValueError("more than 10,000 different numbers of values")
    made = [(n, c4(n), math.sqrt((n - 1) / chi2_quantile(1 - alpha / 2, n - 1)), math.sqrt((n - 1) / chi2_quantile(alpha / 2, n - 1))) for n in sizes]
    k = values.sparkSession.createDataFrame(made, "n long, _c double, _lo double, _hi double")
    sd, c = F.col("sd"), F.col("_c")
    out = t.join(F.broadcast(k), "n", "left")
    return out.select(*by, "n", "sd", (sd / c).alias("unbiased"), (sd * F.col("_lo")).alias("lo"), (sd * F.col("_hi")).alias("hi"), (F.sqrt(1 - c * c) / c).alias("cv"), (F.col("n") >= 10).alias("reliable"))


def denominator_verdict(rows: DataFrame, by: list[str], most: float = 0.25) -> DataFrame:
    """``rows`` (by, central, local, sd, half_width) with D = central - local, tripwire (D > 0 and D >= 3 sd) and reportable.

    reportable: false without the tripwire; else null without a half width; else whether it is at most ``most``.  A null sd counts 0.
    """
    d = F.col("central") - F.col("local")
    trip = F.coalesce((d > 0) & (d >= 3 * F.coalesce("sd", F.lit(0.0))), F.lit(False))
    ok = F.when(~trip, F.lit(False)).when(F.col("half_width").isNull(), F.lit(None)).otherwise(F.col("half_width") <= most)
    return rows.select(*by, d.alias("d"), trip.alias("tripwire"), ok.alias("reportable"))


def classify_draws(seeds: DataFrame, draws: DataFrame, draw: str = "draw") -> DataFrame:
    """(draw, value, state): the mean recovery of a draw over its seeds, or why it has none.

    seeds: (draw, seed, fed, central, local), local the mean of the local values; draws: (draw, support).  In order: excluded_support,
    numerator_zero (a seed with central <= local and fed = local), sign_conflict (infinities of both signs), pos_inf, neg_inf, finite.
    """
    num, den = F.col("fed") - F.col("local"), F.col("central") - F.col("local")
    fail = den <= 0
    r = F.when(fail & (num > 0), F.lit(float("inf"))).when(fail & (num < 0), F.lit(float("-inf"))).when(~fail, num / den)
    g = seeds.groupBy(draw).agg(
        F.bool_or(fail & (num == 0)).alias("_zero"), F.bool_or(fail & (num > 0)).alias("_pos"), F.bool_or(fail & (num < 0)).alias("_neg"), F.avg(F.when(~fail, r)).alias("_mean")
    )
    state = (
        F.when(~F.coalesce("support", F.lit(False)), "excluded_support").when(F.col("_zero"), "numerator_zero").when(F.col("_pos") & F.col("_neg"), "sign_conflict")
        .when(F.col("_pos"), "pos_inf").when(F.col("_neg"), "neg_inf").otherwise("finite")
    )
    value = F.when(state == "pos_inf", F.lit(float("inf"))).when(state == "neg_inf", F.lit(float("-inf"))).when(state == "finite", F.col("_mean"))
    return g.join(draws, draw).select(draw, value.alias("value"), state.alias("state"))


def paired_recovery(sums: DataFrame, draws: DataFrame, group: str) -> DataFrame:
    """(draw, recovery): the same groups for all cells and seeds of a draw.

    sums: (group, seed, role, client, num, den) with role central, fed or local; a cell's value is sum(m * num) / sum(m * den).  A seed
    whose central value does not exceed the mean of the locals has no recovery, and a draw with such a seed none.
    """
    v = draws.join(sums, group).groupBy("draw", "seed", "role", "client").agg((F.sum(F.col("m") * F.col("num")) / F.sum(F.col("m") * F.col("den"))).alias("v"))
    of = lambda role: F.avg(F.when(F.col("role") == role, F.col("v")))
    s = v.groupBy("draw", "seed").agg(of("central").alias("c"), of("fed").alias("f"), of("local").alias("l"))
    r = F.when(F.col("c") > F.col("l"), (F.col("f") - F.col("l")) / (F.col("c") - F.col("l")))
    return s.groupBy("draw").agg(F.when(F.count(r) == F.count(F.lit(1)), F.avg(r)).alias("recovery"))


def rate_differences(rows: DataFrame, draws: DataFrame, group: str, side: Column, hit: Column) -> DataFrame:
    """(draw, a, b, difference): in each draw the rate of ``hit`` where ``side`` holds, where it does not, and the difference.

    Null where a draw has no rows of a side.
    """
    s = rows.groupBy(group).agg(*[F.sum(F.when(c, v).otherwise(F.lit(0))).alias(n) for n, c, v in (("_ah", side & hit, 1), ("_an", side, 1), ("_bh", ~side & hit, 1), ("_bn", ~side, 1))])
    t = draws.join(s, group).groupBy("draw").agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in ("_ah", "_an", "_bh", "_bn")])
    rate = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    a, b = rate("_ah", "_an"), rate("_bh", "_bn")
    return t.select("draw", a.alias("a"), b.alias("b"), (a - b).alias("difference"))


def holdout(groups: DataFrame, group: str, fraction: float, seed: str) -> DataFrame:
    """The groups held out: the first max(1, round(fraction * n)) (halves to even) of the distinct ones in seeded hash order."""
    g = groups.select(group).distinct()
    n = g.count()
    k = max(1, round(fraction * n)) if n else 0
    return g.orderBy(S.order_key(seed, F.col(group)), group).limit(k)


def merge_errors(rows: DataFrame, found: str, truth: str) -> DataFrame:
    """One row: pairs that are together in ``found``, in ``truth``, in both; under: only in truth, over: only found.  Counted, not made."""
    def pairs(*by: str) -> DataFrame:
        n = F.col("n")
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("p"))
    a, b, c = pairs(found).withColumnRenamed("p", "found"), pairs(truth).withColumnRenamed("p", "truth"), pairs(found, truth).withColumnRenamed("p", "both")
    return a.crossJoin(b).crossJoin(c).select("found", "truth", "both", (F.col("truth") - F.col("both")).alias("under"), (F.col("found") - F.col("both")).alias("over"))  # one row each


def best_prefix(cells: DataFrame, by: list[str], cell: str, n: str, positive: str, least: int) -> DataFrame:
    """(by, cells, f1): of a class's cells with at least ``least`` rows, ordered by the share of positives (ties by cell), the prefix with the
    best F1 of calling all its rows positive; ties to the shorter.  Cells of a class are few (bins), so they are one window.
    """
    total = cells.groupBy(*by).agg(F.sum(positive).alias("_t"))
    ok = cells.where(F.col(n) >= least).join(total, by)
    w = W.partitionBy(*by).orderBy((F.col(positive) / F.col(n)).desc(), cell)
    run = ok.select(*by, F.row_number().over(w).alias("k"), F.sum(n).over(w).alias("_n"), F.sum(positive).over(w).alias("_p"), "_t")
    f1 = F.when(F.col("_n") + F.col("_t") > 0, 2 * F.col("_p") / (F.col("_n") + F.col("_t"))).otherwise(F.lit(0.0))
    run = run.withColumn("f1", f1)
    return run.groupBy(*by).agg(F.max_by(F.struct("k", "f1"), F.struct("f1", -F.col("k"))).alias("b")).select(*by, F.col("b.k").alias("cells"), "b.f1")
