"""Accounts: counts by client and split, audits of budgets and rounds, means of model arrays, capacities and rates with states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.checks import violations


def client_counts(adopted: DataFrame, clients: DataFrame, names: list[str], unit: str, n_defects: str) -> DataFrame:
    """(client, n_total, n_defect, n_normal) for all ``names``; a unit without a client, or of another client, is an error."""
    j = adopted.select(unit, n_defects).join(clients.select(unit, "client"), unit, "left")
    ok = F.assert_true(F.coalesce(F.col("client").isin(names), F.lit(False)), "a unit without a known client").isNull()
    n = j.where(ok).groupBy("client").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col(n_defects) > 0).alias("n_defect"))
    grid = adopted.sparkSession.createDataFrame([(x,) for x in names], "client string")
    out = grid.join(n, "client", "left").fillna(0)
    return out.select("client", "n_total", "n_defect", (F.col("n_total") - F.col("n_defect")).alias("n_normal"))


def count_faults(counts: DataFrame, adopted: DataFrame, discarded: DataFrame, n_generated: int, unit: str) -> DataFrame:
    """(check, key) where declared ``counts`` (client, n_total, n_defect, n_normal) and ``discarded`` (stage, n) do not add up.

    parts: defect and normal are not the total; rows: the totals are not the adopted rows; units: a unit adopted twice; discarded: the
    stages are not the rest of ``n_generated``; negative: a number below 0.
    """
    n = adopted.agg(F.count(F.lit(1)).alias("n"))  # one row
    total = counts.agg(F.coalesce(F.sum("n_total"), F.lit(0)).alias("t")).crossJoin(n).where("t <> n").select(F.lit("all").alias("k"))
    gone = discarded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("g")).crossJoin(n).where(F.col("g") != n_generated - F.col("n")).select(F.lit("all").alias("k"))
    return violations({
        "parts": counts.where("n_defect + n_normal <> n_total").select("client"), "rows": total,
        "units": adopted.groupBy(unit).count().where("count > 1").select(unit), "discarded": gone,
        "negative": counts.where("least(n_total, n_defect, n_normal) < 0").select("client").union(discarded.where("n < 0").select("stage")),
    })


def counts_by(df: DataFrame, by: list[str], defect: Column) -> DataFrame:
    """Per ``by`` (null is a value) total, defect and normal rows."""
    bad = F.coalesce(defect, F.lit(False)).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(bad).alias("defect"), F.sum(1 - bad).alias("normal"))


def crosstab_reasons(df: DataFrame, bucket: Column, reasons: str) -> DataFrame:
    """(bucket, reason, n): rows of a bucket (null: n/a) in which a reason occurs, each reason once a row."""
    each = df.select(F.coalesce(bucket, F.lit("n/a")).alias("bucket"), F.explode(F.array_distinct(reasons)).alias("reason"))
    return each.groupBy("bucket", "reason").agg(F.count(F.lit(1)).alias("n"))


def qa_capacity(rows: DataFrame, variants: dict[str, Column], lineage: str, facets: str, per_passage: int, least: int) -> DataFrame:
    """(variant, without, passages, upper, facet_upper, short): upper bounds of questions for each variant, whole (without is null) and without
    each lineage: the whole less the lineage's own sums, so rows are summed once.
    """
    flags = F.array(*[F.struct(F.lit(k).alias("variant"), F.coalesce(c, F.lit(False)).alias("in")) for k, c in variants.items()])
    bound = F.least(F.lit(per_passage), F.coalesce(F.size(facets), F.lit(0)))
    each = rows.select(F.col(lineage).alias("_l"), bound.alias("_b"), F.inline(flags))
    per = each.groupBy("variant", "_l").agg(F.count_if("in").alias("n"), F.sum(F.when(F.col("in"), F.col("_b")).otherwise(0)).alias("f"))
    whole = per.groupBy("variant").agg(F.sum("n").alias("tn"), F.sum("f").alias("tf"))
    out = whole.select("variant", F.lit(None).cast(rows.schema[lineage].dataType).alias("without"), F.col("tn").alias("passages"), F.col("tf").alias("facet_upper"))
    out = out.union(per.join(whole, "variant").select("variant", "_l", F.col("tn") - F.col("n"), F.col("tf") - F.col("f")))
    return out.select("variant", "without", "passages", (F.col("passages") * per_passage).alias("upper"), "facet_upper", F.greatest(F.lit(0), least - F.col("passages")).alias("short"))


def disparity(gains: DataFrame) -> DataFrame:
    """One row from gain_report(): population deviations of both sides over clients that have both, and the change; 0 below two clients."""
    t = gains.where("state = 'both'").agg(F.count(F.lit(1)).alias("clients"), F.stddev_pop("a").alias("solo_sd"), F.stddev_pop("b").alias("fed_sd"))
    z = lambda c: F.when(F.col("clients") > 1, F.col(c)).otherwise(F.lit(0.0))
    return t.select("clients", z("solo_sd").alias("solo_sd"), z("fed_sd").alias("fed_sd"), (z("fed_sd") - z("solo_sd")).alias("change"))


def trajectory(ledger: DataFrame, solo: DataFrame, cell: str, metric: str) -> DataFrame:
    """(round, clients, mean_gain, bytes): the mean gain over a client's own value in each round, and all bytes sent up to it."""
    mine = ledger.where((F.col("cell") == cell) & (F.col("metric_name") == metric)).join(solo, "client_id")
    g = mine.groupBy("round").agg(F.count_distinct("client_id").alias("clients"), F.avg(F.col("metric_value") - F.col("solo")).alias("mean_gain"), F.sum(F.col("bytes_up") + F.col("bytes_down")).alias("_b"))
    from pyspark.sql import Window as W

    # Rounds are few: their sums are one window.
    return g.select("round", "clients", "mean_gain", F.sum("_b").over(W.orderBy("round")).alias("bytes"))


def attributed(values: DataFrame, clients: DataFrame, unit: str) -> DataFrame:
    """(client, unit, value) of units that have a client; the lists by client stay rows."""
    return values.join(clients.select(unit, "client"), unit).where("client is not null").select("client", unit, "value")


def last_values(rows: DataFrame, cell: str, metric: str, at_round: int | None = None) -> DataFrame:
    """(client_id, value, round): per client the value of its highest round (or of ``at_round``); of equal rounds the row of highest ``seq``.

    Rounds and values are text; rows in which either cannot be read are left out.
    """
    r = rows.where((F.col("cell") == cell) & (F.col("metric_name") == metric)).withColumn("_r", F.col("round").try_cast("long")).withColumn("_v", F.col("metric_value").try_cast("double"))
    r = r.where("_r is not null and _v is not null and client_id is not null")
    r = r if at_round is None else r.where(F.col("_r") == at_round)
    return r.groupBy("client_id").agg(F.max_by(F.struct("_v", "_r"), F.struct("_r", "seq")).alias("b")).select("client_id", F.col("b._v").alias("value"), F.col("b._r").alias("round"))


def indicator_rates(rows: DataFrame, indicators: dict[str, tuple[Column, Column]], weight: str) -> DataFrame:
    """(indicator, weighted, unweighted, n_eligible, state): of rows for which the second condition holds the share for which the first does too.

    not_applicable: no such row, or no weight.
    """
    t = lambda c: F.coalesce(c, F.lit(False))
    each = F.array(*[F.struct(F.lit(k).alias("indicator"), (t(n) & t(d)).alias("n"), t(d).alias("d")) for k, (n, d) in indicators.items()])
    g = rows.select(F.col(weight).cast("double").alias("w"), F.inline(each)).groupBy("indicator").agg(
        F.coalesce(F.sum(F.when(F.col("n"), F.col("w"))), F.lit(0.0)).alias("wn"), F.coalesce(F.sum(F.when(F.col("d"), F.col("w"))), F.lit(0.0)).alias("wd"), F.count_if("n").alias("cn"), F.count_if("d").alias("cd")
    )
    over = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    state = F.when((F.col("cd") == 0) | (F.col("wd") == 0), "not_applicable").otherwise("finite")
    return g.select("indicator", over("wn", "wd").alias("weighted"), over("cn", "cd").alias("unweighted"), F.col("cd").alias("n_eligible"), state.alias("state"))


def federated_mean(arrays: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, i, value): elementwise mean of the clients' arrays, weighted by examples; arrays of whole numbers (``integral``) give the largest.

    arrays: (client, key, integral, values); weights: (client, examples).  Errors: no examples at all, a value that is not finite, and arrays
    of a key that differ in length or are missing for a client.  Summed in the order of clients, so the sum of doubles is the same each time.
    """
    n = weights.agg(F.sum("examples").alias("_n"), F.count(F.lit(1)).alias("_k"))  # one row
    e = arrays.join(weights, "client").select("client", "key", "integral", "examples", F.size("values").alias("_len"), F.posexplode("values").alias("i", "x"))
    bad = F.assert_true(F.coalesce(F.abs("x") < float("inf"), F.lit(False)), "a value that is not finite").isNull()
    g = e.where(bad).groupBy("key", "i").agg(
        F.array_sort(F.collect_list(F.struct("client", "x", "examples"))).alias("a"), F.max("x").alias("top"), F.max("integral").alias("integral"), F.min("_len").alias("lo"), F.max("_len").alias("hi")
    ).crossJoin(F.broadcast(n))
    ok = F.assert_true((F.col("lo") == F.col("hi")) & (F.size("a") == F.col("_k")), "arrays of different shape").isNull() & F.assert_true(F.col("_n") > 0, "no examples").isNull()
    mean = F.aggregate("a", F.lit(0.0), lambda acc, s: acc + s["x"] * (s["examples"] / F.col("_n")))
    return g.where(ok).select("key", "i", F.when(F.col("integral"), F.col("top")).otherwise(mean).alias("value"))


def norm_fault(arrays: DataFrame, mean: DataFrame, slack: float = 1e-6) -> DataFrame:
    """(global_norm, largest, ok): no mean is longer than the longest of what it is made of."""
    own = arrays.select("client", F.explode("values").alias("x")).groupBy("client").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n")).agg(F.max("n").alias("largest"))
    g = mean.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("global_norm"))
    return g.crossJoin(own).withColumn("ok", F.col("global_norm") <= F.col("largest") * (1 + slack))  # one row each


def buffer_divergence(arrays: DataFrame) -> DataFrame:
    """(key, distance): the mean Euclidean distance of each two clients' arrays of a key; clients are few, so their pairs are made."""
    e = arrays.select("client", "key", F.posexplode("values").alias("i", "x"))
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.client") < F.col("b.client")))
    d = F.col("a.x") - F.col("b.x")
    pairs = j.groupBy(F.col("a.key").alias("key"), F.col("a.client").alias("ca"), F.col("b.client").alias("cb")).agg(F.sqrt(F.sum(d * d)).alias("d"))
    return pairs.groupBy("key").agg(F.avg("d").alias("distance"))


def round_replies(replies: DataFrame, expected: int, digest: str) -> DataFrame:
    """(round, state): error (a reply failed), missing (not ``expected`` replies with content), no_digest, digest (another one), else ok.

    A round that is not ok must not be averaged: the weights of those left would be made anew.
    """
    t = replies.groupBy("round").agg(
        F.bool_or(F.col("error").isNotNull()).alias("e"), F.count_if(F.col("error").isNull() & F.col("content")).alias("n"),
        F.bool_or(F.col("error").isNull() & F.col("content") & (F.coalesce("digest", F.lit("")) == "")).alias("none"), F.bool_or(F.col("error").isNull() & F.col("content") & (F.col("digest") != digest)).alias("other"),
    )
    state = F.when(F.col("e"), "error").when(F.col("n") != expected, "missing").when(F.col("none"), "no_digest").when(F.col("other"), "digest").otherwise("ok")
    return t.select("round", state.alias("state"))


def budget_faults(cells: DataFrame, rounds: int, clients: list[str], epochs: int, stubs: list[str]) -> DataFrame:
    """(check, key) of a ledger of cells (round, client, epochs_ran, epochs_here, stopper_true, stopper_class, stopper_calls, weight, unit,
    examples, tokens, optimizer, arg_optimizer) against ``rounds`` of ``epochs`` for each client.

    missing, epochs, total (a client's epochs are not all), stopped, stopper, calls (fewer than epochs run here), weight (not positive), units
    (several), unit (unknown, or not the value the weight has), optimizers (several), auto, optimizer (not the one asked for).
    """
    key = F.concat_ws("/", F.col("round").cast("string"), "client")
    spark = cells.sparkSession
    grid = spark.range(rounds).select(F.col("id").alias("round"), F.explode(F.array(*[F.lit(c) for c in clients])).alias("client"))
    at = lambda cond: cells.where(F.coalesce(cond, F.lit(False))).select(key.alias("k"))
    here = F.coalesce("epochs_here", "epochs_ran")
    means = F.when(F.col("unit") == "tokens", F.col("tokens")).when(F.col("unit") == "examples", F.col("examples")).cast("double")
    totals = grid.select("client").distinct().join(cells.groupBy("client").agg(F.sum("epochs_ran").alias("t")), "client", "left").where(F.coalesce("t", F.lit(0)) != rounds * epochs).select("client")
    several = lambda c: cells.where(F.col(c).isNotNull()).agg(F.count_distinct(c).alias("n")).where("n > 1").select(F.lit("all").alias("k"))
    start = F.lower(F.substr("arg_optimizer", F.lit(1), F.lit(3)))
    return violations({
        "missing": grid.join(cells.select("round", "client").distinct(), ["round", "client"], "left_anti").select(key.alias("k")), "epochs": at(F.col("epochs_ran") != epochs), "total": totals,
        "stopped": at(F.col("stopper_true") > 0), "stopper": at(~F.col("stopper_class").isin(stubs)), "calls": at(F.col("stopper_calls") < here), "weight": at(F.col("weight") <= 0), "units": several("unit"),
        "unit": at(F.col("weight").isNotNull() & F.col("unit").isNotNull() & (means.isNull() | (F.abs(F.col("weight") - means) > 1e-6))), "optimizers": several("optimizer"),
        "auto": at(F.lower("arg_optimizer") == "auto"), "optimizer": at(F.col("optimizer").isNotNull() & F.col("arg_optimizer").isNotNull() & ~F.lower("optimizer").startswith(start)),
    })


def metric_summaries(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, mean, sd, least, most) over seeds of each metric's values that are there; sd is null below two."""
    each = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))).where("v is not null")
    return each.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))


def merged_segments(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of segments by ``key``: of equal keys the row of the last segment that has one.  All have the first one's columns."""
    cols = parts[0].columns
    for p in parts:
        if p.columns != cols:
            raise ValueError(f"columns {p.columns}; expected {cols}")
    each = reduce(DataFrame.union, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return each.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("_part")).alias("r")).select("r.*")


def stage_rates(rows: DataFrame, axis: str, place: str) -> DataFrame:
    """(axis, n_in, n_accepted, rate): what the last stage that ran passed, of what came in.  rows: (axis, place, n_in, n_pass), a null
    n_pass for a stage that did not run."""
    first = F.min_by("n_in", place)
    last = F.max_by("n_pass", F.when(F.col("n_pass").isNotNull(), F.col(place)))
    g = rows.groupBy(axis).agg(first.alias("n_in"), last.alias("n_accepted"))
    return g.withColumn("rate", F.when(F.col("n_in") > 0, F.col("n_accepted") / F.col("n_in")))


def band_report(rows: DataFrame, stratum: str, group: str, chosen: Column, target: float) -> DataFrame:
    """(stratum, n, n_chosen, share, band, ok): whether a stratum's share is within its band of ``target``: 2 points, or the part of the stratum
    that its largest group is, since groups are not split."""
    g = rows.groupBy(stratum, group).agg(F.count(F.lit(1)).alias("k"), F.count_if(chosen).alias("c"))
    t = g.groupBy(stratum).agg(F.sum("k").alias("n"), F.sum("c").alias("n_chosen"), F.max("k").alias("_m"))
    share, band = F.col("n_chosen") / F.col("n"), F.greatest(F.lit(0.02), F.col("_m") / F.col("n"))
    return t.select(stratum, "n", "n_chosen", share.alias("share"), band.alias("band"), (F.abs(share - target) <= band).alias("ok"))


def heatmap(rows: DataFrame, fixed: str, joined: str, column: str, names: list[str], other: str) -> DataFrame:
    """Counts of (fixed, each label of a ;-joined column) with a column for each of ``names`` and one for nulls (``other``)."""
    each = rows.select(F.col(fixed), F.explode(F.filter(F.split(F.coalesce(joined, F.lit("")), ";"), lambda x: x != "")).alias("label"), F.coalesce(column, F.lit(other)).alias("_c"))
    return each.groupBy(fixed, "label").pivot("_c", [*names, other]).agg(F.count(F.lit(1))).fillna(0)


def eval_groups(rows: DataFrame, group: str, unit: str, material: str, n: str) -> DataFrame:
    """(group, n_units, total, material): groups of evaluation rows; several materials in one, or a number that cannot be read, is an error."""
    whole = F.col(n).try_cast("long")
    ok = F.assert_true(F.coalesce(whole >= 0, F.lit(False)), "a number of defects that cannot be read").isNull()
    g = rows.where(ok).groupBy(group).agg(F.count(unit).alias("n_units"), F.sum(whole).alias("total"), F.min(material).alias("material"), F.max(material).alias("_m"))
    return g.where(F.assert_true(F.col("material") == F.col("_m"), "a group of several materials").isNull()).drop("_m")
