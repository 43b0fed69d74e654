"""Further scores: F1 summaries, retrieval and citations, weighted estimates, threshold curves, client reports, ranked precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators.ordered import spread, sum_before


def ratio(num: Column, den: Column) -> Column:
    """num / den; null where den is 0."""
    return F.when(den != 0, num / den)


def f1_summary(scores: DataFrame) -> DataFrame:
    """macro F1 over labels with support and micro F1 over all, from label_scores()."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return scores.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.count_if(F.col("support") > 0).alias("labels"))


def two_by_two(df: DataFrame, by: list[str], gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn and tn of two conditions; null counts as false."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(predicted, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def stratum_weights(population: DataFrame, drawn: DataFrame, stratum: str) -> DataFrame:
    """(stratum, weight): population size by drawn size; strata without drawn rows are left out."""
    n, k = (x.groupBy(stratum).agg(F.count(F.lit(1)).alias(c)) for x, c in ((population, "n"), (drawn, "k")))
    return n.join(k, stratum).select(stratum, (F.col("n") / F.col("k")).alias("weight"))


def weighted_rates(rows: DataFrame, gold: Column, predicted: Column, weight: Column) -> DataFrame:
    """Weighted precision and recall to 4 places; null for an empty denominator."""
    s = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))
    t = rows.agg(s(gold & predicted).alias("tp"), s(~gold & predicted).alias("fp"), s(gold & ~predicted).alias("fn"))
    tp = F.col("tp")
    return t.select(F.round(ratio(tp, tp + F.col("fp")), 4).alias("precision"), F.round(ratio(tp, tp + F.col("fn")), 4).alias("recall"))


def retrieval_hits(retrieved: DataFrame, gold: DataFrame, unit: str, code: str) -> DataFrame:
    """Per code n, hit1 and hit3 of the ranked array ``got`` against gold ``clause``; a query without gold is a miss."""
    j = retrieved.join(gold.select(unit, code, "clause"), [unit, code], "left")
    top = lambda k: F.coalesce(F.array_contains(F.slice("got", 1, k), F.col("clause")), F.lit(False))
    t = j.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.count_if(top(1)).alias("hit1"), F.count_if(top(3)).alias("hit3"))
    return t.withColumn("top1", F.col("hit1") / F.col("n")).withColumn("top3", F.col("hit3") / F.col("n"))


def citation_counts(cited: DataFrame, gold: DataFrame, index: DataFrame, unit: str) -> DataFrame:
    """One row: citations that are right, irrelevant (known, not the unit's) and nonexistent, and gold pairs that were cited.

    ``cited`` is (unit, clause), ``gold`` (unit, code, clause), ``index`` (clause).
    """
    allowed = gold.select(unit, "clause").distinct().withColumn("ok", F.lit(True))
    known = index.select("clause").distinct().withColumn("known", F.lit(True))
    c = cited.join(allowed, [unit, "clause"], "left").join(known, "clause", "left")
    ok, is_known = F.col("ok").isNotNull(), F.col("known").isNotNull()
    counts = c.agg(F.count(F.lit(1)).alias("cited"), F.count_if(ok).alias("correct"), F.count_if(is_known & ~ok).alias("irrelevant"), F.count_if(~is_known).alias("nonexistent"))
    hit = gold.join(cited.select(unit, "clause").distinct().withColumn("hit", F.lit(True)), [unit, "clause"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("hit").isNotNull()).alias("matched"))
    return counts.crossJoin(hit)  # one row each


def threshold_curve(df: DataFrame, score: str, positive: Column, thresholds: list[int]) -> DataFrame:
    """(threshold, tp, fp, fn, f1) of score >= threshold: one pass over the rows, whatever the number of thresholds."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    t = per.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    on = F.col("s") >= F.col("threshold")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = t.groupBy("threshold").agg(z(F.when(on, F.col("p"))).alias("tp"), z(F.when(on, F.col("q"))).alias("fp"), z(F.when(~on, F.col("p"))).alias("fn"))
    return g.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def pick_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of the highest F1; ties to the smallest."""
    return curve.where("f1 is not null").agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def fit_gate(df: DataFrame, by: str, unit: str, label: str, boxes: list[str]) -> DataFrame:
    """Per (by, label): units with the label, units of ``by`` and the exact median of each coordinate."""
    n = df.groupBy(by).agg(F.count_distinct(unit).alias("n"))
    medians = [F.median(c).alias(c) for c in boxes]
    return df.groupBy(by, label).agg(F.count_distinct(unit).alias("n_with"), *medians).join(n, by)


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve, ties counted half; one row, null if a class is empty."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    wide, part = spread(per, "s")
    run = sum_before(wide, [], part, [F.col("s")], F.col("q"), "below")
    wins = F.sum(F.col("p") * (2 * F.col("below") + F.col("q")).cast("double"))
    return run.agg(ratio(wins, 2.0 * F.sum("p") * F.sum("q")).alias("auc"))


def weighted_mean_arrays(rows: DataFrame, by: list[str], array: str, weight: str) -> DataFrame:
    """Elementwise weighted mean of arrays, as (by, i, mean): summed by position, so no array of arrays is gathered."""
    e = rows.select(*by, F.col(weight).alias("_w"), F.posexplode(array).alias("i", "x"))
    return e.groupBy(*by, "i").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.sum("_w")).alias("mean"))


def missing_variance(clients: DataFrame) -> DataFrame:
    """Share of variance that averaging variances misses: between / (within + between).  ``clients``: (key, weight, mean, var)."""
    wm = F.sum(F.col("weight") * F.col("mean")) / F.sum("weight")
    t = clients.groupBy("key").agg(wm.alias("m"), (F.sum(F.col("weight") * F.col("mean") * F.col("mean")) / F.sum("weight")).alias("m2"), (F.sum(F.col("weight") * F.col("var")) / F.sum("weight")).alias("within"))
    between = F.sum(F.col("m2") - F.col("m") * F.col("m"))
    return t.agg(F.coalesce(ratio(between, between + F.sum("within")), F.lit(0.0)).alias("missing"))


def pooled_sd(df: DataFrame, cell: str, value: str) -> DataFrame:
    """sqrt(sum of squares within cells / degrees of freedom) over cells of at least two values."""
    c = df.groupBy(cell).agg(F.var_samp(value).alias("v"), F.count(value).alias("n")).where("n >= 2")
    return c.agg(F.sqrt(F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("sd"), F.count(F.lit(1)).alias("cells"))


def recovery(seeds: DataFrame) -> DataFrame:
    """(seed, fed, central, local): (fed - local) / (central - local); null where central does not exceed local.

    One row: the mean, null if any seed has none, and how many have.
    """
    r = seeds.select(F.when(F.col("central") > F.col("local"), (F.col("fed") - F.col("local")) / (F.col("central") - F.col("local"))).alias("r"))
    n, k = F.count(F.lit(1)), F.count("r")
    return r.agg(F.when(n == k, F.avg("r")).alias("recovery"), k.alias("defined"), n.alias("seeds"))


def gain_report(before: DataFrame, after: DataFrame, client: str, value: str) -> DataFrame:
    """Per client its gain; clients on one side only are listed with state left_only or right_only."""
    a, b = before.select(client, F.col(value).alias("a"), F.lit(1).alias("_a")), after.select(client, F.col(value).alias("b"), F.lit(1).alias("_b"))
    j = a.join(b, client, "full")
    state = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return j.select(client, "a", "b", (F.col("b") - F.col("a")).alias("gain"), state.alias("state"))


def any_fail(df: DataFrame, by: str, verdict: str) -> DataFrame:
    """FAIL if any verdict is FAIL; a unit of null verdicts only passes."""
    return df.groupBy(by).agg(F.when(F.count_if(F.col(verdict) == "FAIL") > 0, "FAIL").otherwise("PASS").alias("verdict"))


def equivalence(clusters: DataFrame, margin: float, least: int = 20) -> DataFrame:
    """(lo, hi, n): equivalent inside +-margin, undecided below ``least`` clusters."""
    inside = (F.col("lo") > -margin) & (F.col("hi") < margin)
    return clusters.withColumn("verdict", F.when(F.col("n") < least, "undecided").when(inside, "equivalent").otherwise("not_equivalent"))


def best_boxes(gold: DataFrame, predicted: DataFrame, keys: list[str], box: list[str], least: float = 0.5, most: int = 100) -> DataFrame:
    """(keys, score, hit): the ``most`` best predictions of each key, each in order of score given its best free gold box.

    Greedy assignment is sequential within a key (an image and class), whose rows are few: a fold over its arrays.
    gold: keys, gold_id, box; predicted: keys, pred_id, score, box.  Equal IoU goes to the larger gold_id.
    """
    g = gold.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gold_id", *box))).alias("golds"))
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), "pred_id")
    kept = predicted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    p = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "pred_id", "score", *box))).alias("preds"))
    one = lambda s: tuple(s[c].cast("double") for c in box)
    j = p.join(g, keys, "left").withColumn("golds", F.coalesce("golds", F.array().cast(g.schema["golds"].dataType)))

    def step(acc: Column, pred: Column) -> Column:
        free = F.filter("golds", lambda t: ~F.array_contains(acc["taken"], t["gold_id"]))
        best = F.array_max(F.transform(free, lambda t: F.struct(S.iou(one(pred), one(t)).alias("v"), t["gold_id"].alias("id"))))
        hit = F.coalesce(best["v"] >= least, F.lit(False))
        row = F.struct(pred["pred_id"].alias("pred_id"), pred["score"].cast("double").alias("score"), hit.alias("hit"))
        return F.struct(F.when(hit, F.concat(acc["taken"], F.array(best["id"]))).otherwise(acc["taken"]).alias("taken"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<struct<pred_id:bigint,score:double,hit:boolean>>").alias("out"))
    return j.select(*keys, F.inline(F.aggregate("preds", start, step, lambda acc: acc["out"])))


def ranked_precision(hits: DataFrame, gold: DataFrame, label: str, points: int = 101) -> DataFrame:
    """Per label with gold: AP as the mean over recall points of the best precision at that recall or beyond.

    ``hits``: label, unit, pred_id, score, hit, ordered by score, then unit and pred_id.  Running counts are dealt by score bin.
    """
    n = gold.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("gold"))
    part = F.floor(-F.col("score") * 4096)
    order = [F.col("score").desc(), F.col("unit"), F.col("pred_id")]
    a = sum_before(hits, [label], part, order, F.col("hit").cast("long"), "tp0")
    a = sum_before(a, [label], part, order, F.lit(1), "n0")
    a = a.where("hit").select(F.col(label).alias("_h"), (F.col("tp0") + 1).alias("tp"), ((F.col("tp0") + 1) / (F.col("n0") + 1)).alias("precision"))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    top = a.join(n, F.col("_h") == F.col("_l")).withColumn("reach", F.floor(F.col("tp") * (points - 1) / F.col("gold")))
    best = top.groupBy("_l", "reach").agg(F.max("precision").alias("p"))
    grid = n.select("_l", at.alias("reach")).join(best, ["_l", "reach"], "left")
    beyond = F.max("p").over(W.partitionBy("_l").orderBy(F.col("reach").desc()))
    return grid.withColumn("q", F.coalesce(beyond, F.lit(0.0))).groupBy(F.col("_l").alias(label)).agg(F.avg("q").alias("ap"))


def fire_rates(contexts: DataFrame, records: DataFrame, unit: str) -> DataFrame:
    """(defect, n, n_missing, rate): of the units of ``contexts`` (unit, defect) with a record (unit, fired) the share that fired."""
    j = contexts.join(records.select(unit, "fired"), unit, "left")
    has = F.col("fired").isNotNull()
    return j.groupBy("defect").agg(F.count_if(has).alias("n"), F.count_if(~has).alias("n_missing"), ratio(F.count_if(F.col("fired")), F.count_if(has)).alias("rate"))


def average_precision_by(scored: DataFrame, by: list[str], unit: str, score: str, positive: str) -> DataFrame:
    """(by, ap): non-interpolated average precision of units by their best score; equal scores count together; null without positives."""
    best = scored.where(F.col(score).isNotNull()).groupBy(*by, unit).agg(F.max(score).alias("s"), F.max(positive).alias("g"))
    ties = best.groupBy(*by, "s").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("pos"))
    wide, part = spread(ties, "s")
    order = [F.col("s").desc()]
    run = sum_before(sum_before(wide, by, -part, order, F.col("n"), "n0"), by, -part, order, F.col("pos"), "hits0")
    hits, n = F.col("hits0") + F.col("pos"), F.col("n0") + F.col("n")
    return run.groupBy(*by).agg(ratio(F.sum(F.col("pos") * hits / n), F.sum("pos")).alias("ap"))


def gini_by(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """(by, gini): twice the area under the ROC curve less one, ties counted half; null if a class is empty."""
    per = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    wide, part = spread(per, "s")
    run = sum_before(wide, by, part, [F.col("s")], F.col("q"), "below")
    wins = F.sum(F.col("p") * (2 * F.col("below") + F.col("q")).cast("double"))
    return run.groupBy(*by).agg((ratio(wins, F.sum("p").cast("double") * F.sum("q")) - 1).alias("gini"))


def gini_contrasts(ginis: DataFrame, central: str, fed: str, local: str) -> DataFrame:
    """(contrast, value): differences of cells' scores; ``local`` is what the local cells' names begin with, and all of them must have one."""
    at = lambda c: F.max(F.when(F.col("cell") == c, F.col("gini")))
    mine = F.col("cell").startswith(local)
    t = ginis.agg(at(central).alias("c"), at(fed).alias("f"), F.when(F.count_if(mine) == F.count(F.when(mine, F.col("gini"))), F.avg(F.when(mine, F.col("gini")))).alias("l"))
    c, f, m = F.col("c"), F.col("f"), F.col("l")
    rows = F.array(*[F.struct(F.lit(k).alias("contrast"), v.alias("value")) for k, v in (("fed_minus_central", f - c), ("fed_minus_local_mean", f - m), ("central_minus_local_mean", c - m))])
    return t.select(F.inline(rows))


def weighted_precision(hits: DataFrame, gold: DataFrame, weights: DataFrame, label: str, points: int = 101) -> DataFrame:
    """``ranked_precision`` in which a unit's predictions and gold count its weight (unit, weight), as if it were there so often."""
    n = gold.join(weights, "unit").groupBy(F.col(label).alias("_l")).agg(F.sum("weight").alias("gold"))
    h, part = spread(hits.join(weights, "unit").where("weight > 0"), "score")
    order = [F.col("score").desc(), F.col("unit"), F.col("pred_id")]
    a = sum_before(h, [label], -part, order, F.when(F.col("hit"), F.col("weight")).otherwise(0), "tp0")
    a = sum_before(a, [label], -part, order, F.col("weight"), "n0")
    tp = F.col("tp0") + F.col("weight")
    a = a.where("hit").select(F.col(label).alias("_h"), tp.alias("tp"), (tp / (F.col("n0") + F.col("weight"))).alias("precision"))
    top = a.join(n, F.col("_h") == F.col("_l")).withColumn("reach", F.floor(F.col("tp") * (points - 1) / F.col("gold")))
    best = top.groupBy("_l", "reach").agg(F.max("precision").alias("p"))
    grid = n.select("_l", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("reach")).join(best, ["_l", "reach"], "left")
    beyond = F.max("p").over(W.partitionBy("_l").orderBy(F.col("reach").desc()))
    return grid.withColumn("q", F.coalesce(beyond, F.lit(0.0))).groupBy(F.col("_l").alias(label)).agg(F.avg("q").alias("ap"))
