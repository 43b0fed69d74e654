"""Reports on ids, verdicts, copies, components, hops, and on what metadata alone predicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.evaluation import ratio
from quern.operators.graph import components
from quern.operators.kernels import reach
from quern.operators.ordered import previous, sum_before
from quern.operators.scoring import f1_by

WIDTH = 1 << 16

def gap_report(df: DataFrame, by: list[str], number: str, cap: int = 20, lengths: int = 3, longest: int = 5) -> DataFrame:
    """One row a ``by``: n, id_min, id_max, dup_ids, gaps, gaps_over (longer than ``cap``), p (ids missing in small gaps against all), mean_gap of
    the small ones and its expectation if ids go missing at random, the share of gaps of 1, 2, ... and its expectation, runs, their expected
    number, mean length and the longest lengths.

    A repeated number ends a run and makes no gap.  Dealt by (by, range of numbers).
    """
    ids = df.where(F.col(number).isNotNull()).groupBy(*by, number).agg(F.count(F.lit(1)).alias("c"))
    before = previous(ids, by, number, "before")
    wide = F.col(number) - F.col("before")
    rows = before.withColumn("gap", F.when(wide > 1, wide - 1)).withColumn("breaks", (F.col("c") - 1) + F.when(wide == 1, 0).otherwise(1))
    small = F.col("gap") <= cap
    sums = rows.groupBy(*by).agg(
        F.sum("c").alias("n"), F.min(number).alias("id_min"), F.max(number).alias("id_max"), F.sum(F.col("c") - 1).alias("dup_ids"), F.count("gap").alias("gaps"), F.count_if(F.col("gap") > cap).alias("gaps_over"),
        F.count_if(small).alias("_n"), F.coalesce(F.sum(F.when(small, F.col("gap"))), F.lit(0)).alias("_missing"), F.sum("breaks").alias("runs"), *[F.count_if(F.col("gap") == k).alias(f"_g{k}") for k in range(1, lengths + 1)],
    )
    # The j-th copy of a number is in the run of as many breaks as come before it.
    run = sum_before(rows, by, F.floor(F.col(number) / WIDTH), [F.col(number)], F.col("breaks"), "_r")
    first = F.col("_r") + F.col("breaks") - (F.col("c") - 1)
    tops = run.select(*by, F.explode(F.sequence(first, first + F.col("c") - 1)).alias("_i")).groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("len"))
    # Counted by length, so that the list that is sorted holds different lengths only.
    top = tops.groupBy(*by, "len").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("len", "k")), asc=False).alias("_t"))
    listed = F.slice(F.flatten(F.transform(F.slice("_t", 1, longest), lambda x: F.array_repeat(x["len"], F.least(x["k"], F.lit(longest)).cast("int")))), 1, longest)
    p = ratio(F.col("_missing"), F.col("n") + F.col("_missing"))
    share = F.when(F.col("_n") > 0, F.array(*[F.round(F.col(f"_g{k}") / F.col("_n"), 4) for k in range(1, lengths + 1)]))
    return sums.alias("s").join(top.alias("t"), [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]).select(
        *[F.col(f"s.{c}") for c in by], "n", "id_min", "id_max", "dup_ids", "gaps", "gaps_over", F.round(p, 4).alias("p"), F.round(ratio(F.col("_missing"), F.col("_n")), 4).alias("mean_gap"), F.round(1 / (1 - p), 4).alias("expected_gap"), share.alias("shares"),
        F.array(*[F.round((1 - p) * F.pow(p, F.lit(k - 1)), 4) for k in range(1, lengths + 1)]).alias("expected_shares"), "runs", F.round(F.col("n") * p, 1).alias("expected_runs"), F.round(F.col("n") / F.col("runs"), 2).alias("run_mean"), listed.alias("run_top"),
    )


def agreement(a: DataFrame, b: DataFrame, key: str, verdict: str, axis: str) -> DataFrame:
    """(axis, n, agree, only_a, only_b, agreement) of two verdicts (key, verdict, axis) on the same rows, and as axis null over all.  A key that two
    rows have in one table passes if one of them does; a null verdict is no row."""
    one = lambda t, n: t.where(F.col(verdict).isNotNull()).groupBy(key, axis).agg(F.bool_or(verdict).alias(n))
    both = one(a, "p").join(one(b, "q").drop(axis), key)
    p, q = F.col("p"), F.col("q")
    out = both.rollup(axis).agg(F.count(F.lit(1)).alias("n"), F.count_if(p == q).alias("agree"), F.count_if(p & ~q).alias("only_a"), F.count_if(q & ~p).alias("only_b"))
    return out.select(axis, "n", "agree", "only_a", "only_b", F.round(ratio(F.col("agree"), F.col("n")), 4).alias("agreement"))


def differences(sealed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with the side that has them and how much more often; nulls are values.

    One aggregation of both, no pass for each side.  Columns must be the same, in any order."""
    if set(sealed.columns) != set(rebuilt.columns):
        raise ValueError(f"columns {sorted(set(sealed.columns) ^ set(rebuilt.columns))} of one side only")
    cols = sealed.columns
    t = sealed.withColumn("_w", F.lit(1)).union(rebuilt.select(cols).withColumn("_w", F.lit(-1))).groupBy(*cols).agg(F.sum("_w").alias("_w"))
    return t.where("_w <> 0").select(*cols, F.when(F.col("_w") > 0, "sealed").otherwise("rebuilt").alias("side"), F.abs("_w").alias("times"))


def component_table(units: DataFrame, edges: DataFrame, group: str, ks: list[int], split: str) -> DataFrame:
    """One row a k: components, the largest one and its share, links (a, b) whose ends are in different splits, and links between components.

    units: (id, group, split).  Groups with at least k links between them are one component.
    """
    u = units.select("id", F.col(group).alias("g"), F.col(split).alias("s"))
    side = lambda c: u.select(F.col("id").alias(c), F.col("g").alias("g" + c), F.col("s").alias("s" + c))
    e = edges.join(side("a"), "a").join(side("b"), "b")
    pairs = e.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sa") != F.col("sb")).alias("leak"))
    sizes = u.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for k in ks:  # a few thresholds, named by the caller
        comp = components(pairs.where((F.col("n") >= k) & (F.col("a") != F.col("b"))).select("a", "b")).select(F.col("id").alias("g"), "component")
        per = sizes.join(comp, "g", "left").select("g", "n", F.coalesce("component", "g").alias("c"))
        end = lambda c: per.select(F.col("g").alias(c), F.col("c").alias("c" + c))  # noqa: E731, B023
        cross = pairs.join(end("a"), "a").join(end("b"), "b").agg(F.coalesce(F.sum("leak"), F.lit(0)).alias("leaks"), F.coalesce(F.sum(F.when(F.col("ca") != F.col("cb"), F.col("n"))), F.lit(0)).alias("crossing"))
        row = per.groupBy("c").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("_n")).crossJoin(cross)  # one row each
        row = row.select(F.lit(k).alias("k"), "components", "largest", F.round(ratio(F.col("largest"), F.col("_n")), 4).alias("share"), "leaks", "crossing")
        out = row if out is None else out.union(row)
    return out


def hop_table(seeds: DataFrame, edges: DataFrame, groups: DataFrame, place: str, counts: list[int], floors: dict[str, float]) -> DataFrame:
    """(variant, seeds, h1, h1_with_groups, h2, h2_with_groups): how many ids are reached by links whose score reaches a floor, from the first seeds in
    an order.  seeds: (id, place from 0), edges: (a, b, score), groups: (id, grp)."""
    out = None
    for variant, floor in floors.items():  # a few of each, named by the caller
        e = edges.where(F.col("score") >= floor).select("a", "b")
        for n in counts:
            s = seeds.where(F.col(place) < n).select("id")
            size = lambda with_groups, tag: reach(s, e, groups, with_groups).agg(F.count_if(F.col("hop") == 1).alias("h1" + tag), F.count(F.lit(1)).alias("h2" + tag))  # noqa: E731, B023
            row = size(False, "").crossJoin(size(True, "_with_groups"))  # one row each
            row = row.select(F.lit(variant).alias("variant"), F.lit(n).alias("seeds"), "h1", "h1_with_groups", "h2", "h2_with_groups")
            out = row if out is None else out.union(row)
    return out


def one_model(records: DataFrame, unit: str, model: list[str]) -> DataFrame:
    """Records of one model, each unit once; several models or a unit twice are errors."""
    models = records.select(*model).distinct().limit(2).collect()
    if len(models) > 1:
        raise ValueError(f"several models: {[tuple(m) for m in models]}")
    if twice := records.groupBy(unit).count().where("count > 1").select(unit).first():
        raise ValueError(f"two records of {twice[0]}")
    return records


def for_training(images: DataFrame, defects: DataFrame, unit: str, split: str, held: str, columns: list[str], forbidden: tuple[str, ...]) -> DataFrame:
    """The allowed columns of defects of images outside of the held split; a forbidden column is an error before anything is read, and so is, counted on
    the result, a row of a held or unknown image."""
    if bad := sorted(set(columns) & set(forbidden)):
        raise ValueError(f"forbidden: {bad}")
    out = defects.join(images.where(F.col(split) != held).select(unit), unit, "left_semi")
    free = images.where(F.col(split) != held).select(unit)
    if n := out.join(images.where(F.col(split) == held).select(unit), unit, "left_semi").count() + out.join(free, unit, "left_anti").count():
        raise ValueError(f"{n} rows of held or unknown images")
    return out.select(columns)


def metadata_probe(train: DataFrame, test: DataFrame, unit: str, features: list[str], classes: dict[str, str], gate: float | None = None, depth: int = 4) -> DataFrame:
    """(macro_f1, passed): a tree for each class that predicts its 0/1 column from metadata alone; passed if the score is no more than ``gate``.

    classes: name -> column.  Nulls of features are errors of the fit; a class without support in the test does not count.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    shape = VectorAssembler(inputCols=features, outputCol="_x")
    wide, counts = shape.transform(train), None
    for name, column in classes.items():  # a few classes
        fit = DecisionTreeClassifier(featuresCol="_x", labelCol=column, predictionCol="_y", rawPredictionCol="_r", probabilityCol="_p", maxDepth=depth, seed=0).fit(wide)
        hit, gold = F.col("_y") > 0.5, F.col(column) == 1
        row = fit.transform(shape.transform(test)).agg(F.count_if(hit & gold).alias("tp"), F.count_if(hit & ~gold).alias("fp"), F.count_if(~hit & gold).alias("fn")).withColumn("label", F.lit(name))
        counts = row if counts is None else counts.union(row)
    out = f1_by(counts.withColumn("_one", F.lit(1)), ["_one"], "label").select("macro_f1")
    return out.withColumn("passed", F.lit(None).cast("boolean") if gate is None else F.col("macro_f1") <= gate)
