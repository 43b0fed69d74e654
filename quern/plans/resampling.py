"""Queries on draws and intervals; suppliers are groups, return flags cells or strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import resampling as R
from quern.plans.registry import query, table


def _picks(groups: str, seed: str, draws: int) -> str:
    """SQL of (draw, h, g, m) over a table (h, g) by the rule of stratum_draws."""
    return f"""gr AS ({groups}), nr AS (SELECT h, g, row_number() OVER (PARTITION BY h ORDER BY sha256('{seed}|' || g), g) - 1 AS k FROM gr), sz AS (SELECT h, count(*) AS n FROM gr GROUP BY 1),
pk AS (SELECT draw, h, ('0x' || substr(sha256('{seed}|' || h || '|' || draw || '|' || i), 1, 12))::BIGINT % n AS k FROM (SELECT h, n, unnest(range(n)) AS i FROM sz), range({draws}) t(draw)),
dr AS (SELECT draw, h, g, count(*) AS m FROM pk JOIN nr USING (h, k) GROUP BY 1, 2, 3)"""


_WHOLE = "SELECT DISTINCT 'all' AS h, l_suppkey AS g FROM lineitem"


def whole_draws(spark, d, draws, seed):
    g = table(spark, d, "lineitem").select(F.lit("all").alias("h"), F.col("l_suppkey").alias("g"))
    return R.stratum_draws(g, "h", "g", draws, seed)


@query(f"WITH {_picks('SELECT c_nationkey % 5 AS h, c_custkey AS g FROM customer', 's', 8)} SELECT draw::INT AS draw, h, g, m FROM dr")
def stratum_draws(spark, d):
    """Whole customers drawn within strata of nations."""
    return R.stratum_draws(table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("h"), F.col("c_custkey").alias("g")), "h", "g", 8, "s")


_SIDE = """gr0 AS (SELECT DISTINCT l_suppkey % 4 AS h, l_suppkey AS g FROM lineitem), nh AS (SELECT h, count(*) AS n_h FROM gr0 GROUP BY 1),
cn AS (SELECT l_suppkey AS g, l_suppkey % 4 AS h, l_orderkey * 10 + l_linenumber AS unit, l_returnflag AS label, (l_quantity > 15 AND l_quantity < 35)::INT AS tp, (l_quantity <= 15)::INT AS fp, (l_quantity >= 35)::INT AS fn FROM lineitem)"""


def _design(spark, d):
    """(counts, units, side): lines as units, suppliers as groups, four strata."""
    q, li = F.col("l_quantity"), table(spark, d, "lineitem")
    unit = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit")
    counts = li.select(unit, F.col("l_suppkey").alias("g"), (F.col("l_suppkey") % 4).alias("h"), F.col("l_returnflag").alias("label"), ((q > 15) & (q < 35)).cast("int").alias("tp"), (q <= 15).cast("int").alias("fp"), (q >= 35).cast("int").alias("fn"))
    n = counts.groupBy("h").agg(F.count_distinct("g").alias("n_h")).withColumn("G_h", F.col("n_h") * (F.col("h") + 1))
    return counts, n


@query(f"""WITH {_SIDE}, {_picks('SELECT h, g FROM gr0', 'w', 12)},
t AS (SELECT draw, label, sum(m * (h + 1) * tp) AS tp, sum(m * (h + 1) * fp) AS fp, sum(m * (h + 1) * fn) AS fn FROM dr JOIN cn USING (g, h) GROUP BY 1, 2)
SELECT draw::INT AS draw, round(CASE WHEN count(*) FILTER (tp + fn > 0) = 3 THEN avg(2 * tp / (2 * tp + fp + fn)) END, 9) AS macro_f1 FROM t GROUP BY 1""")
def stratified_m1_draws(spark, d):
    """Macro F1 of draws within strata, each unit weighted by its design weight; groups are summed before draws multiply them."""
    counts, n = _design(spark, d)
    draws = R.stratum_draws(counts, "h", "g", 12, "w")
    sums = counts.groupBy("g", "h", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).join(n, "h").withColumn("unit", F.col("g"))
    side = sums.select("unit", "G_h", "n_h").distinct()
    weights = R.draw_weights(draws, sums.select("unit", "g").distinct(), side, "unit", "g")
    return R.weighted_macro_f1(sums, weights, "unit", "label", ["A", "N", "R"], ["draw"]).withColumn("macro_f1", F.round("macro_f1", 9))


@query(f"""WITH {_SIDE}, k AS (SELECT *, ((g * 10 + 3) % 11 = 0)::INT AS bad FROM cn), w AS (SELECT *, 1.0 AS one, h + 1.0 AS design FROM k),
t AS (SELECT weighting, kind, label, sum(x * tp) AS tp, sum(x * f) AS fp, sum(x * fn) AS fn FROM (SELECT label, tp, fn, unnest(['design', 'none', 'design', 'none']) AS weighting, unnest(['main', 'main', 'sensitivity', 'sensitivity']) AS kind, unnest([design, one, design, one]) AS x, unnest([fp, fp, fp + bad, fp + bad]) AS f FROM w) GROUP BY 1, 2, 3)
SELECT weighting, kind, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1 FROM t GROUP BY 1, 2""")
def representative_scores(spark, d):
    """Macro F1 with design weights and without, as scored and with one more false positive for failed records; that the draw which takes
    each group once gives the weighted value is ``identity_draw``."""
    counts, n = _design(spark, d)
    bad = F.when((F.col("g") * 10 + 3) % 11 == 0, 1).otherwise(0)
    rows = counts.join(F.broadcast(n), "h")  # four strata
    kinds = F.array(*[F.struct(F.lit(w).alias("weighting"), F.lit(k).alias("kind"), x.alias("weight"), (F.col("fp") + b).alias("f")) for w, x in (("design", F.col("G_h") / F.col("n_h")), ("none", F.lit(1.0))) for k, b in (("main", F.lit(0)), ("sensitivity", bad))])
    t = rows.select("label", "tp", "fn", F.inline(kinds)).groupBy("weighting", "kind", "label").agg(F.sum(F.col("tp") * F.col("weight")).alias("tp"), F.sum(F.col("f") * F.col("weight")).alias("fp"), F.sum(F.col("fn") * F.col("weight")).alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return t.groupBy("weighting", "kind").agg(F.round(F.avg(f1), 9).alias("macro_f1"))


@query(f"""WITH {_SIDE}, t AS (SELECT label, sum((h + 1) * tp) AS tp, sum((h + 1) * fp) AS fp, sum((h + 1) * fn) AS fn FROM cn GROUP BY 1) SELECT 0 AS draw, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1 FROM t""")
def identity_draw(spark, d):
    """The draw that takes each group once, by the way of all draws: it must give the weighted score itself."""
    counts, n = _design(spark, d)
    ones = counts.select("g", "h").distinct().select(F.lit(0).alias("draw"), "h", "g", F.lit(1).alias("m"))
    sums = counts.groupBy("g", "h", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).join(n, "h").withColumn("unit", F.col("g"))
    weights = R.draw_weights(ones, sums.select("unit", "g").distinct(), sums.select("unit", "G_h", "n_h").distinct(), "unit", "g")
    return R.weighted_macro_f1(sums, weights, "unit", "label", ["A", "N", "R"], ["draw"]).withColumn("macro_f1", F.round("macro_f1", 9))


@query("""
WITH u AS (SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 97 > 0 THEN o_custkey END AS grp FROM orders), s AS (SELECT o_orderkey AS unit, (o_custkey % 3 + (o_orderkey % 101 = 0)::INT) AS h, 7 + o_custkey % 2 AS n_h FROM orders WHERE o_orderkey % 89 > 0),
j AS (SELECT unit, grp, h, n_h FROM u LEFT JOIN s USING (unit))
SELECT 'no side row' AS "check", unit::VARCHAR AS key FROM j WHERE h IS NULL UNION ALL SELECT 'no group', unit::VARCHAR FROM j WHERE grp IS NULL
UNION ALL SELECT 'group in several strata', grp::VARCHAR FROM (SELECT grp FROM j GROUP BY 1 HAVING count(DISTINCT h) > 1) UNION ALL SELECT 'n_h differs', h::VARCHAR FROM (SELECT h FROM j WHERE h IS NOT NULL GROUP BY 1 HAVING count(DISTINCT grp) <> min(n_h) OR count(DISTINCT grp) <> max(n_h))""")
def design_faults(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    units = o.select(k.alias("unit"), F.when(k % 97 > 0, F.col("o_custkey")).alias("grp"))
    side = o.where(k % 89 > 0).select(k.alias("unit"), (F.col("o_custkey") % 3 + (k % 101 == 0).cast("int")).alias("h"), (7 + F.col("o_custkey") % 2).alias("n_h"))
    return R.design_faults(units, side, "unit", "grp", "h")


_VALUES = "SELECT l_suppkey AS g, CASE WHEN l_partkey % 41 = 0 THEN 'inf'::DOUBLE WHEN l_partkey % 43 = 0 THEN '-inf'::DOUBLE ELSE l_partkey % 1000 / 8 END AS v FROM lineitem"


def _values(spark, d):
    k = F.col("l_partkey")
    v = F.when(k % 41 == 0, F.lit(float("inf"))).when(k % 43 == 0, F.lit(float("-inf"))).otherwise(k % 1000 / 8)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), v.alias("v"))


@query(f"""WITH t AS (SELECT g, list_sort(list(v)) AS x, count(*) AS n FROM ({_VALUES}) GROUP BY 1), e AS (SELECT g, n, x[(n - 1) * 100 // 1000 + 1] AS lo, x[n - (n - 1) * 100 // 1000] AS hi FROM t),
s AS (SELECT *, CASE WHEN isfinite(lo) THEN 'finite' WHEN lo > 0 THEN 'pos_inf' ELSE 'neg_inf' END AS a, CASE WHEN isfinite(hi) THEN 'finite' WHEN hi > 0 THEN 'pos_inf' ELSE 'neg_inf' END AS b FROM e)
SELECT g, CASE WHEN a = 'finite' THEN lo END AS lo, a AS lo_state, CASE WHEN b = 'finite' THEN hi END AS hi, b AS hi_state, CASE WHEN a = 'finite' AND b = 'finite' THEN (hi - lo) / 2 END AS half_width,
CASE WHEN a = 'finite' AND b = 'finite' THEN 'finite' WHEN a = b THEN 'undefined' ELSE 'infinite' END AS half_state, n::INT AS n FROM s""")
def rank_intervals(spark, d):
    """Order-statistic intervals by group, with infinite values among them."""
    return R.rank_intervals(_values(spark, d), ["g"], "v", 100)


@query("""WITH v AS (SELECT l_suppkey AS g, CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 500 / 4 END AS v FROM lineitem), t AS (SELECT g, list_sort(list(v) FILTER (v IS NOT NULL)) AS x, count(v) AS n, count(*) AS k FROM v GROUP BY 1)
SELECT g, x[(n - 1) * 25 // 1000 + 1] AS lo, x[n - (n - 1) * 25 // 1000] AS hi, (k - n)::BIGINT AS n_undefined FROM t""")
def defined_intervals(spark, d):
    k = F.col("l_partkey")
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.when(k % 7 > 0, k % 500 / 4).otherwise(F.lit(float("nan"))).alias("v"))
    return R.defined_intervals(v, ["g"], "v").select("g", "lo", "hi", "n_undefined")


_RATES = f"""{_picks(_WHOLE, 'r', 40)}, sm AS (SELECT l_suppkey AS g, l_returnflag AS cell, sum(l_quantity) AS num, count(*) AS den FROM lineitem GROUP BY 1, 2),
v AS (SELECT cell, draw, sum(m * num) / sum(m * den) AS v FROM dr JOIN sm USING (g) GROUP BY 1, 2)"""


@query(f"WITH {_RATES} SELECT cell, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi, count(*) AS n FROM v GROUP BY 1")
def bootstrap_intervals(spark, d):
    """Percentile intervals of a mean by cell, whole suppliers drawn."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("cell")).agg(F.sum("l_quantity").alias("num"), F.count(F.lit(1)).alias("den"))
    v = whole_draws(spark, d, 40, "r").join(sums, "g").groupBy("cell", "draw").agg((F.sum(F.col("m") * F.col("num")) / F.sum(F.col("m") * F.col("den"))).alias("v"))
    return R.percentile_intervals(v, ["cell"], "v").select("cell", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


@query(f"""
WITH {_picks(_WHOLE, 't', 40)}, sm AS (SELECT l_suppkey AS g, l_linenumber AS cell, sum(l_tax) AS a, sum(l_discount) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
v AS (SELECT cell, draw, sum(m * (a - b)) / sum(m * n) AS v FROM dr JOIN sm USING (g) GROUP BY 1, 2), i AS (SELECT cell, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY 1),
c AS (SELECT l_linenumber AS cell, count(DISTINCT l_suppkey) AS clusters FROM lineitem GROUP BY 1)
SELECT cell, round(lo, 9) AS lo, round(hi, 9) AS hi, clusters, CASE WHEN clusters < 20 THEN 'undecided' WHEN lo > -0.0125 AND hi < 0.0125 THEN 'equivalent' ELSE 'not_equivalent' END AS verdict FROM i JOIN c USING (cell)""")
def tost_intervals(spark, d):
    """Whether two means are equivalent within a margin, judged by the bootstrap interval of their difference."""
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_suppkey": "g", "l_linenumber": "cell"})
    sums = li.groupBy("g", "cell").agg((F.sum("l_tax") - F.sum("l_discount")).alias("num"), F.count(F.lit(1)).alias("den"))
    v = whole_draws(spark, d, 40, "t").join(sums, "g").groupBy("cell", "draw").agg((F.sum(F.col("m") * F.col("num")) / F.sum(F.col("m") * F.col("den"))).alias("v"))
    i = R.percentile_intervals(v, ["cell"], "v").select("cell", "lo", "hi")
    out = R.equivalence(i, li.groupBy("cell").agg(F.count_distinct("g").alias("clusters")), ["cell"], 0.0125)
    return out.withColumn("lo", F.round("lo", 9)).withColumn("hi", F.round("hi", 9))


@query("""
WITH s AS (SELECT o_custkey AS c, count(*) AS n, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1), k AS (SELECT *, CASE WHEN n > 1 THEN sqrt(2 / (n - 1)) * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) END AS c4 FROM s)
SELECT c, n, round(sd, 3) AS sd, round(sd / c4, 3) AS unbiased, CASE WHEN n = 3 THEN round(sd * sqrt(2 / (-2 * ln(0.025))), 3) END AS lo3, CASE WHEN n = 3 THEN round(sd * sqrt(2 / (-2 * ln(0.975))), 3) END AS hi3, round(sqrt(1 - c4 * c4) / c4, 6) AS cv, n >= 10 AS reliable FROM k""")
def sd_diagnostics(spark, d):
    """Deviations of small samples; intervals of three values, whose chi-square has a closed form, stand for all in the SQL."""
    x = R.sd_diagnostics(table(spark, d, "orders").withColumnRenamed("o_custkey", "c"), ["c"], "o_totalprice")
    three = lambda c: F.when(F.col("n") == 3, F.round(c, 3))
    return x.select("c", "n", F.round("sd", 3).alias("sd"), F.round("unbiased", 3).alias("unbiased"), three("lo").alias("lo3"), three("hi").alias("hi3"), F.round("cv", 6).alias("cv"), "reliable")


@query("""
WITH r AS (SELECT l_suppkey AS g, max(l_quantity) AS central, avg(l_quantity) AS loc, stddev_samp(l_quantity) / 5 AS sd, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 4 * 0.1 END AS hw FROM lineitem GROUP BY 1),
t AS (SELECT g, central - loc AS d, coalesce(central - loc > 0 AND central - loc >= 3 * coalesce(sd, 0), false) AS tripwire, hw FROM r) SELECT g, round(d, 9) AS d, tripwire, CASE WHEN NOT tripwire THEN false ELSE hw <= 0.25 END AS reportable FROM t""")
def denominator_verdicts(spark, d):
    q = F.col("l_quantity")
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.max(q).alias("central"), F.avg(q).alias("local"), (F.stddev_samp(q) / 5).alias("sd"))
    r = r.withColumn("half_width", F.when(F.col("g") % 3 > 0, F.col("g") % 4 * 0.1))
    return R.denominator_verdict(r, ["g"]).withColumn("d", F.round("d", 9))


@query("""
WITH s AS (SELECT l_orderkey AS draw, l_linenumber AS seed, l_quantity::BIGINT % 6 AS fed, l_partkey % 6 AS central, l_suppkey % 6 AS loc FROM lineitem),
r AS (SELECT draw, bool_or(central <= loc AND fed = loc) AS z, bool_or(central <= loc AND fed > loc) AS p, bool_or(central <= loc AND fed < loc) AS n, avg((fed - loc) / (central - loc)) FILTER (central > loc) AS mean FROM s GROUP BY 1),
t AS (SELECT draw, CASE WHEN draw % 9 = 0 THEN 'excluded_support' WHEN z THEN 'numerator_zero' WHEN p AND n THEN 'sign_conflict' WHEN p THEN 'pos_inf' WHEN n THEN 'neg_inf' ELSE 'finite' END AS state, mean FROM r)
SELECT draw, state, CASE WHEN state = 'finite' THEN round(mean, 9) END AS value FROM t""")
def draw_states(spark, d):
    """Draws by what their recovery is: excluded, undefined, infinite or finite."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draw"), F.col("l_linenumber").alias("seed"), (F.col("l_quantity").cast("long") % 6).alias("fed"), (F.col("l_partkey") % 6).alias("central"), (F.col("l_suppkey") % 6).alias("local"))
    support = s.select("draw", (F.col("draw") % 9 > 0).alias("support")).distinct()
    out = R.classify_draws(s, support)
    return out.select("draw", "state", F.when(F.col("state") == "finite", F.round("value", 9)).alias("value"))


@query(f"""
WITH {_picks(_WHOLE, 'p', 25)}, sm AS (SELECT l_suppkey AS g, l_returnflag AS seed, CASE l_linenumber % 5 WHEN 0 THEN 'central' WHEN 1 THEN 'fed' ELSE 'local' END AS role, l_linenumber % 5 AS client, sum(l_quantity + CASE WHEN l_linenumber % 5 = 0 THEN l_tax * 9 ELSE 0 END) AS num, count(*) AS den FROM lineitem GROUP BY 1, 2, 3, 4),
v AS (SELECT draw, seed, role, client, sum(m * num) / sum(m * den) AS v FROM dr JOIN sm USING (g) GROUP BY 1, 2, 3, 4),
s AS (SELECT draw, seed, avg(v) FILTER (role = 'central') AS c, avg(v) FILTER (role = 'fed') AS f, avg(v) FILTER (role = 'local') AS l FROM v GROUP BY 1, 2), r AS (SELECT draw, CASE WHEN c > l THEN (f - l) / (c - l) END AS r FROM s)
SELECT draw::INT AS draw, CASE WHEN count(r) = count(*) THEN round(avg(r), 6) END AS recovery FROM r GROUP BY 1""")
def paired_recovery(spark, d):
    """Recovery of draws, the same groups for all seeds and cells."""
    n = F.col("l_linenumber") % 5
    role = F.when(n == 0, "central").when(n == 1, "fed").otherwise("local")
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("seed"), role.alias("role"), n.alias("client")).agg(F.sum(F.col("l_quantity") + F.when(n == 0, F.col("l_tax") * 9).otherwise(F.lit(0.0))).alias("num"), F.count(F.lit(1)).alias("den"))
    return R.paired_recovery(sums, whole_draws(spark, d, 25, "p"), "g").withColumn("recovery", F.round("recovery", 6))


@query(f"""
WITH {_picks(_WHOLE, 'f', 30)}, sm AS (SELECT l_suppkey AS g, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 20) AS ah, count(*) FILTER (l_returnflag = 'R') AS an, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 20) AS bh, count(*) FILTER (l_returnflag <> 'R') AS bn FROM lineitem GROUP BY 1),
t AS (SELECT draw, sum(m * ah) / sum(m * an) AS a, sum(m * bh) / sum(m * bn) AS b FROM dr JOIN sm USING (g) GROUP BY 1) SELECT draw::INT AS draw, round(a, 9) AS a, round(b, 9) AS b, round(a - b, 9) AS difference FROM t""")
def fire_rate_draws(spark, d):
    """How much more often one side fires than the other, in each draw: the cross-source and the discrimination score."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "g")
    out = R.rate_differences(li, whole_draws(spark, d, 30, "f"), "g", F.col("l_returnflag") == "R", F.col("l_quantity") > 20)
    return out.select("draw", *[F.round(c, 9).alias(c) for c in ("a", "b", "difference")])


@query("SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY sha256('h|' || c_custkey), c_custkey) <= greatest(1, round_even(0.2 * count(*) OVER (), 0))")
def group_holdout(spark, d):
    return R.holdout(table(spark, d, "customer"), "c_custkey", 0.2, "h")


@query("""
WITH p AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS found FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)), t AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS truth FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)),
b AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS both FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey)) SELECT found, truth, "both", truth - "both" AS under, found - "both" AS over FROM p, t, b""".replace("AS both", 'AS "both"'))
def merge_errors(spark, d):
    return R.merge_errors(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""
WITH c AS (SELECT l_returnflag AS label, l_partkey % 60 AS cell, count(*) AS n, count(*) FILTER (l_quantity > 30) AS pos FROM lineitem GROUP BY 1, 2), t AS (SELECT label, sum(pos) AS t FROM c GROUP BY 1),
r AS (SELECT label, row_number() OVER w AS k, sum(n) OVER w AS n, sum(pos) OVER w AS p FROM c WHERE n >= 5 WINDOW w AS (PARTITION BY label ORDER BY pos / n DESC, cell)), f AS (SELECT label, k, 2 * p / (n + t) AS f1 FROM r JOIN t USING (label))
SELECT label, k::INT AS cells, round(f1, 9) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, k) = 1""")
def best_prefix_rules(spark, d):
    """The cells that a rule should call positive, by class."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), (F.col("l_partkey") % 60).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 30).alias("pos"))
    return R.best_prefix(c, ["label"], "cell", "n", "pos", 5).withColumn("f1", F.round("f1", 9))
