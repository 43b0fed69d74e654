"""Queries of reports: gaps of ids, agreement, copies, components and hops."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import reports as P
from quern.plans.registry import query, table


@query("""
WITH v AS (SELECT l_suppkey % 50 AS s, l_partkey AS id FROM lineitem), d AS (SELECT s, id, lag(id) OVER (PARTITION BY s ORDER BY id) AS b FROM v), r AS (SELECT *, sum(CASE WHEN id - b = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY id ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN id - b > 1 THEN id - b - 1 END AS gap FROM d),
l AS (SELECT s, run, count(*) AS len FROM r GROUP BY 1, 2), t AS (SELECT s, count(*) AS runs, list(len ORDER BY len DESC)[1:5] AS top FROM l GROUP BY 1),
g AS (SELECT s, count(*) AS n, min(id) AS id_min, max(id) AS id_max, count(*) - count(DISTINCT id) AS dup_ids, count(gap) AS gaps, count(*) FILTER (gap > 20) AS gaps_over, count(*) FILTER (gap <= 20) AS k, coalesce(sum(gap) FILTER (gap <= 20), 0) AS m, count(*) FILTER (gap = 1) AS g1 FROM r GROUP BY 1)
SELECT s, n, id_min, id_max, dup_ids, gaps, gaps_over, round(m / (n + m), 4) AS p, round(CASE WHEN k > 0 THEN m / k END, 4) AS mean_gap, round(1 / (1 - m / (n + m)), 4) AS expected_gap, round(CASE WHEN k > 0 THEN g1 / k END, 4) AS share1, runs, round(n * (m / (n + m)), 1) AS expected_runs, round(n / runs, 2) AS run_mean, array_to_string(top, ',') AS run_top FROM g JOIN t USING (s)""")
def gap_report(spark, d):
    """Gaps and runs of ids, against what random losses would give."""
    r = P.gap_report(table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("s"), F.col("l_partkey").alias("id")), ["s"], "id")
    return r.withColumn("share1", F.get("shares", F.lit(0))).withColumn("run_top", F.array_join(F.col("run_top").cast("array<string>"), ",")).drop("shares", "expected_shares")


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS x, o_totalprice > 200000 AS p FROM orders WHERE o_orderkey % 10 > 0), b AS (SELECT o_orderkey AS k, o_custkey % 2 = 0 AS q FROM orders WHERE o_orderkey % 7 > 0), j AS (SELECT x, p, q FROM a JOIN b USING (k))
SELECT x, count(*) AS n, count(*) FILTER (p = q) AS agree, count(*) FILTER (p AND NOT q) AS only_a, count(*) FILTER (q AND NOT p) AS only_b, round(count(*) FILTER (p = q) / count(*), 4) AS agreement FROM j GROUP BY GROUPING SETS ((x), ())""")
def verdict_agreement(spark, d):
    """Two judges' verdicts on the rows that both judged, by priority and over all."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("x"), (F.col("o_totalprice") > 200000).alias("p"), (F.col("o_custkey") % 2 == 0).alias("q"))
    return P.agreement(o.where("k % 10 > 0").select("k", "x", "p"), o.where("k % 7 > 0").select("k", "x", F.col("q").alias("p")), "k", "p", "x")


@query("""
WITH s AS (SELECT l_partkey % 100 AS p, l_linenumber AS n, CASE WHEN l_linenumber < 5 THEN l_returnflag END AS f FROM lineitem), r AS (SELECT p, n, f FROM s WHERE n <> 3 UNION ALL SELECT p, n, f FROM s WHERE n = 4 AND p < 10)
SELECT p, n, f, CASE WHEN t > 0 THEN 'sealed' ELSE 'rebuilt' END AS side, abs(t)::BIGINT AS times FROM (SELECT p, n, f, sum(w) AS t FROM (SELECT *, 1 AS w FROM s UNION ALL SELECT *, -1 FROM r) GROUP BY 1, 2, 3) WHERE t <> 0""")
def rebuilt_differences(spark, d):
    """A table against a rebuilt one, repeated rows counted."""
    n = F.col("l_linenumber")
    s = table(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("p"), n.alias("n"), F.when(n < 5, F.col("l_returnflag")).alias("f"))
    return P.differences(s, s.where("n <> 3").union(s.where("n = 4 and p < 10")).select("f", "n", "p"))


_EDGES = "e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + 13) % (SELECT count(*) FROM customer) AS b, o_custkey % 10 / 10.0 AS score FROM orders), u AS (SELECT c_custkey AS id, c_nationkey AS g, c_mktsegment AS s FROM customer)"


def _linked(spark, d):
    c = table(spark, d, "customer")
    k, n = F.col("o_custkey"), c.count()
    units = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("g"), F.col("c_mktsegment").alias("s"))
    return units, table(spark, d, "orders").select(k.alias("a"), ((k * 7 + 13) % n).alias("b"), (k % 10 / 10).alias("score")).distinct()


@query(f"""
WITH RECURSIVE {_EDGES}, x AS (SELECT least(ua.g, ub.g) AS a, greatest(ua.g, ub.g) AS b, count(*) AS n, count(*) FILTER (ua.s <> ub.s) AS leak FROM e JOIN u ua ON ua.id = e.a JOIN u ub ON ub.id = e.b GROUP BY 1, 2), ks AS (SELECT unnest([2, 3, 5]) AS k),
l AS (SELECT k, a, b FROM x, ks WHERE n >= k AND a <> b UNION ALL SELECT k, b, a FROM x, ks WHERE n >= k AND a <> b), r AS (SELECT k, g, g AS m FROM ks, (SELECT DISTINCT g FROM u) UNION SELECT r.k, l.b, r.m FROM r JOIN l ON l.k = r.k AND l.a = r.g), c AS (SELECT k, g, min(m) AS c FROM r GROUP BY 1, 2),
z AS (SELECT k, c, count(*) AS n FROM c JOIN u USING (g) GROUP BY 1, 2), w AS (SELECT k, count(*) AS components, max(n) AS largest, sum(n) AS t FROM z GROUP BY 1),
q AS (SELECT ca.k, coalesce(sum(leak), 0)::BIGINT AS leaks, coalesce(sum(n) FILTER (ca.c <> cb.c), 0)::BIGINT AS crossing FROM x JOIN c ca ON ca.g = x.a JOIN c cb ON cb.g = x.b AND cb.k = ca.k GROUP BY 1)
SELECT k, components, largest, round(largest / t, 4) AS share, leaks, crossing FROM w JOIN q USING (k)""")
def component_table(spark, d):
    """Components at several thresholds, and the links that cross them or a split."""
    units, e = _linked(spark, d)
    return P.component_table(units, e.select("a", "b"), "g", [2, 3, 5], "s")


@query(f"""
WITH {_EDGES}, o AS (SELECT id, row_number() OVER (ORDER BY sha256('hops|' || id)) - 1 AS i FROM u), c AS (SELECT unnest([4, 16]) AS k), v AS (SELECT unnest(['low', 'high']) AS v, unnest([0.2, 0.7]) AS f), s AS (SELECT v, k, id FROM o, c, v WHERE i < k),
y AS (SELECT v, a, b FROM e, v WHERE score >= f UNION SELECT v, b, a FROM e, v WHERE score >= f), one AS (SELECT DISTINCT s.v, s.k, b AS id FROM s JOIN y ON y.v = s.v AND y.a = s.id WHERE (s.v, s.k, b) NOT IN (SELECT (v, k, id) FROM s)),
og AS (SELECT * FROM one UNION SELECT one.v, one.k, z.id FROM one JOIN u w ON w.id = one.id JOIN u z ON z.g = w.g WHERE (one.v, one.k, z.id) NOT IN (SELECT (v, k, id) FROM s)),
two AS (SELECT * FROM one UNION SELECT one.v, one.k, b FROM one JOIN y ON y.v = one.v AND y.a = one.id WHERE (one.v, one.k, b) NOT IN (SELECT (v, k, id) FROM s)), t0 AS (SELECT * FROM og UNION SELECT og.v, og.k, b FROM og JOIN y ON y.v = og.v AND y.a = og.id WHERE (og.v, og.k, b) NOT IN (SELECT (v, k, id) FROM s)),
tg AS (SELECT * FROM t0 UNION SELECT t0.v, t0.k, z.id FROM t0 JOIN u w ON w.id = t0.id JOIN u z ON z.g = w.g WHERE (t0.v, t0.k, z.id) NOT IN (SELECT (v, k, id) FROM s))
SELECT v.v AS variant, c.k AS seeds, (SELECT count(*) FROM one x WHERE x.v = v.v AND x.k = c.k) AS h1, (SELECT count(*) FROM og x WHERE x.v = v.v AND x.k = c.k) AS h1_with_groups, (SELECT count(*) FROM two x WHERE x.v = v.v AND x.k = c.k) AS h2, (SELECT count(*) FROM tg x WHERE x.v = v.v AND x.k = c.k) AS h2_with_groups FROM v, c""")
def hop_table(spark, d):
    """How far seeds reach in one and two steps, at two floors of the score."""
    from quern.functions.scalars import order_key

    units, e = _linked(spark, d)
    first = units.select("id", order_key("hops", F.col("id")).alias("o")).orderBy("o").limit(16)  # as many seeds as the largest count
    from pyspark.sql import Window as W

    seeds = first.select("id", (F.row_number().over(W.orderBy("o")) - 1).alias("i"))
    return P.hop_table(seeds, e, units.select("id", F.col("g").alias("grp")), "i", [4, 16], {"low": 0.2, "high": 0.7})


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'")
def training_rows(spark, d):
    """Allowed columns of rows outside the held split, counted again on the result."""
    return P.for_training(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), table(spark, d, "lineitem"), "l_orderkey", "o_orderstatus", "P", ["l_orderkey", "l_linenumber"], ("l_comment",))


@query(None)
def metadata_probe(spark, d):
    """What trees on metadata alone score on a test; tests hold them against a signal that is there and one that is not."""
    k, q = F.col("l_orderkey") % 5, F.col("l_quantity")
    li = table(spark, d, "lineitem").select(k.alias("k"), q.cast("double").alias("q"), F.col("l_linenumber").cast("double").alias("n"), (q > 25).cast("double").alias("a"), (F.col("l_partkey") % 2).cast("double").alias("b"))
    return P.metadata_probe(li.where("k > 0"), li.where("k = 0"), "k", ["q", "n"], {"a": "a", "b": "b"}, 0.9)
