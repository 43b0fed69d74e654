"""Queries on samples, splits, quantiles and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import ordered as O
from quern.plans.registry import query, table


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('rev|' || c_custkey)) AS place FROM customer)
SELECT c_custkey, c_mktsegment, n AS "N", place FROM r WHERE place <= greatest(least(30, n), (n * 3 + 99) // 100)""")
def review_sample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return O.prefix_by_stratum(c, "c_mktsegment", "c_custkey", "rev", O.review_size(30, 3, 100)).withColumn("place", F.col("place").cast("long"))


@query("""
WITH r AS (SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('bud|' || s_suppkey)) AS place FROM supplier)
SELECT s_suppkey, s_nationkey, place FROM r WHERE place <= least(n, CAST(ceil(n * 1 / 2.0 / 2) AS BIGINT) * 2)""")
def budget_prefix(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return O.prefix_by_stratum(s, "s_nationkey", "s_suppkey", "bud", O.budget_size(1, 2, 2)).drop("N")


@query("""
WITH r AS (SELECT p_partkey, p_brand, sum(p_size) OVER (PARTITION BY p_brand) AS total,
 coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY sha256('sh|' || p_partkey) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part)
SELECT p_partkey, CASE WHEN before * 1000 < total * 650 THEN 'a' ELSE 'b' END AS side FROM r""")
def dirichlet_partition(spark, d):
    return O.running_share(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_partkey", "p_size", "sh", 650).select("p_partkey", "side")


@query("""
WITH c AS (SELECT list_sort(list(DISTINCT q)) AS cuts FROM (SELECT unnest(quantile_cont(o_totalprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS q FROM orders))
SELECT o_orderkey, len(list_filter(cuts, lambda q: q <= o_totalprice))::INT AS bin FROM orders, c""")
def quantile_bins(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    cuts = O.quantile_cuts(o, "o_totalprice", 8)
    return o.crossJoin(F.broadcast(cuts)).select("o_orderkey", O.bin_of(F.col("o_totalprice"), F.col("cuts")).alias("bin"))  # one row


@query("""
SELECT source, lang, count(*) AS n, CAST(row_number() OVER (PARTITION BY source ORDER BY count(*), lang) AS INTEGER) AS rank FROM documents GROUP BY source, lang""")
def rarest_first_order(spark, d):
    return O.label_ranks(table(spark, d, "documents").select("source", "lang"), "source", "lang")


@query("""
WITH o AS (SELECT o_custkey, c_mktsegment AS seg, o_orderpriority AS pri FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT seg, pri, row_number() OVER (PARTITION BY seg ORDER BY count(*), pri) AS rank FROM o GROUP BY 1, 2)
SELECT o_custkey, min_by(seg || '|' || pri, rank) AS stratum FROM o JOIN r USING (seg, pri) GROUP BY 1""")
def strata_keys(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("pri")).join(c, "o_custkey")
    return O.group_strata(o, "o_custkey", "seg", "pri")


@query("""
WITH o AS (SELECT o_orderpriority AS stratum, ('0x' || substr(sha256('ev|' || o_custkey), 1, 8))::BIGINT % 5 = 0 AS chosen FROM orders)
SELECT stratum, count(*) AS n, sum(chosen::INT)::BIGINT AS n_chosen, abs(sum(chosen::INT) * 100 - count(*) * 20) * 50 <= count(*) * 100 AS within FROM o GROUP BY 1""")
def band_report(spark, d):
    """Whole customers are chosen by hash; the report is on their orders."""
    h = F.conv(F.substr(S.order_key("ev", F.col("o_custkey")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"), (h % 5 == 0).alias("chosen"))
    return O.share_report(o, "stratum", F.col("chosen"), 20, 100)


@query("""
WITH i AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT l_suppkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS m FROM i)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (m > 0) AS gaps, count(*) FILTER (m > 20) AS gaps_over, coalesce(sum(m) FILTER (m BETWEEN 1 AND 20), 0)::BIGINT AS missing_small,
count(*) FILTER (m > 0) + 1 AS runs FROM g GROUP BY 1""")
def id_gaps(spark, d):
    return O.gap_report(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", 20)


@query("""
WITH l AS (SELECT o_clerk, o_custkey FROM (SELECT o_custkey % 7 AS o_clerk, o_custkey FROM orders)),
g AS (SELECT o_clerk AS k, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS n, count(DISTINCT o_custkey) AS ids FROM l GROUP BY 1)
SELECT k, lo, hi, n, ids, n - ids AS repeats FROM g""")
def group_census(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("k"), "o_custkey")
    per = o.groupBy("k", "o_custkey").agg(F.count(F.lit(1)).alias("m"))
    g = per.groupBy("k").agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("ids"))
    return g.withColumn("repeats", F.col("n") - F.col("ids"))
