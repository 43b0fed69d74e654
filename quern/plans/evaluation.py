"""Queries on scores; documents, labels and lineitem stand for predictions and gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evaluation as E
from quern.operators import scoring as P
from quern.plans.registry import query, table

_ROWS = """g AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS label FROM lineitem WHERE l_quantity > 15),
p AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS label FROM lineitem WHERE l_quantity < 35),
c AS (SELECT label, sum(a * b)::BIGINT AS tp, sum((1 - a) * b)::BIGINT AS fp, sum(a * (1 - b))::BIGINT AS fn FROM
 (SELECT unit, label, max(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS a, max(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS b FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 AS s FROM p) GROUP BY 1, 2) GROUP BY 1)"""


def _counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("label"), "l_quantity")
    return P.count_table(rows.where("l_quantity > 15"), rows.where("l_quantity < 35"), "unit", "label")


@query(f"WITH {_ROWS} SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1, round(sum(2 * tp) / sum(2 * tp + fp + fn), 9) AS micro_f1, count(*) AS labels FROM c")
def score_m1(spark, d):
    out = E.f1_summary(P.label_scores(_counts(spark, d), "label"))
    return out.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("micro_f1", 9).alias("micro_f1"), "labels")


@query("""
SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def confusion_pairs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return E.two_by_two(rows, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)


@query("""
WITH j AS (SELECT lang, toxic = 1 AS g, n_chars > 1500 AS p FROM documents JOIN labels USING (doc_id)),
w AS (SELECT lang, n / k AS w FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) JOIN (SELECT lang, count(*) AS k FROM j GROUP BY 1) USING (lang))
SELECT round(sum(w) FILTER (g AND p) / sum(w) FILTER (p), 4) AS precision, round(sum(w) FILTER (g AND p) / sum(w) FILTER (g), 4) AS recall FROM j JOIN w USING (lang)""")
def stratum_weighted_rates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    drawn = docs.join(table(spark, d, "labels"), "doc_id")
    rows = drawn.join(E.stratum_weights(docs, drawn, "lang"), "lang")
    return E.weighted_rates(rows, F.col("toxic") == 1, F.col("n_chars") > 1500, F.col("weight"))


@query("""
WITH r AS (SELECT l_orderkey AS o, l_returnflag AS code, list(l_partkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS got FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey AS o, l_returnflag AS code, min(l_partkey) AS clause FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT code, count(*) AS n, count(*) FILTER (got[1] = clause) AS hit1, count(*) FILTER (list_contains(got[1:3], clause)) AS hit3,
round(count(*) FILTER (got[1] = clause) / count(*), 9) AS top1, round(count(*) FILTER (list_contains(got[1:3], clause)) / count(*), 9) AS top3 FROM r LEFT JOIN g USING (o, code) GROUP BY code""")
def score_retrieval(spark, d):
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "o", "l_returnflag": "code"})
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    r = li.groupBy("o", "code").agg(ranked["l_partkey"].alias("got"))
    g = li.where("l_linestatus = 'O'").groupBy("o", "code").agg(F.min("l_partkey").alias("clause"))
    out = E.retrieval_hits(r, g, "o", "code")
    return out.withColumn("top1", F.round("top1", 9)).withColumn("top3", F.round("top3", 9))


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS clause FROM lineitem), g AS (SELECT DISTINCT l_orderkey AS o, l_returnflag AS code, l_suppkey AS clause FROM lineitem WHERE l_quantity > 30),
i AS (SELECT s_suppkey AS clause FROM supplier WHERE s_acctbal > 0), a AS (SELECT DISTINCT o, clause FROM g),
k AS (SELECT a.o IS NOT NULL AS ok, i.clause IS NOT NULL AS known FROM c LEFT JOIN a ON c.o = a.o AND c.clause = a.clause LEFT JOIN i ON c.clause = i.clause)
SELECT count(*) AS cited, count(*) FILTER (ok) AS correct, count(*) FILTER (known AND NOT ok) AS irrelevant, count(*) FILTER (NOT known) AS nonexistent,
(SELECT count(*) FROM g) AS pairs, (SELECT count(*) FROM g SEMI JOIN c USING (o, clause)) AS matched FROM k""")
def score_citation(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("code"), F.col("l_suppkey").alias("clause"), "l_quantity")
    index = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("clause"))
    return E.citation_counts(li.select("o", "clause").distinct(), li.where("l_quantity > 30").select("o", "code", "clause").distinct(), index, "o")


@query("""
WITH t AS (SELECT CAST(l_quantity AS BIGINT) AS s, l_returnflag = 'R' AS p FROM lineitem)
SELECT threshold::INT AS threshold, count(*) FILTER (p AND s >= threshold) AS tp, count(*) FILTER (NOT p AND s >= threshold) AS fp, count(*) FILTER (p AND s < threshold) AS fn,
round(2 * count(*) FILTER (p AND s >= threshold) / (2 * count(*) FILTER (p AND s >= threshold) + count(*) FILTER (NOT p AND s >= threshold) + count(*) FILTER (p AND s < threshold)), 9) AS f1
FROM t, range(5, 50, 5) r(threshold) GROUP BY threshold""")
def threshold_curve(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("s"), (F.col("l_returnflag") == "R").alias("p"))
    return E.threshold_curve(rows, "s", F.col("p"), list(range(5, 50, 5))).withColumn("f1", F.round("f1", 9))


@query("""
WITH t AS (SELECT CAST(l_quantity AS BIGINT) AS s, l_returnflag = 'R' AS p FROM lineitem),
c AS (SELECT threshold, 2 * count(*) FILTER (p AND s >= threshold) / (2 * count(*) FILTER (p AND s >= threshold) + count(*) FILTER (NOT p AND s >= threshold) + count(*) FILTER (p AND s < threshold)) AS f1
 FROM t, range(5, 50, 5) r(threshold) GROUP BY threshold)
SELECT threshold::INT AS threshold, round(f1, 9) AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1""")
def pick_threshold(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("s"), (F.col("l_returnflag") == "R").alias("p"))
    return E.pick_threshold(E.threshold_curve(rows, "s", F.col("p"), list(range(5, 50, 5)))).withColumn("f1", F.round("f1", 9))


@query("""
WITH n AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
f AS (SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS n_with, median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, n_with, n, l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM f JOIN n USING (l_suppkey) WHERE 100 * n_with >= 35 * n""")
def predict_gate(spark, d):
    fit = E.fit_gate(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_returnflag", ["l_quantity", "l_extendedprice"])
    return fit.where("100 * n_with >= 35 * n").withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("""
WITH j AS (SELECT n_chars AS s, toxic FROM documents JOIN labels USING (doc_id)), t AS (SELECT s, sum(toxic) AS p, count(*) - sum(toxic) AS q FROM j GROUP BY s),
r AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
SELECT round(sum(p * (2 * below + q)) / (2 * sum(p) * sum(q)), 9) AS auc FROM r""")
def score_threshold_free(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return E.auc(rows, "n_chars", F.col("toxic") == 1).select(F.round("auc", 9).alias("auc"))


@query("""
WITH e AS (SELECT label, vec_id % 7 + 1 AS w, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL)
SELECT label, i::INT AS i, round(sum(x * w) / sum(w), 9) AS mean FROM e GROUP BY 1, 2""")
def weighted_fedavg(spark, d):
    e = table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 7 + 1)
    return E.weighted_mean_arrays(e, ["label"], "embedding", "w").withColumn("mean", F.round("mean", 9))


@query("""
WITH c AS (SELECT l_returnflag AS key, l_linenumber AS client, count(*) AS w, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
t AS (SELECT key, sum(w * m) / sum(w) AS mu, sum(w * m * m) / sum(w) AS m2, sum(w * v) / sum(w) AS within FROM c GROUP BY 1)
SELECT round(sum(m2 - mu * mu) / (sum(m2 - mu * mu) + sum(within)), 6) AS missing FROM t""")
def missing_variance_ratio(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key"), "l_linenumber").agg(F.count(F.lit(1)).alias("weight"), F.avg("l_quantity").alias("mean"), F.var_pop("l_quantity").alias("var"))
    return E.missing_variance(c).select(F.round("missing", 6).alias("missing"))


@query("""
WITH c AS (SELECT o_custkey, var_samp(o_totalprice) AS v, count(o_totalprice) AS n FROM orders GROUP BY 1 HAVING count(o_totalprice) >= 2)
SELECT round(sqrt(sum(v * (n - 1)) / sum(n - 1)), 3) AS sd, count(*) AS cells FROM c""")
def pooled_sd(spark, d):
    return E.pooled_sd(table(spark, d, "orders"), "o_custkey", "o_totalprice").withColumn("sd", F.round("sd", 3))


@query("""
WITH s AS (SELECT l_linenumber AS seed, avg(l_quantity) FILTER (l_returnflag = 'A') AS fed, max(l_quantity) AS central, min(l_quantity) AS loc FROM lineitem GROUP BY 1),
r AS (SELECT CASE WHEN central > loc THEN (fed - loc) / (central - loc) END AS r FROM s)
SELECT CASE WHEN count(*) = count(r) THEN round(avg(r), 9) END AS recovery, count(r) AS defined, count(*) AS seeds FROM r""")
def point_recovery(spark, d):
    q = F.col("l_quantity")
    s = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg(F.when(F.col("l_returnflag") == "A", q)).alias("fed"), F.max(q).alias("central"), F.min(q).alias("local"))
    return E.recovery(s).withColumn("recovery", F.round("recovery", 9))


@query("""
WITH a AS (SELECT o_custkey AS c, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS c, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(a.c, b.c) AS c, a.v AS a, b.v AS b, b.v - a.v AS gain, CASE WHEN b.c IS NULL THEN 'left_only' WHEN a.c IS NULL THEN 'right_only' ELSE 'both' END AS state FROM a FULL JOIN b ON a.c = b.c""")
def participant_gain(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c"), "o_orderstatus").agg(F.count(F.lit(1)).alias("v"))
    return E.gain_report(n.where("o_orderstatus = 'O'"), n.where("o_orderstatus = 'F'"), "c", "v")


@query("SELECT l_orderkey, CASE WHEN bool_or(l_quantity > 45) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM lineitem GROUP BY 1")
def aggregate_verdicts(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 45, "FAIL").otherwise("PASS").alias("v"))
    return E.any_fail(v, "l_orderkey", "v")


@query("""
WITH d AS (SELECT l_suppkey, avg(l_tax) - avg(l_discount) AS x, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN n < 20 THEN 'undecided' WHEN round(x, 9) - 0.005 > -0.02 AND round(x, 9) + 0.005 < 0.02 THEN 'equivalent' ELSE 'not_equivalent' END AS verdict FROM d""")
def tost_equivalence(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_tax") - F.avg("l_discount"), 9).alias("x"), F.count_distinct("l_orderkey").alias("n"))
    return E.equivalence(g.withColumn("lo", F.col("x") - 0.005).withColumn("hi", F.col("x") + 0.005), 0.02).select("l_suppkey", "verdict")


@query(None)
def evaluate_map50(spark, d):
    """Lines as boxes: gold from lines of an order with status F, predictions from all, by return flag; the score is a hash."""
    q = F.col("l_quantity").cast("long")
    b = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("unit"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), "l_linestatus",
        F.lit(0).alias("x1"), F.lit(0).alias("y1"), (q + 5).alias("x2"), (F.col("l_linenumber") + 3).alias("y2"), (F.pmod(F.col("l_partkey") * 37, F.lit(1000)) / 1000).alias("score"),
    )
    gold = b.where("l_linestatus = 'F'").withColumnRenamed("id", "gold_id").select("label", "unit", "gold_id", "x1", "y1", "x2", "y2")
    hits = E.best_boxes(gold, b.withColumnRenamed("id", "pred_id").drop("l_linestatus"), ["label", "unit"], ["x1", "y1", "x2", "y2"])
    return E.ranked_precision(hits, gold, "label").select("label", F.round("ap", 9).alias("ap"))


@query("""
WITH g AS (SELECT l_suppkey AS g, l_returnflag AS label, sum((l_quantity > 15 AND l_quantity < 35)::INT) AS tp, sum((l_quantity <= 15)::INT) AS fp, sum((l_quantity >= 35)::INT) AS fn FROM lineitem GROUP BY 1, 2),
k AS (SELECT g, row_number() OVER (ORDER BY sha256('m|' || g)) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM g)),
p AS (SELECT draw, ('0x' || substr(sha256('m|' || draw || '|' || i), 1, 12))::BIGINT % (SELECT max(n) FROM k) AS k FROM (SELECT draw, unnest(range((SELECT max(n) FROM k))) AS i FROM range(20) t(draw))),
t AS (SELECT draw, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM p JOIN k USING (k) JOIN g USING (g) GROUP BY 1, 2)
SELECT draw, round(CASE WHEN count(*) = 3 THEN avg(2 * tp / (2 * tp + fp + fn)) END, 9) AS macro_f1 FROM t GROUP BY 1""")
def m1_draws(spark, d):
    """Bootstrap draws of macro F1 by supplier."""
    q = F.col("l_quantity")
    c = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", ((q > 15) & (q < 35)).cast("int").alias("tp"), (q <= 15).cast("int").alias("fp"), (q >= 35).cast("int").alias("fn"))
    return P.macro_f1_draws(c, "l_suppkey", "l_returnflag", ["A", "N", "R"], 20, "m").withColumn("macro_f1", F.round("macro_f1", 9))


@query("SELECT o_custkey, count(o_totalprice) AS n, round(stddev_samp(o_totalprice), 3) AS sd, round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS cv FROM orders GROUP BY 1")
def seed_sd(spark, d):
    s = P.seed_spread(table(spark, d, "orders"), "o_custkey", "o_totalprice")
    return s.withColumn("sd", F.round("sd", 3)).withColumn("cv", F.round("cv", 6))
