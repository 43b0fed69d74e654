"""Queries on accounts; customers and suppliers stand for clients, orders for images, line numbers for rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import accounting as A
from quern.plans.registry import query, table



def adopted(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_custkey") % 3).alias("n")), table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.concat(F.lit("C"), (F.col("o_custkey") % 4).cast("string")).alias("client"))


@query("SELECT client, count(u) AS n_total, count(*) FILTER (n > 0) AS n_defect, count(*) FILTER (n = 0) AS n_normal FROM (VALUES ('C0'), ('C1'), ('C2'), ('C3'), ('C9')) t(client) LEFT JOIN (SELECT o_orderkey AS u, o_custkey % 3 AS n, 'C' || o_custkey % 4 AS client FROM orders) USING (client) GROUP BY client")
def client_counts(spark, d):
    a, c = adopted(spark, d)
    return A.client_counts(a, c, ["C0", "C1", "C2", "C3", "C9"], "unit", "n")


@query("""
WITH a AS (SELECT o_orderkey AS unit, 'C' || o_custkey % 4 AS client, o_custkey % 3 AS n FROM orders UNION ALL SELECT o_orderkey, 'C' || o_custkey % 4, o_custkey % 3 FROM orders WHERE o_orderkey % 200 = 0),
c AS (SELECT client, count(*) + (client = 'C1')::INT AS t, count(*) FILTER (n > 0) AS p, count(*) FILTER (n = 0) - (client = 'C2')::INT AS q FROM a GROUP BY 1)
SELECT 'parts' AS "check", client AS key FROM c WHERE p + q <> t UNION ALL SELECT 'rows', 'all' WHERE (SELECT sum(t) FROM c) <> (SELECT count(*) FROM a) UNION ALL SELECT 'units', unit::VARCHAR FROM a GROUP BY unit HAVING count(*) > 1
UNION ALL SELECT 'discarded', 'all' WHERE 12 <> 10 UNION ALL SELECT 'negative', 'late'""")
def count_faults(spark, d):
    """Declared counts that do not add up: some are made wrong here."""
    a, c = adopted(spark, d)
    a = a.union(a.where("unit % 200 = 0"))
    counts = a.join(c, "unit").groupBy("client").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("n") > 0).alias("n_defect"), F.count_if(F.col("n") == 0).alias("n_normal"))
    counts = counts.select("client", (F.col("n_total") + (F.col("client") == "C1").cast("int")).alias("n_total"), "n_defect", (F.col("n_normal") - (F.col("client") == "C2").cast("int")).alias("n_normal"))
    gone = spark.createDataFrame([("early", 15), ("late", -3)], "stage string, n long")
    return A.count_faults(counts, a, gone, a.count() + 10, "unit")


@query("SELECT o_orderstatus AS split, o_orderpriority AS client, count(*) AS total, count(*) FILTER (o_totalprice > 150000) AS defect, count(*) FILTER (NOT o_totalprice > 150000) AS normal FROM orders GROUP BY 1, 2")
def counts_by_client(spark, d):
    o = table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "split", "o_orderpriority": "client"})
    return A.counts_by(o, ["split", "client"], F.col("o_totalprice") > 150000)


@query("""
WITH r AS (SELECT coalesce(lang, 'n/a') AS bucket, list_distinct(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN n_chars % 2 = 0 THEN 'short' END], lambda x: x IS NOT NULL)) AS r FROM documents)
SELECT bucket, reason, count(*) AS n FROM (SELECT bucket, unnest(r) AS reason FROM r) GROUP BY 1, 2""")
def crosstab_reasons(spark, d):
    n = F.col("n_chars")
    r = F.array_compact(F.array(F.when(n < 200, "short"), F.when(n > 5000, "long"), F.when(n % 2 == 0, "short")))
    return A.crosstab_reasons(table(spark, d, "documents").withColumn("r", r), F.col("lang"), "r")


@query("""
WITH p AS (SELECT source AS l, doc_id % 5 AS f, n_chars, lang FROM documents), v AS (SELECT l, f, unnest(['all', 'long', 'english']) AS variant, unnest([true, coalesce(n_chars > 500, false), coalesce(lang = 'en', false)]) AS ok FROM p),
g AS (SELECT variant, l, count(*) FILTER (ok) AS n, coalesce(sum(least(3, f)) FILTER (ok), 0) AS f FROM v GROUP BY 1, 2), w AS (SELECT variant, sum(n) AS n, sum(f) AS f FROM g GROUP BY 1)
SELECT variant, NULL AS without, n::BIGINT AS passages, (3 * n)::BIGINT AS upper, f::BIGINT AS facet_upper, greatest(0, 5000 - n)::BIGINT AS short FROM w UNION ALL SELECT variant, l, (w.n - g.n)::BIGINT, (3 * (w.n - g.n))::BIGINT, (w.f - g.f)::BIGINT, greatest(0, 5000 - w.n + g.n)::BIGINT FROM g JOIN w USING (variant)""")
def question_capacity(spark, d):
    docs = table(spark, d, "documents").withColumn("facets", F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (F.col("doc_id") % 5).cast("int")))
    return A.qa_capacity(docs, {"all": F.lit(True), "long": F.col("n_chars") > 500, "english": F.col("lang") == "en"}, "source", "facets", 3, 5000)


@query("""
WITH a AS (SELECT o_custkey AS c, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS c, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), j AS (SELECT a.v AS a, b.v AS b FROM a JOIN b USING (c))
SELECT count(*) AS clients, round(stddev_pop(a), 9) AS solo_sd, round(stddev_pop(b), 9) AS fed_sd, round(stddev_pop(b) - stddev_pop(a), 9) AS change FROM j""")
def gain_disparity(spark, d):
    from quern.operators.evaluation import gain_report

    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c"), "o_orderstatus").agg(F.count(F.lit(1)).alias("v"))
    out = A.disparity(gain_report(n.where("o_orderstatus = 'O'"), n.where("o_orderstatus = 'F'"), "c", "v"))
    return out.select("clients", *[F.round(c, 9).alias(c) for c in ("solo_sd", "fed_sd", "change")])


_LEDGER = "SELECT l_orderkey * 10 + l_linenumber AS seq, 'fed' AS cell, CASE l_linenumber % 2 WHEN 0 THEN 'f1' ELSE 'loss' END AS metric_name, 'c' || l_suppkey AS client_id, CASE WHEN l_partkey % 50 = 0 THEN 'x' ELSE (l_partkey % 20)::VARCHAR END AS round, CASE WHEN l_partkey % 31 = 0 THEN '' ELSE (l_quantity + l_linenumber)::VARCHAR END AS metric_value, l_partkey AS up, l_suppkey AS down FROM lineitem"


def ledger(spark, d):
    k = F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("fed").alias("cell"), F.when(F.col("l_linenumber") % 2 == 0, "f1").otherwise("loss").alias("metric_name"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("client_id"),
        F.when(k % 50 == 0, "x").otherwise((k % 20).cast("string")).alias("round"), F.when(k % 31 == 0, "").otherwise((F.col("l_quantity") + F.col("l_linenumber")).cast("string")).alias("metric_value"), k.alias("bytes_up"), F.col("l_suppkey").alias("bytes_down"),
    )


@query(f"""WITH l AS (SELECT client_id, seq, TRY_CAST(round AS BIGINT) AS r, TRY_CAST(metric_value AS DOUBLE) AS v FROM ({_LEDGER}) WHERE metric_name = 'f1')
SELECT client_id, r AS round, v AS value FROM l WHERE r IS NOT NULL AND v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY r DESC, seq DESC, v DESC) = 1""")
def last_client_values(spark, d):
    return A.last_values(ledger(spark, d).withColumn("seq", F.struct("seq", F.col("metric_value").try_cast("double").alias("v"))), "fed", "f1")


@query(f"""WITH l AS (SELECT client_id, TRY_CAST(round AS BIGINT) AS round, TRY_CAST(metric_value AS DOUBLE) AS v, up + down AS b FROM ({_LEDGER}) WHERE metric_name = 'f1'), s AS (SELECT client_id, round(avg(v), 6) AS solo FROM l GROUP BY 1),
g AS (SELECT round, count(DISTINCT client_id) AS clients, avg(v - solo) AS mean_gain, sum(b) AS b FROM l JOIN s USING (client_id) WHERE round IS NOT NULL GROUP BY 1) SELECT round, clients, round(mean_gain, 6) AS mean_gain, (sum(b) OVER (ORDER BY round))::BIGINT AS bytes FROM g""")
def gain_trajectory(spark, d):
    r = ledger(spark, d).withColumn("round", F.col("round").try_cast("long")).withColumn("metric_value", F.col("metric_value").try_cast("double"))
    solo = r.where("metric_name = 'f1'").groupBy("client_id").agg(F.round(F.avg("metric_value"), 6).alias("solo"))
    return A.trajectory(r.where("round is not null"), solo, "fed", "f1").withColumn("mean_gain", F.round("mean_gain", 6))


@query("SELECT c_mktsegment AS client, o_orderkey AS unit, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 > 0")
def attributed_values(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("value"), "o_custkey")
    c = table(spark, d, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("client"))
    return A.attributed(o.select("unit", "value"), o.join(c, "o_custkey").select("unit", "client"), "unit")


@query("""
WITH r AS (SELECT doc_id % 4 + 0.5 AS w, coalesce(quality = 1, false) AS q, coalesce(toxic = 1, false) AS t, coalesce(lang = 'en', false) AS e FROM documents LEFT JOIN labels USING (doc_id)),
x AS (SELECT w, unnest(['english', 'good_english', 'toxic_good', 'never']) AS i, unnest([e, q AND e, t AND q, false]) AS n, unnest([true, e, q, false]) AS d FROM r)
SELECT i AS indicator, round(CASE WHEN count(*) FILTER (d) > 0 THEN coalesce(sum(w) FILTER (n AND d), 0) / sum(w) FILTER (d) END, 9) AS weighted, round(CASE WHEN count(*) FILTER (d) > 0 THEN count(*) FILTER (n AND d) / count(*) FILTER (d) END, 9) AS unweighted, count(*) FILTER (d) AS n_eligible, CASE WHEN count(*) FILTER (d) > 0 THEN 'finite' ELSE 'not_applicable' END AS state FROM x GROUP BY 1""")
def indicator_rates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").withColumn("w", F.col("doc_id") % 4 + 0.5)
    q, t, e = F.col("quality") == 1, F.col("toxic") == 1, F.col("lang") == "en"
    out = A.indicator_rates(rows, {"english": (e, F.lit(True)), "good_english": (q, e), "toxic_good": (t, q), "never": (q, F.lit(False))}, "w")
    return out.withColumn("weighted", F.round("weighted", 9)).withColumn("unweighted", F.round("unweighted", 9))




def arrays(spark, d):
    """(client, key, integral, values): the first vector of each label and client; client 0 lacks none."""
    e = table(spark, d, "embeddings").where("embedding is not null").groupBy(F.col("label").alias("key"), (F.col("vec_id") % 3).alias("client")).agg(F.min_by("embedding", "vec_id").alias("v"))
    return e.select("client", "key", (F.col("key") % 2 == 1).alias("integral"), F.transform("v", lambda x: x.cast("double")).alias("values"))


@query("""
WITH e AS (SELECT label AS key, vec_id % 3 AS client, first(embedding ORDER BY vec_id) AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2), x AS (SELECT key, client, unnest(range(len(v))) AS i, unnest(v)::DOUBLE AS x FROM e)
SELECT key, i::INT AS i, round(CASE WHEN key % 2 = 1 THEN max(x) ELSE sum(x * (client + 1) / 6.0) END, 9) AS value FROM x GROUP BY 1, 2""")
def federated_means(spark, d):
    w = spark.createDataFrame([(i, i + 1) for i in range(3)], "client long, examples long")
    return A.federated_mean(arrays(spark, d), w).withColumn("value", F.round("value", 9))


@query("""
WITH e AS (SELECT label AS key, vec_id % 3 AS client, first(embedding ORDER BY vec_id) AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2)
SELECT a.key, round(avg(list_distance(a.v::DOUBLE[], b.v::DOUBLE[])), 9) AS distance FROM e a JOIN e b ON a.key = b.key AND a.client < b.client GROUP BY 1""")
def buffer_divergence(spark, d):
    return A.buffer_divergence(arrays(spark, d)).withColumn("distance", F.round("distance", 9))


@query("""
WITH e AS (SELECT label AS key, vec_id % 3 AS client, first(embedding ORDER BY vec_id) AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2), x AS (SELECT key, client, unnest(range(len(v))) AS i, unnest(v)::DOUBLE AS x FROM e WHERE key % 2 = 0),
m AS (SELECT key, i, sum(x * (client + 1) / 6.0) AS v FROM x GROUP BY 1, 2), n AS (SELECT sqrt(sum(x * x)) AS n FROM x GROUP BY client) SELECT round((SELECT sqrt(sum(v * v)) FROM m), 6) AS global_norm, round((SELECT max(n) FROM n), 6) AS largest, true AS ok""")
def mean_norms(spark, d):
    a = arrays(spark, d).where("key % 2 = 0")
    w = spark.createDataFrame([(i, i + 1) for i in range(3)], "client long, examples long")
    return A.norm_fault(a, A.federated_mean(a, w)).select(F.round("global_norm", 6).alias("global_norm"), F.round("largest", 6).alias("largest"), "ok")


@query("""
WITH r AS (SELECT l_orderkey AS round, CASE WHEN l_partkey % 23 = 0 THEN 'oom' END AS error, l_partkey % 19 > 0 AS content, CASE WHEN l_suppkey % 17 = 0 THEN '' WHEN l_suppkey % 13 = 0 THEN 'zz' ELSE 'aa' END AS digest FROM lineitem),
t AS (SELECT round, bool_or(error IS NOT NULL) AS e, count(*) FILTER (error IS NULL AND content) AS n, bool_or(error IS NULL AND content AND digest = '') AS o, bool_or(error IS NULL AND content AND digest <> 'aa') AS x FROM r GROUP BY 1)
SELECT round, CASE WHEN e THEN 'error' WHEN n <> 4 THEN 'missing' WHEN o THEN 'no_digest' WHEN x THEN 'digest' ELSE 'ok' END AS state FROM t""")
def round_states(spark, d):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("round"), F.when(k % 23 == 0, "oom").alias("error"), (k % 19 > 0).alias("content"), F.when(s % 17 == 0, "").when(s % 13 == 0, "zz").otherwise("aa").alias("digest"))
    return A.round_replies(r, 4, "aa")


_CELLS = """SELECT l_orderkey % 30 AS round, 'c' || l_linenumber AS client, max(CASE WHEN l_partkey % 9 = 0 THEN 4 ELSE 5 END) AS epochs_ran, min(CASE WHEN l_partkey % 7 = 0 THEN 3 END) AS epochs_here, max((l_partkey % 800 = 0)::INT) AS stopper_true, max(CASE WHEN l_partkey % 500 = 1 THEN 'Real' ELSE 'Null' END) AS stopper_class, min(3 + l_suppkey % 4) AS stopper_calls,
max(l_partkey % 6)::DOUBLE AS weight, CASE l_linenumber WHEN 1 THEN 'tokens' WHEN 2 THEN 'bytes' ELSE 'examples' END AS unit, max(l_partkey % 6) AS examples, max(l_partkey % 5) AS tokens, CASE WHEN l_linenumber = 3 THEN 'AdamW' ELSE 'SGD' END AS optimizer, CASE WHEN l_linenumber = 4 THEN 'auto' ELSE 'sgd' END AS arg_optimizer FROM lineitem WHERE l_orderkey % 30 <> 7 OR l_linenumber <> 2 GROUP BY l_orderkey % 30, l_linenumber"""


@query(f"""
WITH c AS ({_CELLS}), k AS (SELECT *, round || '/' || client AS k FROM c), g AS (SELECT r AS round, 'c' || i AS client FROM range(30) a(r), range(1, 9) b(i)), m AS (SELECT *, CASE unit WHEN 'tokens' THEN tokens WHEN 'examples' THEN examples END AS want FROM k)
SELECT 'missing' AS "check", round || '/' || client AS key FROM g ANTI JOIN c USING (round, client) UNION ALL SELECT 'epochs', k FROM k WHERE epochs_ran <> 5 UNION ALL SELECT 'total', client FROM (SELECT DISTINCT client FROM g) LEFT JOIN (SELECT client, sum(epochs_ran) AS t FROM c GROUP BY 1) USING (client) WHERE coalesce(t, 0) <> 150
UNION ALL SELECT 'stopped', k FROM k WHERE stopper_true > 0 UNION ALL SELECT 'stopper', k FROM k WHERE stopper_class NOT IN ('Null') UNION ALL SELECT 'calls', k FROM k WHERE stopper_calls < coalesce(epochs_here, epochs_ran) UNION ALL SELECT 'weight', k FROM k WHERE weight <= 0
UNION ALL SELECT 'units', 'all' WHERE (SELECT count(DISTINCT unit) FROM c) > 1 UNION ALL SELECT 'unit', k FROM m WHERE want IS NULL OR abs(weight - want) > 1e-6 UNION ALL SELECT 'optimizers', 'all' WHERE (SELECT count(DISTINCT optimizer) FROM c) > 1
UNION ALL SELECT 'auto', k FROM k WHERE lower(arg_optimizer) = 'auto' UNION ALL SELECT 'optimizer', k FROM k WHERE NOT starts_with(lower(optimizer), substr(lower(arg_optimizer), 1, 3))""")
def budget_faults(spark, d):
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    li = table(spark, d, "lineitem").withColumn("round", F.col("l_orderkey") % 30).where((F.col("round") != 7) | (n != 2))
    c = li.groupBy("round", n).agg(
        F.max(F.when(k % 9 == 0, 4).otherwise(5)).alias("epochs_ran"), F.min(F.when(k % 7 == 0, 3)).alias("epochs_here"), F.max((k % 800 == 0).cast("int")).alias("stopper_true"), F.max(F.when(k % 500 == 1, "Real").otherwise("Null")).alias("stopper_class"), F.min(3 + s % 4).alias("stopper_calls"),
        F.max(k % 6).cast("double").alias("weight"), F.max(k % 6).alias("examples"), F.max(k % 5).alias("tokens"),
    )
    c = c.select("*", F.concat(F.lit("c"), n.cast("string")).alias("client"), F.when(n == 1, "tokens").when(n == 2, "bytes").otherwise("examples").alias("unit"), F.when(n == 3, "AdamW").otherwise("SGD").alias("optimizer"), F.when(n == 4, "auto").otherwise("sgd").alias("arg_optimizer"))
    return A.budget_faults(c, 30, [f"c{i}" for i in range(1, 9)], 5, ["Null"])


@query("""
WITH s AS (SELECT l_returnflag AS model, l_linestatus AS point, l_linenumber AS seed, avg(l_quantity) AS f1, CASE WHEN l_linenumber <> 2 THEN max(l_tax) END AS loss FROM lineitem GROUP BY 1, 2, 3)
SELECT model, point, m AS metric, count(v) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(min(v), 9) AS least, round(max(v), 9) AS most FROM (SELECT model, point, unnest(['f1', 'loss']) AS m, unnest([f1, loss]) AS v FROM s) WHERE v IS NOT NULL GROUP BY 1, 2, 3""")
def metric_summaries(spark, d):
    li = table(spark, d, "lineitem")
    s = li.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("point"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_quantity").alias("f1"), F.max("l_tax").alias("t")).withColumn("loss", F.when(F.col("seed") != 2, F.col("t")))
    return A.metric_summaries(s, ["model", "point"], ["f1", "loss"]).select("model", "point", "metric", "n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "least", "most")])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'third' WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS won FROM orders")
def merged_segments(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return A.merged_segments([o.withColumn("won", F.lit("first")), o.where("o_orderkey % 2 = 0").withColumn("won", F.lit("second")), o.where("o_orderkey % 3 = 0").withColumn("won", F.lit("third"))], "o_orderkey")


@query("""
WITH r AS (SELECT l_suppkey AS axis, l_linenumber AS place, count(*) + 10 - l_linenumber AS n_in, CASE WHEN l_suppkey % 6 + 1 >= l_linenumber THEN count(*) END AS n_pass FROM lineitem GROUP BY 1, 2)
SELECT axis, min_by(n_in, place) AS n_in, max_by(n_pass, place) FILTER (n_pass IS NOT NULL) AS n_accepted, round(max_by(n_pass, place) FILTER (n_pass IS NOT NULL) / min_by(n_in, place), 9) AS rate FROM r GROUP BY 1""")
def stage_rates(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("axis"), F.col("l_linenumber").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    r = r.select("axis", "place", (F.col("n") + 10 - F.col("place")).alias("n_in"), F.when(F.col("axis") % 6 + 1 >= F.col("place"), F.col("n")).alias("n_pass"))
    return A.stage_rates(r, "axis", "place").withColumn("rate", F.round("rate", 9))


@query("""
WITH g AS (SELECT o_orderpriority AS stratum, o_custkey AS grp, count(*) AS k, count(*) FILTER (o_custkey % 5 = 0) AS c FROM orders GROUP BY 1, 2), t AS (SELECT stratum, sum(k) AS n, sum(c) AS c, max(k) AS m FROM g GROUP BY 1)
SELECT stratum, n::BIGINT AS n, c::BIGINT AS n_chosen, round(c / n, 9) AS share, round(greatest(0.02, m / n), 9) AS band, abs(c / n - 0.2) <= greatest(0.02, m / n) AS ok FROM t""")
def band_by_largest_group(spark, d):
    o = table(spark, d, "orders").withColumnsRenamed({"o_orderpriority": "stratum", "o_custkey": "grp"})
    out = A.band_report(o, "stratum", "grp", F.col("grp") % 5 == 0, 0.2)
    return out.withColumn("share", F.round("share", 9)).withColumn("band", F.round("band", 9))


@query("""
WITH r AS (SELECT p_brand, array_to_string(list_distinct([p_type, split_part(p_name, ' ', 2)]), ';') AS labels, CASE WHEN p_size % 4 > 0 THEN 'C' || p_size % 4 END AS client FROM part), e AS (SELECT p_brand, unnest(string_split(labels, ';')) AS label, coalesce(client, 'eval') AS client FROM r)
SELECT p_brand, label, count(*) FILTER (client = 'C1') AS "C1", count(*) FILTER (client = 'C2') AS "C2", count(*) FILTER (client = 'C3') AS "C3", count(*) FILTER (client = 'eval') AS eval FROM e GROUP BY 1, 2""")
def label_heatmap(spark, d):
    """Counts of joined labels, pivoted by client."""
    z = F.col("p_size")
    r = table(spark, d, "part").select("p_brand", F.array_join(F.array_distinct(F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(2)))), ";").alias("labels"), F.when(z % 4 > 0, F.concat(F.lit("C"), (z % 4).cast("string"))).alias("client"))
    return A.heatmap(r, "p_brand", "labels", "client", ["C1", "C2", "C3"], "eval")


@query("SELECT o_custkey AS grp, count(*) AS n_units, sum(o_orderkey % 4)::BIGINT AS total, 'M' || o_custkey % 3 AS material FROM orders GROUP BY o_custkey")
def eval_groups(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(c.alias("grp"), k.alias("unit"), (k % 4).cast("string").alias("n"), F.concat(F.lit("M"), (c % 3).cast("string")).alias("material"))
    return A.eval_groups(o, "grp", "unit", "material", "n")
