"""All registered queries of the library and the SQL that gives the same rows.

The tables stand for the engine's own: orders for images, lineitem for defects, customers for groups, nations for strata.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import ordered as O
from quern.operators import relational as R
from quern.operators import scoring as P
from quern.plans.registry import ORACLES, QUERIES  # noqa: F401
from quern.plans.registry import query as _query
from quern.plans.registry import table as _t

FLAGSHIP = "stratified_sample"


@_query("""
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'normal' ELSE 'defect' END AS row_kind, coalesce(l_linenumber, 0) AS line
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey""")
def join_defects(spark, d):
    child = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    out = R.left_join_checked(_t(spark, d, "orders").select("o_orderkey"), child, "o_orderkey")
    return out.select("o_orderkey", F.when(F.col("l_linenumber").isNull(), "normal").otherwise("defect").alias("row_kind"), F.coalesce("l_linenumber", F.lit(0)).alias("line"))


@_query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY sha256(text)")
def drop_exact_duplicates(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return R.first_of_equal(docs, F.col("sha"), "doc_id")


@_query("""
WITH g AS (SELECT c_custkey AS grp, c_nationkey AS stratum FROM customer),
p AS (SELECT stratum, count(*) AS G_h, (SELECT count(*) FROM g) AS pop FROM g GROUP BY stratum),
n AS (SELECT stratum, G_h, CASE WHEN 200 >= pop THEN G_h ELSE least(G_h, greatest(2, (2 * 200 * G_h + pop) // (2 * pop))) END AS n_h FROM p),
r AS (SELECT grp, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('s1|' || grp), grp) AS place FROM g)
SELECT grp, stratum, CAST(G_h AS BIGINT) AS G_h, CAST(n_h AS BIGINT) AS n_h, CAST(place AS INTEGER) AS place FROM r JOIN n USING (stratum) WHERE place <= n_h""")
def stratified_sample(spark, d):
    g = _t(spark, d, "customer").select(F.col("c_custkey").alias("grp"), F.col("c_nationkey").alias("stratum"))
    return R.stratified_sample(g, "grp", "stratum", 200, "s1").select("grp", "stratum", "G_h", "n_h", "place")


@_query("""
SELECT o_custkey, CASE WHEN sum(n) = 0 THEN '0' WHEN 2 * sum(n) < 3 * count(*) THEN '1' WHEN 2 * sum(n) < 7 * count(*) THEN '2-3' ELSE '4+' END AS band
FROM (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS n FROM orders) GROUP BY o_custkey""")
def group_band(spark, d):
    n = _t(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    g = _t(spark, d, "orders").select("o_custkey", "o_orderkey").join(n, "o_orderkey", "left").groupBy("o_custkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("k"))
    return g.select("o_custkey", S.band(F.col("t"), F.col("k")).alias("band"))


@_query("""
SELECT user_id, event_id, max(start) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run_start
FROM (SELECT user_id, event_id, CASE WHEN lag(event_id) OVER w IS NULL OR event_id - lag(event_id) OVER w > 50 THEN event_id END AS start
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def build_runs(spark, d):
    return O.run_starts(_t(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 50)


@_query("""
WITH g AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS label FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS label FROM lineitem WHERE l_quantity > 20)
SELECT label, sum((g.unit IS NOT NULL AND p.unit IS NOT NULL)::INT)::BIGINT AS tp, sum((g.unit IS NULL)::INT)::BIGINT AS fp, sum((p.unit IS NULL)::INT)::BIGINT AS fn,
count(g.unit) AS support, round(2 * sum((g.unit IS NOT NULL AND p.unit IS NOT NULL)::INT) / (count(*) + sum((g.unit IS NOT NULL AND p.unit IS NOT NULL)::INT)), 9) AS f1
FROM g FULL JOIN p USING (unit, label) GROUP BY label""")
def set_f1(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("label"), "l_quantity")
    out = P.label_scores(P.count_table(rows, rows.where("l_quantity > 20"), "unit", "label"), "label")
    return out.withColumn("f1", F.round("f1", 9))


@_query("""
WITH g AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS label FROM lineitem WHERE l_quantity > 10),
p AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS label FROM lineitem WHERE l_quantity < 40)
SELECT unit, round(sum((g.label IS NOT NULL AND p.label IS NOT NULL)::INT) / count(*), 9) AS jaccard
FROM g FULL JOIN p USING (unit, label) GROUP BY unit""".replace("g.label IS NOT NULL AND p.label IS NOT NULL", "a AND b").replace("FROM g FULL JOIN p USING (unit, label)", "FROM (SELECT unit, label, bool_or(src = 1) AS a, bool_or(src = 2) AS b FROM (SELECT *, 1 AS src FROM g UNION ALL SELECT *, 2 FROM p) GROUP BY unit, label)"))
def class_jaccard(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("label"), "l_quantity")
    counts = P.count_table(rows.where("l_quantity > 10"), rows.where("l_quantity < 40"), "unit", "label")
    return P.unit_jaccard(counts, "unit").withColumn("jaccard", F.round("jaccard", 9))


@_query("""
WITH t AS (SELECT n_chars AS s, count(*) AS n, sum(toxic) AS pos FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
r AS (SELECT pos, sum(n) OVER (ORDER BY s DESC) AS n, sum(pos) OVER (ORDER BY s DESC) AS hits FROM t)
SELECT round(sum(pos * hits / n) / sum(pos), 9) AS ap FROM r""")
def image_level_ap(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return P.average_precision(rows, "n_chars", "toxic").select(F.round("ap", 9).alias("ap"))


@_query("""
SELECT coalesce(lang, 'n/a') AS bucket, count(*) AS n_in, sum((n_chars > 1000)::INT)::BIGINT AS n_pass, count(*) - sum((n_chars > 1000)::INT)::BIGINT AS n_fail,
round(sum((n_chars > 1000)::INT) / count(*), 4) AS pass_rate FROM documents GROUP BY 1""")
def bucket_crosstab(spark, d):
    return P.crosstab(_t(spark, d, "documents"), F.col("lang"), F.col("n_chars") > 1000)


@_query("""
WITH s AS (SELECT o_custkey, o_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT o_custkey, codes, count(*) AS n FROM s GROUP BY 1, 2)
SELECT o_custkey, codes, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, codes) AS r FROM n) WHERE r = 1""")
def majority_codeset(spark, d):
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return P.majority_set(rows.select("o_custkey", "o_orderkey", "l_returnflag"), "o_custkey", "o_orderkey", "l_returnflag")


_RULES = "('A', 0, 10, 'A1'), ('A', 10, 30, 'A2'), ('A', 25, NULL, 'A3'), ('N', NULL, 20, 'N1'), ('R', 5, 45, 'R1')"


@_query(f"""
WITH r(flag, lo, hi, clause) AS (VALUES {_RULES}), q AS (SELECT DISTINCT l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
j AS (SELECT q.flag, q.q, count(DISTINCT clause) AS n, min(clause) AS c FROM q LEFT JOIN r ON q.flag = r.flag AND (lo IS NULL OR q >= lo) AND (hi IS NULL OR q < hi) GROUP BY 1, 2)
SELECT flag, q, CASE WHEN n = 1 THEN c END AS clause, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'ok' ELSE 'multiple' END AS state FROM j""")
def clause_lookup(spark, d):
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES} AS r(flag, lo, hi, clause)")
    q = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("q")).distinct()
    return R.rule_lookup(q, rules, ["flag"], "q")


@_query("""
WITH i AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS lo, l_partkey + 40 AS hi FROM lineitem),
b AS (SELECT *, max(hi) OVER (PARTITION BY s ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
SELECT s, lo, hi, CASE WHEN lo > before THEN 'gap' ELSE 'overlap' END AS fault FROM b WHERE lo <> before""")
def interval_faults(spark, d):
    """The distinct intervals of all lines."""
    i = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + 40).alias("hi")).distinct()
    return R.interval_faults(i, ["s"])


@_query("""
WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, l_linenumber * 3 AS x1, l_linenumber * 2 AS y1, l_linenumber * 3 + CAST(l_quantity AS BIGINT) AS x2, l_linenumber * 2 + 20 AS y2 FROM lineitem),
p AS (SELECT a.o, a.n AS a, c.n AS b, greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS i,
 (a.x2 - a.x1) * 20 + (c.x2 - c.x1) * 20 AS s FROM b a JOIN b c ON a.o = c.o AND a.n < c.n)
SELECT o, a, b, i / (s - i) >= 0.5 AS half, round(i / (s - i), 9) AS iou FROM p""")
def box_iou(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    b = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), n.alias("n"), (n * 3).alias("x1"), (n * 2).alias("y1"), (n * 3 + q).alias("x2"), (n * 2 + 20).alias("y2"))
    box = lambda k: tuple(F.col(f"{k}.{c}") for c in ("x1", "y1", "x2", "y2"))
    j = b.alias("a").join(b.alias("c"), (F.col("a.o") == F.col("c.o")) & (F.col("a.n") < F.col("c.n")))
    return j.select("a.o", F.col("a.n").alias("a"), F.col("c.n").alias("b"), S.at_least_half(box("a"), box("c")).alias("half"), F.round(S.iou(box("a"), box("c")), 9).alias("iou"))


@_query("""
SELECT l_orderkey, l_linenumber, CAST(floor((l_tax - 0.04) * 1000 + 0.5) AS BIGINT) AS q,
least(greatest(l_partkey - 50, 0), 100) AS x, CASE WHEN l_partkey - 50 < 0 AND l_partkey - 50 >= -1 THEN 0 WHEN l_partkey - 50 > 100 AND l_partkey - 50 <= 101 THEN 100 ELSE l_partkey - 50 END AS s FROM lineitem""")
def box_scalars(spark, d):
    v = F.col("l_partkey") - 50
    x = S.clamp_box((v, v, v, v), F.lit(100), F.lit(100))[0]
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.round_half_up((F.col("l_tax") - 0.04) * 1000).alias("q"), x.cast("long").alias("x"), S.snap(v, F.lit(100)).cast("long").alias("s"))


@_query("""
SELECT c_custkey, sha256('k|' || c_custkey) AS k, CAST(('0x' || substr(sha256(c_custkey || '|7'), 1, 16))::UBIGINT % 13 AS BIGINT) AS i FROM customer""")
def hash_order(spark, d):
    c = F.col("c_custkey")
    return _t(spark, d, "customer").select("c_custkey", S.order_key("k", c).alias("k"), S.pick_index(c, 7, 13).alias("i"))


@_query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append(range(0, p_size * 10 - 64 + 1, 48), greatest(p_size * 10 - 64, 0)))), ',') AS origins FROM part WHERE p_size >= 7""")
def candidate_origins(spark, d):
    return _t(spark, d, "part").where("p_size >= 7").select("p_partkey", F.array_join(S.origins(F.col("p_size") * 10, 64, 48).cast("array<string>"), ",").alias("origins"))


@_query("""
WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'const' WHEN 1 THEN 'prop_t' WHEN 2 THEN 'prop_t_cap' ELSE 'none_permitted' END AS rule, p_size AS t FROM part)
SELECT p_partkey, CAST(CASE rule WHEN 'const' THEN 3.005 WHEN 'prop_t' THEN round(0.135 * t::DECIMAL(10,0), 2) WHEN 'prop_t_cap' THEN least(round(0.135 * t::DECIMAL(10,0), 2), 2.50) END AS DECIMAL(18,2)) AS lim,
CASE WHEN rule = 'none_permitted' THEN 'FAIL' WHEN 2 <= CASE rule WHEN 'const' THEN 3.01 WHEN 'prop_t' THEN round(0.135 * t::DECIMAL(10,0), 2) ELSE least(round(0.135 * t::DECIMAL(10,0), 2), 2.50) END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""")
def rule_verdict(spark, d):
    k = F.col("p_size") % 4
    rule = F.when(k == 0, "const").when(k == 1, "prop_t").when(k == 2, "prop_t_cap").otherwise("none_permitted")
    dec = lambda x: F.lit(x).cast("decimal(10,3)")
    lim = S.effective_limit(rule, dec("3.005"), dec("0.135"), dec("2.5"), F.col("p_size").cast("decimal(10,0)"))
    return _t(spark, d, "part").select("p_partkey", lim.alias("lim"), S.verdict(dec("2"), lim, F.lit("le"), rule).alias("verdict"))


@_query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS sha FROM documents""")
def canonical_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(S.collapsed(F.col("text")).cast("binary"), 256).alias("sha"))


@_query(r"""
SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?'), lambda x: CAST(replace(x, ',', '') AS DECIMAL(38,4)))))::INT AS n FROM documents""")
def numbers_in(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(S.numbers(F.col("text"))).alias("n"))


@_query("SELECT coalesce(lang, 'n/a') AS lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source) HAVING source IS NOT NULL AND grouping(lang) = 0")
def distribution_heatmap(spark, d):
    docs = _t(spark, d, "documents")
    return docs.groupBy(F.coalesce("lang", F.lit("n/a")).alias("lang"), "source").agg(F.count(F.lit(1)).alias("n")).where("source is not null")


@_query("""
WITH g AS (SELECT c_nationkey AS g, sum(c_custkey % 7)::BIGINT AS num, count(*) AS den FROM customer GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY sha256('b|' || g)) - 1 AS k, count(*) OVER () AS n FROM g),
p AS (SELECT draw, CAST(('0x' || substr(sha256('b|' || draw || '|' || i), 1, 12))::BIGINT % (SELECT max(n) FROM k) AS BIGINT) AS k FROM range(50) t(draw), range(200) u(i) WHERE i < (SELECT max(n) FROM k))
SELECT draw, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den FROM p JOIN k USING (k) GROUP BY draw""")
def cluster_bootstrap(spark, d):
    u = _t(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 7).alias("num"), F.lit(1).alias("den"))
    return P.bootstrap_ratio(u, "g", "num", "den", 50, "b")


@_query("""
WITH v AS (SELECT c_custkey % 1000 AS v FROM customer), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM v)
SELECT max(CASE WHEN r = (n - 1) * 25 // 1000 THEN v END) AS lo, max(CASE WHEN r = n - 1 - (n - 1) * 25 // 1000 THEN v END) AS hi FROM r""")
def rank_interval(spark, d):
    return P.rank_interval(_t(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("v")), "v")


@_query("""
WITH p AS (SELECT l_suppkey AS a, l_partkey AS b, sum(CAST(l_quantity AS BIGINT))::BIGINT AS s FROM lineitem GROUP BY 1, 2),
ra AS (SELECT a, b FROM p QUALIFY s = max(s) OVER (PARTITION BY a) AND count(*) OVER (PARTITION BY a, s) = 1),
rb AS (SELECT a, b FROM p QUALIFY s = max(s) OVER (PARTITION BY b) AND count(*) OVER (PARTITION BY b, s) = 1)
SELECT a, b FROM ra JOIN rb USING (a, b)""")
def mutual_pairs(spark, d):
    p = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.sum(F.col("l_quantity").cast("long")).alias("s"))
    return R.mutual_best(p, "a", "b", "s")


@_query("""
SELECT o_orderstatus AS split, count(*) AS total, count(*) FILTER (o_totalprice > 150000) AS defect, count(*) FILTER (NOT o_totalprice > 150000) AS normal FROM orders GROUP BY 1""")
def counts_by_split(spark, d):
    high = (F.col("o_totalprice") > 150000).cast("int")
    return _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count(F.lit(1)).alias("total"), F.sum(high).alias("defect"), F.sum(1 - high).alias("normal"))


from quern.plans import accounting, checks, clauses, contracts, evaluation, generated, geometry, kernels, matching, records, reports, resampling, rules, snapshots, splits, splitting, texts  # noqa: E402, F401  (they register their queries)
