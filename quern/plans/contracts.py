"""Queries on row contracts; orders stand for images, their lines for skeletons, parts for rules, documents for passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import contracts as C
from quern.plans.registry import query, table


def _cat(*parts):
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


@query("""
WITH s AS (SELECT l_orderkey AS unit, CASE WHEN l_quantity > 45 THEN 'FAIL' ELSE 'PASS' END AS v, 'C' || l_suppkey % 5 AS c, l_tax > 0.07 AS t, substr('BCD', 1 + (l_partkey % 3)::INT, 1) AS lv FROM lineitem WHERE l_quantity > 20),
g AS (SELECT unit, count(*) AS n, bool_or(v = 'FAIL') AS f, array_to_string(list(DISTINCT c ORDER BY c), ';') AS cited, bool_or(t) AS t, CASE WHEN count(DISTINCT lv) = 1 THEN min(lv) END AS level FROM s GROUP BY 1)
SELECT o_orderkey AS unit, coalesce(n, 0) AS n, CASE WHEN f THEN 'FAIL' ELSE 'PASS' END AS verdict, coalesce(cited, '') AS cited, CASE WHEN t THEN 'conditional' ELSE 'confirmed' END AS verdict_type, level, o_orderkey || CASE WHEN n IS NULL THEN '-normal' ELSE '-pair' END AS sample_id FROM orders LEFT JOIN g ON unit = o_orderkey""")
def assembled_pairs(spark, d):
    k = F.col("l_partkey") % 3
    s = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("unit"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")).alias("image_id"), F.when(F.col("l_quantity") > 45, "FAIL").otherwise("PASS").alias("verdict"), _cat("C", F.col("l_suppkey") % 5).alias("clause"), (F.col("l_tax") > 0.07).alias("conditional"), F.when(k == 0, "B").when(k == 1, "C").otherwise("D").alias("level"))
    return C.assembled(s, table(spark, d, "orders").select(F.col("o_orderkey").alias("unit")), "unit")


_RULE = """SELECT p_partkey AS rule_id, p_size % 6 > 0 AS active, 'D' || (p_partkey % 30) AS code, CASE p_partkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'ST' ELSE 'AL' END AS material, CASE p_partkey % 4 WHEN 0 THEN 'VT' WHEN 1 THEN 'ALL' ELSE 'RT' END AS method, 'C' || (p_partkey % 30 % 7) AS clause,
CASE p_partkey % 4 WHEN 0 THEN 'none_permitted' WHEN 1 THEN 'const' WHEN 2 THEN 'prop_t' ELSE 'prop_t_cap' END AS rule, p_size % 10 AS a, p_size % 3 AS z FROM part"""
_TEXT = f"""SELECT *, CASE z WHEN 0 THEN '' WHEN 1 THEN a || ' mm 초과' ELSE a || '.5 mm 이상' END AS l, CASE WHEN a % 4 = 0 THEN NULL WHEN a % 4 = 1 THEN (a + 10) || ' mm 이하' ELSE (a + 10) || ' mm 미만' END AS r,
CASE rule WHEN 'none_permitted' THEN '크기와 무관하게 허용하지 않는다' WHEN 'const' THEN (a + 1) || '.25 ' || CASE WHEN a % 2 = 0 THEN 'mm' ELSE '%' END || ' 이하' WHEN 'prop_t' THEN '모재 두께의 0.' || (a + 1) % 10 || ' 배 미만' ELSE '용접부 공칭 두께의 0.' || (a + 1) % 10 || ' 배 이하이고 최대 ' || (a + 2) || ' ' || CASE WHEN a % 2 = 0 THEN 'mm' ELSE '%' END END AS crit FROM ({_RULE})"""
_TEXT2 = f"SELECT *, CASE WHEN r IS NULL THEN CASE WHEN l = '' THEN '모든 두께' ELSE l END ELSE trim(l || ' ' || r) END AS band FROM ({_TEXT})"


def rules(spark, d):
    k, z3, a = F.col("p_partkey"), F.col("p_size") % 3, F.col("p_size") % 10
    dec = lambda c: c.cast("decimal(18,2)")
    rule = F.when(k % 4 == 0, "none_permitted").when(k % 4 == 1, "const").when(k % 4 == 2, "prop_t").otherwise("prop_t_cap")
    lo = F.when(z3 == 0, dec(F.lit(0))).when(z3 == 1, dec(a + F.lit("0.01").cast("decimal(4,2)"))).otherwise(dec(a + F.lit("0.50").cast("decimal(4,2)")))
    hi = F.when(a % 4 == 0, F.lit(None)).when(a % 4 == 1, dec(a + F.lit("10.01").cast("decimal(4,2)"))).otherwise(dec(a + 10))
    r = table(spark, d, "part").select(
        k.alias("rule_id"), (F.col("p_size") % 6 > 0).alias("active"), _cat("D", k % 30).alias("code"), F.when(k % 3 == 0, "ALL").when(k % 3 == 1, "ST").otherwise("AL").alias("material"), F.when(k % 4 == 0, "VT").when(k % 4 == 1, "ALL").otherwise("RT").alias("method"),
        _cat("C", k % 30 % 7).alias("clause"), rule.alias("rule"), lo.alias("lo"), dec(hi).alias("hi"), dec(a + F.lit("1.25").cast("decimal(4,2)")).alias("value"), dec(((a + 1) % 10) / 10).alias("factor"), dec(a + 2).alias("cap"),
        F.when(k % 4 == 3, "s").otherwise("t").alias("basis"), F.when(k % 4 == 2, "lt").otherwise("le").alias("op"), F.when(a % 2 == 0, "mm").otherwise("percent").alias("unit"),
    )
    criterion = C.criterion_text(F.col("rule"), F.col("value"), F.col("factor"), F.col("cap"), F.col("basis"), F.col("op"), F.col("unit"))
    return r.withColumn("band", C.thickness_text(F.col("lo"), F.col("hi"))).withColumn("criterion", criterion)


_CRIT = "CASE WHEN rule IN ('prop_t', 'prop_t_cap') AND (a + 1) % 10 = 0 THEN replace(crit, '0.0', '0') ELSE crit END"


@query(f"SELECT rule_id, band, {_CRIT} AS criterion FROM ({_TEXT2})")
def rule_texts(spark, d):
    """Thickness intervals and criteria in words."""
    return rules(spark, d).select("rule_id", "band", "criterion")


@query(f"""WITH t AS (SELECT *, CASE band WHEN '모든 두께' THEN band ELSE '두께 ' || band END || ': ' || {_CRIT} AS text FROM ({_TEXT2}) WHERE active AND method IN ('RT', 'ALL') AND material IN ('ST', 'ALL'))
SELECT code, min(clause) AS clause, string_agg(text, ' / ' ORDER BY rule_id) AS criteria, (SELECT string_agg(k, ';' ORDER BY f) FROM (SELECT k, min(i) AS f FROM (SELECT unnest(ks) AS k, unnest(range(len(ks))) AS i) GROUP BY 1)) AS kinds FROM (SELECT code, clause, rule_id, text, list(rule) OVER (PARTITION BY code ORDER BY rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ks FROM t) GROUP BY code, ks""")
def clause_basis(spark, d):
    """Per code the clause and its criteria for radiography of steel."""
    r = rules(spark, d)
    head = F.when(F.col("band") == C.ALL_SIZES, F.col("band")).otherwise(F.concat(F.lit("두께 "), "band"))
    return C.clause_basis(r.withColumn("text", F.concat(head, F.lit(": "), "criterion")), "RT", "ST")


_JUDGE = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, l_suppkey AS s, l_quantity AS q, CASE l_partkey % 4 WHEN 0 THEN 'none_permitted' ELSE 'const' END AS rule, CASE l_suppkey % 2 WHEN 0 THEN 'le' ELSE 'lt' END AS op, ((l_suppkey % 40 + 5) / 2)::DECIMAL(18,2) AS lim, (l_quantity / 2 + l_linenumber / 100)::DECIMAL(18,2) AS m FROM lineitem"""


@query(f"SELECT DISTINCT id, p, s, q, CASE WHEN rule = 'none_permitted' THEN 'FAIL' WHEN CASE op WHEN 'lt' THEN m < lim ELSE m <= lim END THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN rule <> 'none_permitted' THEN (lim - m)::DOUBLE END AS margin FROM ({_JUDGE})")
def judged_margins(spark, d):
    """Verdicts with their margins."""
    return _judge(spark, d).select("id", "p", "s", "q", "j.verdict", F.col("j.margin").cast("double").alias("margin")).distinct()


def _judge(spark, d):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    r = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), k.alias("p"), s.alias("s"), F.col("l_quantity").alias("q"), F.when(k % 4 == 0, "none_permitted").otherwise("const").alias("rule"), F.when(s % 2 == 0, "le").otherwise("lt").alias("op"),
        ((s % 40 + 5) / 2).cast("decimal(18,2)").alias("lim"), (F.col("l_quantity") / 2 + F.col("l_linenumber") / 100).cast("decimal(18,2)").alias("m"),
    )
    return r.withColumn("j", C.judged(F.col("m"), F.col("lim"), F.col("op"), F.col("rule")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'premise' ELSE 'mix' END AS kind, CASE WHEN o_orderkey % 3 > 0 THEN 'K' || o_custkey % 4 END AS class FROM orders")
def condition_tokens(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    token = F.when(k % 3 == 0, "premise").otherwise(_cat("mix:K", c % 4))
    return table(spark, d, "orders").select(k, C.condition_token(token, ["premise", "gap"], ["mix", "far"], [f"K{i}" for i in range(4)]).alias("t")).select("o_orderkey", "t.*")


@query("""
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_custkey END AS rid, (o_orderkey % 50 + 1)::DECIMAL(18,2) AS m, 30::DECIMAL(18,2) + (o_orderkey % 37 = 0)::INT AS lim, CASE WHEN (o_orderkey % 50 + 1 <= 30) = (o_orderkey % 41 > 0) THEN 'PASS' ELSE 'FAIL' END AS v, 30 - (o_orderkey % 50 + 1) + (o_orderkey % 43 = 0)::INT AS mg, (o_orderkey % 50 + 1) + (o_orderkey % 47 = 0)::INT AS lo FROM orders)
SELECT 'rule' AS "check", k::VARCHAR AS key FROM s WHERE rid = -1 UNION ALL SELECT 'limit', k::VARCHAR FROM s WHERE rid <> -1 AND k % 37 = 0 UNION ALL SELECT 'verdict', k::VARCHAR FROM s WHERE rid <> -1 AND k % 41 = 0 UNION ALL SELECT 'margin', k::VARCHAR FROM s WHERE rid <> -1 AND k % 43 = 0 UNION ALL SELECT 'bucket', k::VARCHAR FROM s WHERE rid <> -1 AND k % 47 = 0""")
def skeleton_faults(spark, d):
    """Skeletons against their rules, with faults of each kind."""
    k, dec = F.col("o_orderkey"), lambda c: c.cast("decimal(18,2)")
    m = k % 50 + 1
    one = lambda n: (k % n == 0).cast("int")
    s = table(spark, d, "orders").select(
        k.cast("string").alias("sample_id"), F.when(k % 31 == 0, -1).otherwise(F.col("o_custkey")).alias("rule_id"), dec(m).alias("measured"), dec(30 + one(37)).alias("limit"), F.when((m <= 30) == (k % 41 > 0), "PASS").otherwise("FAIL").alias("verdict"),
        dec(30 - m + one(43)).alias("margin"), F.lit("pass").alias("bucket"), dec(m + one(47)).alias("lo"), dec(m + 2).alias("hi"),
    )
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("rule_id"), F.lit("const").alias("rule"), F.lit("le").alias("op"), dec(F.lit(30)).alias("own_limit"))
    return C.skeleton_faults(s, r)


@query("SELECT 'D' || p_partkey || '|' || p_size || '|' || CASE WHEN p_size % 2 = 0 THEN 'inf' ELSE (p_size + 5)::VARCHAR END || '|S|B' AS key, p_partkey AS rule_id FROM part WHERE p_size % 6 > 0 AND p_partkey % 4 > 0 AND p_partkey % 5 IN (0, 1, 2) AND p_partkey % 7 > 0")
def rule_combos(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    r = table(spark, d, "part").select(k.alias("rule_id"), (z % 6 > 0).alias("active"), (k % 4 > 0).alias("canonical"), F.when(k % 5 == 0, "ALL").when(k % 5 < 3, "RT").otherwise("VT").alias("method"), F.when(k % 7 == 0, "a").otherwise("t").alias("basis"), _cat("D", k).alias("code"), z.alias("lo"), F.when(z % 2 > 0, z + 5).alias("hi"), F.lit("S").alias("scheme"), F.lit("B").alias("level"))
    return C.rule_combos(r, "RT")


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 AS t, o_custkey % 40 AS q FROM orders), f AS (SELECT q, min(k) AS first FROM r WHERE t <> 0 GROUP BY 1)
SELECT k, array_to_string(list_filter([CASE WHEN t = 0 THEN 'schema_question' END, CASE WHEN t = 1 THEN 'schema_answer' END, CASE WHEN t IN (2, 3) THEN 'schema_evidence' END, CASE WHEN t = 4 THEN 'evidence' END, CASE WHEN t <> 0 AND k > first THEN 'duplicate' END, CASE WHEN t = 5 THEN 'length' END], lambda x: x IS NOT NULL), '+') AS reasons FROM r LEFT JOIN f USING (q)""")
def question_reasons(spark, d):
    """Questions with all reasons against them; equal ones in any writing are duplicates of the first."""
    k, q = F.col("o_orderkey"), (F.col("o_custkey") % 40).cast("string")
    t = k % 10
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    r = table(spark, d, "orders").select(
        k.alias("k"), F.when(t == 0, " ").when(t % 2 == 0, F.concat(F.lit("What is Ｎｏ. "), q, F.lit("?"))).otherwise(F.concat(F.lit("WHAT  IS no."), q, F.lit(" ?"))).alias("question"), F.when(t == 1, F.lit(None)).when(t == 5, F.repeat(F.lit("x"), F.lit(500))).otherwise("yes").alias("answer"),
        F.when(t == 2, F.array().cast("array<string>")).when(t == 3, a("p1", "")).when(t == 4, a("p1", "p9")).otherwise(a("p1", "p2")).alias("evidence"),
    )
    p = spark.createDataFrame([("p1",), ("p2",)], "passage_id string")
    return C.qa_reasons(r, p, "k", 300).select("k", F.array_join("reasons", "+").alias("reasons"))


_TRAIN = "SELECT o_orderkey - (o_orderkey % 301 = 7)::INT AS id, 'l' || (o_custkey + CASE WHEN o_orderkey % 211 = 0 THEN 1 ELSE 0 END) AS lineage, CASE WHEN o_custkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN o_orderkey % 4 = 0 THEN 'source_qa' ELSE 'image_report' END AS kind, 'C' || o_custkey % 3 AS client FROM orders"


def training(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select((k - (k % 301 == 7).cast("int")).alias("id"), _cat("l", c + F.when(k % 211 == 0, 1).otherwise(0)).alias("lineage"), F.when(c % 5 == 0, "val").otherwise("train").alias("split"), F.when(k % 4 == 0, "source_qa").otherwise("image_report").alias("kind"), _cat("C", c % 3).alias("client"))


@query(f"""WITH t AS ({_TRAIN}) SELECT 'id' AS "check", id::VARCHAR AS key FROM t GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'lineage', lineage FROM t GROUP BY lineage HAVING count(DISTINCT split) > 1""")
def training_faults(spark, d):
    return C.training_faults(training(spark, d))


@query(f"WITH t AS ({_TRAIN}) SELECT 'central' AS scope, id FROM t WHERE split = 'train' UNION ALL SELECT 'public_text', id FROM t WHERE split = 'train' AND kind = 'source_qa' UNION ALL SELECT 'C1', id FROM t WHERE split = 'train' AND client = 'C1'")
def training_rows(spark, d):
    t = training(spark, d)
    out = [C.training_rows(t, s, ["C0", "C1", "C2"]).select(F.lit(s).alias("scope"), "id") for s in ("central", "public_text", "C1")]
    return out[0].union(out[1]).union(out[2])


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 8 AS t, (o_custkey % 5 + 2)::INT AS n FROM orders)
SELECT k, CASE t WHEN 0 THEN 'invalid' WHEN 1 THEN 'padding' WHEN 2 THEN 'long' WHEN 3 THEN 'prefix' WHEN 4 THEN 'empty' END AS reason, CASE WHEN t > 4 THEN array_to_string(list_concat(list_concat([-100], [-100, -100]), list_concat(range(12, 10 + n + 2), [-100])), ',') END AS labels FROM r""")
def assistant_labels(spark, d):
    """Supervised token ids: two prompt tokens, then n, padded on both sides."""
    k = F.col("o_orderkey")
    t, n = k % 8, (F.col("o_custkey") % 5 + 2).cast("int")
    ids = F.concat(F.array(F.lit(0)), F.sequence(F.lit(10), 11 + n), F.array(F.lit(0)))
    mask = F.transform(ids, lambda x, i: F.when((i == 0) | (i == F.size(ids) - 1), 0).otherwise(1))
    prompt = F.when(t == 3, F.array(F.lit(10), F.lit(99))).when(t == 4, F.sequence(F.lit(10), 11 + n)).otherwise(F.array(F.lit(10), F.lit(11)))
    mask = F.when(t == 0, F.transform(mask, lambda x: x + 1)).when(t == 1, F.transform(mask, lambda x, i: F.when(i == 2, 0).otherwise(x))).otherwise(mask)
    out = C.assistant_labels(ids, prompt, mask, F.when(t == 2, 3).otherwise(100))
    return table(spark, d, "orders").select(k.alias("k"), out.alias("o")).select("k", "o.reason", F.array_join(F.col("o.labels").cast("array<string>"), ",").alias("labels"))


@query("""
WITH b AS (SELECT l_orderkey AS unit, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS c, l_suppkey % 6 > 0 AS ok, l_linenumber * 8 AS x1, l_partkey % 64 AS y1, l_linenumber * 8 + l_quantity AS x2, l_partkey % 64 + 16 AS y2 FROM lineitem),
g AS (SELECT unit, coalesce(string_agg(c || ' ' || printf('%.6f', (x1 + x2) / 2 / 128.0) || ' ' || printf('%.6f', (y1 + y2) / 2 / 256.0) || ' ' || printf('%.6f', (x2 - x1) / 128.0) || ' ' || printf('%.6f', (y2 - y1) / 256.0), chr(10) ORDER BY c || ' ' || printf('%.6f', (x1 + x2) / 2 / 128.0) || ' ' || printf('%.6f', (y1 + y2) / 2 / 256.0) || ' ' || printf('%.6f', (x2 - x1) / 128.0) || ' ' || printf('%.6f', (y2 - y1) / 256.0)) FILTER (ok), '') AS lines, count(*) FILTER (ok) AS n_boxes, count(*) FILTER (NOT ok) AS n_invalid FROM b GROUP BY 1)
SELECT o_orderkey AS unit, coalesce(lines, '') AS lines, coalesce(n_boxes, 0) AS n_boxes, coalesce(n_invalid, 0) AS n_invalid FROM orders LEFT JOIN g ON unit = o_orderkey""")
def box_lines(spark, d):
    """Label lines of boxes as shares of the picture."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("defect_type"), (F.col("l_suppkey") % 6 > 0).alias("valid"), (n * 8).alias("x1"), (k % 64).alias("y1"), (n * 8 + F.col("l_quantity")).alias("x2"), (k % 64 + 16).alias("y2"))
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.lit(128).alias("width"), F.lit(256).alias("height"))
    return C.box_lines(images, b, spark.createDataFrame([("A", 0), ("N", 1), ("R", 2)], "defect_type string, class_id int"), "unit")


_CENTRES = "SELECT l_suppkey AS grp, l_linenumber + l_quantity / 2 AS gx, l_partkey % 40 AS gy, (l_linenumber + l_quantity / 2) * (1 + (l_suppkey % 3) / 10.0::DOUBLE) AS px, l_partkey % 40 + l_tax AS py FROM lineitem"


def centres(spark, d):
    k, x = F.col("l_partkey") % 40, F.col("l_linenumber") + F.col("l_quantity") / 2
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), x.alias("gx"), k.cast("double").alias("gy"), (x * (1 + F.col("l_suppkey") % 3 / 10.0)).alias("px"), (k + F.col("l_tax")).alias("py"))


@query(f"""WITH c AS ({_CENTRES}), t AS (SELECT grp, count(*) FILTER (gx <> 0 AND gy <> 0) AS n, count(*) FILTER (NOT (gx <> 0 AND gy <> 0)) AS u, median(px / gx) FILTER (gx <> 0 AND gy <> 0) AS x, median(py / gy) FILTER (gx <> 0 AND gy <> 0) AS y FROM c GROUP BY 1)
SELECT grp, CASE WHEN n < 8 THEN 'indeterminate' WHEN abs(x - 1) > 0.05 OR abs(y - 1) > 0.05 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN n < 8 THEN 'sample' ELSE concat_ws('+', CASE WHEN abs(x - 1) > 0.05 THEN 'x' END, CASE WHEN abs(y - 1) > 0.05 THEN 'y' END) END AS reason, n AS n_pairs, u AS n_unusable FROM t""")
def axis_ratios(spark, d):
    return C.axis_ratios(centres(spark, d), ["grp"], 0.05, 8)


@query(f"""WITH c AS ({_CENTRES}), a AS (SELECT grp, count(*) AS n_images, median(px / gx) FILTER (gx <> 0) AS ratio_x, median(py / gy) FILTER (gy <> 0) AS ratio_y, CASE WHEN var_pop(gx) > 0 THEN covar_pop(px, gx) / var_pop(gx) END AS slope_x, CASE WHEN var_pop(gy) > 0 THEN covar_pop(py, gy) / var_pop(gy) END AS slope_y FROM c GROUP BY 1),
b AS (SELECT grp, count(*) AS n_pairs, median(px / gx) FILTER (gx <> 0) AS pair_x, median(py / gy) FILTER (gy <> 0) AS pair_y FROM c WHERE gx > 20 GROUP BY 1)
SELECT grp, n_images, round(ratio_x, 6) AS ratio_x, round(ratio_y, 6) AS ratio_y, round(slope_x, 6) AS slope_x, round(slope_y, 6) AS slope_y, n_pairs, round(pair_x, 6) AS pair_x, round(pair_y, 6) AS pair_y FROM a FULL JOIN b USING (grp)""")
def frame_statistics(spark, d):
    c = centres(spark, d)
    out = C.frame_statistics(c, c.where("gx > 20"), ["grp"])
    return out.select("grp", "n_images", *[F.round(x, 6).alias(x) for x in ("ratio_x", "ratio_y", "slope_x", "slope_y")], "n_pairs", F.round("pair_x", 6).alias("pair_x"), F.round("pair_y", 6).alias("pair_y"))


@query("""
WITH e AS (SELECT l_suppkey AS model, l_linenumber AS seed, avg(l_quantity) AS s, CASE WHEN l_suppkey % 9 > 0 THEN 20.0 END AS b FROM lineitem WHERE l_suppkey % 4 > 0 OR l_linenumber < 5 GROUP BY 1, 2), i AS (SELECT s_suppkey AS model, s_acctbal / 1000 - 1 AS lo, s_acctbal / 1000 + 1 AS hi FROM supplier WHERE s_suppkey % 5 > 0),
g AS (SELECT model, count(*) AS n, count(*) FILTER (s IS NULL OR b IS NULL) AS lost, bool_and(s > b) AS ok FROM e GROUP BY 1), j AS (SELECT model, CASE WHEN n = 7 AND lost = 0 THEN ok END AS one, CASE WHEN lo IS NOT NULL THEN lo > 0 END AS two, lo, hi FROM g LEFT JOIN i USING (model))
SELECT model, one AS seeds_ok, two AS above_ok, CASE WHEN lo > 0 THEN 'above' WHEN hi < 0 THEN 'below' ELSE 'indeterminate' END AS direction, coalesce(one, false) AND coalesce(two, false) AS passed FROM j""")
def registered_verdicts(spark, d):
    s = F.col("l_suppkey")
    e = table(spark, d, "lineitem").where((s % 4 > 0) | (F.col("l_linenumber") < 5)).groupBy(s.alias("model"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_quantity").alias("score")).withColumn("baseline", F.when(F.col("model") % 9 > 0, 20.0))
    i = table(spark, d, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("model"), (F.col("s_acctbal") / 1000 - 1).alias("lo"), (F.col("s_acctbal") / 1000 + 1).alias("hi"))
    return C.registered_verdicts(e, i, 7)


@query("""
SELECT 'keys' AS gate, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS passed, false AS skipped, NOT (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS blocks UNION ALL SELECT 'prices', (SELECT bool_and(o_totalprice < 1000) FROM orders), false, NOT (SELECT bool_and(o_totalprice < 1000) FROM orders) UNION ALL SELECT 'status', (SELECT count(DISTINCT o_orderstatus) = 1 FROM orders), false, false UNION ALL SELECT 'later', false, true, false""")
def gate_results(spark, d):
    o = table(spark, d, "orders")
    no = F.lit(False).alias("skipped")
    g = {
        "keys": o.agg((F.count(F.lit(1)) == F.count_distinct("o_orderkey")).alias("passed"), no), "prices": o.agg(F.bool_and(F.col("o_totalprice") < 1000).alias("passed"), no),
        "status": o.agg((F.count_distinct("o_orderstatus") == 1).alias("passed"), no), "later": spark.range(1).select(F.lit(None).cast("boolean").alias("passed"), F.lit(True).alias("skipped")),
    }
    return C.gate_results(g, ["keys", "prices", "later"])


@query("""
WITH j AS (SELECT quality = 1 AS ok, n_chars > 800 AS a, CASE WHEN doc_id % 5 > 0 THEN lang = 'en' END AS b, CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 3.0 END AS w FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
e AS (SELECT ok, coalesce(w, 1.0) AS w, w IS NULL AS bare, unnest(['a', 'b']) AS candidate, unnest([a, b]) AS p FROM j)
SELECT candidate, count(*) FILTER (p IS NULL) AS n_missing, round(count(*) FILTER (ok AND p) / count(*) FILTER (p), 4) AS precision, round(count(*) FILTER (ok AND p) / count(*) FILTER (ok AND p IS NOT NULL), 4) AS recall, round(sum(w) FILTER (ok AND p) / sum(w) FILTER (p), 4) AS weighted_precision, round(sum(w) FILTER (ok AND p) / sum(w) FILTER (ok AND p IS NOT NULL), 4) AS weighted_recall, count(*) FILTER (p IS NOT NULL AND bare) AS n_unweighted FROM e GROUP BY 1""")
def label_scores(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum"), (F.col("n_chars") > 800).alias("a"), F.when(F.col("doc_id") % 5 > 0, F.col("lang") == "en").alias("b"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok"))
    return C.label_scores(docs, labels, spark.createDataFrame([("en", 2.0), ("de", 3.0)], "stratum string, weight double"), ["a", "b"])


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 9 AS t FROM orders) SELECT k, CASE t WHEN 0 THEN 'missing:edition' WHEN 1 THEN 'schema_version' WHEN 2 THEN 'locator:pdf_page' WHEN 3 THEN 'locator:pdf_page_order' WHEN 4 THEN 'rights_status:enum' WHEN 5 THEN 'facet:odd' WHEN 6 THEN 'facet:historical_row_with_modern_facet+text_sha256:form' WHEN 7 THEN 'missing:facets+defect:zz' ELSE '' END AS faults FROM r""")
def passage_shapes(spark, d):
    k = F.col("o_orderkey")
    t, s = k % 9, F.sha2(k.cast("string"), 256)
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    none = F.array().cast("array<string>")
    r = table(spark, d, "orders").select(
        k.alias("k"), _cat("p", k).alias("passage_id"), F.lit("d").alias("doc_id"), F.when(t == 0, "").otherwise("2nd").alias("edition"), s.alias("source_file_sha256"), F.lit("body").alias("text_kind"), F.when(t == 6, "xyz").otherwise(s).alias("text_sha256"), F.lit("l").alias("lineage_group_id"),
        F.lit("hull").alias("scope"), F.when(t == 4, "maybe").otherwise("granted").alias("rights_status"), F.when(t == 5, a("cause", "odd")).when(t == 6, a("criteria")).when(t == 7, F.lit(None)).otherwise(none).alias("facets"), F.when(t == 7, a("zz")).otherwise(a("crack")).alias("defect_classes"),
        F.when(t == 6, a("historical_only:1")).otherwise(none).alias("flags"), F.when(t == 1, 1).otherwise(2).alias("schema_version"), F.when(t == 2, F.lit(None)).otherwise(3).alias("page_start"), F.when(t == 3, 2).otherwise(4).alias("page_end"),
    )
    return r.select("k", F.array_join(C.passage_shape(["granted", "denied"], ["cause", "criteria"], ["crack"], ["criteria"], 2), "+").alias("faults"))


@query("""
WITH r AS (SELECT doc_id AS p, doc_id % 40 AS d, doc_id % 3 AS h FROM documents), x AS (SELECT p, d, h, p % 11 = 0 AS nop, p % 13 = 0 AS txt, p % 17 = 0 AS psha, d % 10 = 9 AS nog, d % 10 = 8 AS gsha, d % 10 = 7 AS wd, d % 10 = 6 AS nor, d % 10 = 5 AS usex, p % 7 = 0 AS nov, p % 19 = 0 AS sev, p % 23 = 0 AS stale, p % 29 = 0 AS rej FROM r)
SELECT 'p' || p AS passage_id, array_to_string(list_filter([CASE WHEN nop THEN 'pointer:missing' END, CASE WHEN NOT nop AND txt THEN 'pointer:text' END, CASE WHEN NOT nop AND psha THEN 'pointer:sha' END, CASE WHEN nog THEN 'registry:missing' END, CASE WHEN gsha THEN 'registry:sha' END, CASE WHEN wd THEN 'registry:withdrawn' END, CASE WHEN nor THEN 'rights:missing' END, CASE WHEN usex THEN 'rights:use' END,
CASE WHEN nov THEN 'review:missing' END, CASE WHEN NOT nov AND sev THEN 'review:several' END, CASE WHEN NOT nov AND stale THEN 'review:stale' END, CASE WHEN NOT nov AND rej THEN 'review:rejected' END, CASE WHEN h = 2 THEN 'hold:policy' END], lambda v: v IS NOT NULL), '+') AS reasons FROM x""")
def passage_reasons(spark, d):
    """All reasons against a passage, over five tables."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("p"), (F.col("doc_id") % 40).alias("d"))
    p, g = F.col("p"), F.col("d")
    pid, did = _cat("p", p).alias("passage_id"), _cat("d", g).alias("doc_id")
    rows = docs.select(pid, did, F.lit("s").alias("sha"), F.lit("t").alias("text_sha"), F.when(p % 3 == 2, F.array(F.lit("policy"))).alias("holds"))
    pointers = docs.where(p % 11 > 0).select(pid, F.when(p % 17 == 0, "u").otherwise("t").alias("text_sha"), (p % 13 == 0).alias("has_text"))
    known = docs.select("d").distinct()
    registry = known.where(g % 10 != 9).select(did, F.when(g % 10 == 8, "x").otherwise("s").alias("sha"), (g % 10 == 7).alias("withdrawn"))
    rights = known.where(g % 10 != 6).select(did, F.lit("s").alias("sha"), F.when(g % 10 == 5, F.array(F.lit("print"))).otherwise(F.array(F.lit("qa"), F.lit("print"))).alias("uses"))
    v = docs.where(p % 7 > 0).select(pid, F.when(p % 23 == 0, "u").otherwise("t").alias("text_sha"), F.when(p % 29 == 0, "no").otherwise("accepted").alias("verdict"), p)
    reviews = v.union(v.where(p % 19 == 0)).drop("p")
    return C.passage_reasons(rows, pointers, registry, rights, reviews, "qa").withColumn("reasons", F.array_join("reasons", "+"))


@query("""
WITH RECURSIVE n AS (SELECT c_custkey AS id, c_custkey // 20 % 9 AS l, unnest(CASE WHEN c_custkey % 4 = 0 THEN [c_custkey - 1, c_custkey + 1] WHEN c_custkey % 50 = 1 THEN [-5] ELSE [] END) AS needs FROM customer), a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 13 > 0),
k AS (SELECT n.id, bool_or(c.c_custkey IS NULL) AS lost, bool_or(c.c_custkey IS NOT NULL AND c.c_custkey // 20 % 9 <> n.l) AS crossed FROM n LEFT JOIN customer c ON c.c_custkey = needs GROUP BY 1),
s AS (SELECT a.id, CASE WHEN lost THEN 'context:required_missing' WHEN crossed THEN 'context:cross_lineage' END AS reason FROM a LEFT JOIN k USING (id)),
x AS (SELECT id FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT id FROM s WHERE reason IS NULL) UNION SELECT n.id FROM n JOIN x ON n.needs = x.id)
SELECT id, CASE WHEN reason IS NOT NULL THEN reason WHEN id IN (FROM x) THEN 'context:required_not_selectable' END AS reason FROM s""")
def context_reasons(spark, d):
    """Ids dropped as their context is not there, until none drops."""
    return C.with_context(_context(spark, d), table(spark, d, "customer").where("c_custkey % 13 > 0").select(F.col("c_custkey").alias("id")))


def _context(spark, d):
    k = F.col("c_custkey")
    need = F.when(k % 4 == 0, F.array(k - 1, k + 1)).when(k % 50 == 1, F.array(F.lit(-5).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, d, "customer").select(k.alias("id"), (F.floor(k / 20) % 9).alias("lineage"), need.alias("needs"))


@query("""
WITH RECURSIVE z AS (SELECT count(*) AS n FROM customer), e AS (SELECT c_custkey AS a, unnest(CASE WHEN c_custkey % 3 = 0 THEN [(c_custkey * 5 + 1) % n] WHEN c_custkey % 7 = 1 THEN [c_custkey // 2, c_custkey // 3] ELSE [] END) AS b FROM customer, z), r AS (SELECT a, b FROM e WHERE a % 10 = 0 UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS id, b::BIGINT AS context FROM r WHERE a <> b""")
def context_closures(spark, d):
    """All that an id needs over any number of steps; cycles end."""
    c = table(spark, d, "customer")
    n, k = c.count(), F.col("c_custkey")
    need = F.when(k % 3 == 0, F.array((k * 5 + 1) % n)).when(k % 7 == 1, F.array(F.floor(k / 2), F.floor(k / 3))).otherwise(F.array().cast("array<bigint>"))
    rows = c.select(k.alias("id"), need.alias("needs"))
    return C.context_closure(rows, rows.where("id % 10 = 0"))


@query("""
WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 71 = 0 THEN 'XX' ELSE 'RT' END AS modality, CASE WHEN o_orderkey % 73 = 0 THEN NULL ELSE 'ST' END AS material, o_custkey AS g, CASE WHEN o_custkey % 6 = 0 AND o_orderkey % 97 > 0 THEN 'eval' ELSE 'train' END AS split, 'p' || o_orderkey % 1400 AS path, o_orderkey % 1300 AS sha FROM orders),
a AS (SELECT l_orderkey AS k, l_orderkey || '#' || l_linenumber AS ann FROM lineitem), n AS (SELECT k, count(*) AS n FROM a GROUP BY 1), m AS (SELECT i.*, coalesce(n, 0) AS n, coalesce(n, 0) + (i.k % 79 = 0)::INT AS decl FROM i LEFT JOIN n USING (k))
SELECT 'modality' AS "check", k::VARCHAR AS key FROM i WHERE modality = 'XX' UNION ALL SELECT 'material', k::VARCHAR FROM i WHERE material IS NULL UNION ALL SELECT 'defect key', ann FROM a GROUP BY ann HAVING count(*) > 1 UNION ALL SELECT 'has_defect', k::VARCHAR FROM m WHERE decl <> n OR (k % 83 = 0 AND decl = 0)
UNION ALL SELECT 'eval group', g::VARCHAR FROM i GROUP BY g HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'eval path', path FROM i GROUP BY path HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'eval content', sha::VARCHAR FROM i GROUP BY sha HAVING count(DISTINCT split) > 1""")
def pair_faults(spark, d):
    """Faults for which no pair is made at all."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), _cat(F.col("l_orderkey"), "#", F.col("l_linenumber")).alias("ann_id"))
    n = a.groupBy(F.col("image_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    decl = F.coalesce("n", F.lit(0)) + (k % 79 == 0).cast("int")
    i = table(spark, d, "orders").join(n, "o_orderkey", "left").select(
        k.alias("image_id"), F.when(k % 71 == 0, "XX").otherwise("RT").alias("modality"), F.when(k % 73 > 0, "ST").alias("material"), c.alias("group_id"), F.when((c % 6 == 0) & (k % 97 > 0), "eval").otherwise("train").alias("split"), _cat("p", k % 1400).alias("rel_path"), (k % 1300).alias("sha256"),
        decl.alias("n_defects"), F.when(k % 83 == 0, True).otherwise(decl > 0).alias("has_defect"),
    )
    return C.pair_faults(i, a, ["RT", "VT"], ["ST", "AL"])
