"""Queries on rule tables: part stands for the rules, orders for the images that are looked up."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import clauses as C
from quern.plans.registry import query, table

_RULES = """SELECT p_partkey AS rule_id, p_size % 6 > 0 AS active, p_partkey % 4 > 0 AS canonical, 'D' || (p_size % 8) AS code, CASE p_partkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'ST' ELSE 'AL' END AS material,
CASE WHEN p_partkey % 5 = 0 THEN 'ALL' WHEN p_partkey % 5 < 3 THEN 'RT' ELSE 'VT' END AS method, 'S' || (p_partkey % 2) AS scheme, substr('BCD', 1 + (p_partkey % 3)::INT, 1) AS level, 'T' || (p_partkey % 2) AS limit_type,
p_size AS lo, CASE WHEN p_size % 7 > 0 THEN p_size + p_partkey % 9 + 1 END AS hi, 'C' || (p_partkey % 12) AS clause FROM part"""
_ASKED = """SELECT o_orderkey AS qid, 'D' || (o_orderkey % 8) AS code, CASE o_custkey % 2 WHEN 0 THEN 'ST' ELSE 'AL' END AS material, CASE WHEN o_orderkey % 3 > 0 THEN 'RT' ELSE 'VT' END AS method, 'S' || (o_custkey % 2) AS scheme,
substr('BCD', 1 + (o_orderkey % 3)::INT, 1) AS level, o_orderkey % 55 AS t, 'C' || (o_custkey % 12) AS clause FROM orders"""
_MET = f"""r AS ({_RULES}), q AS ({_ASKED}), m AS (SELECT q.*, r.rule_id, r.clause AS rc, r.limit_type FROM q JOIN r ON r.active AND r.canonical AND q.code = r.code AND r.material IN (q.material, 'ALL') AND r.method IN (q.method, 'ALL')
 AND q.scheme = r.scheme AND q.level = r.level AND q.t >= r.lo AND (r.hi IS NULL OR q.t < r.hi))"""


def rules(spark, d):
    p, k, z = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    letter = lambda c: F.substr(F.lit("BCD"), (c % 3 + 1).cast("int"), F.lit(1))
    tag = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    return p.select(
        k.alias("rule_id"), (z % 6 > 0).alias("active"), (k % 4 > 0).alias("canonical"), tag("D", z % 8).alias("code"), F.when(k % 3 == 0, "ALL").when(k % 3 == 1, "ST").otherwise("AL").alias("material"),
        F.when(k % 5 == 0, "ALL").when(k % 5 < 3, "RT").otherwise("VT").alias("method"), tag("S", k % 2).alias("scheme"), letter(k).alias("level"), tag("T", k % 2).alias("limit_type"),
        z.alias("lo"), F.when(z % 7 > 0, z + k % 9 + 1).alias("hi"), tag("C", k % 12).alias("clause"),
    )


def asked(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("qid"), F.concat(F.lit("D"), (k % 8).cast("string")).alias("code"), F.when(c % 2 == 0, "ST").otherwise("AL").alias("material"), F.when(k % 3 > 0, "RT").otherwise("VT").alias("method"),
        F.concat(F.lit("S"), (c % 2).cast("string")).alias("scheme"), F.substr(F.lit("BCD"), (k % 3 + 1).cast("int"), F.lit(1)).alias("level"), (k % 55).alias("t"), F.concat(F.lit("C"), (c % 12).cast("string")).alias("clause"),
    )


@query(f"WITH {_MET}, n AS (SELECT qid, count(*) AS n, min(rule_id) AS r FROM m GROUP BY 1) SELECT q.qid, CASE WHEN n = 1 THEN r END AS rule_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'multiple' ELSE 'ok' END AS state FROM q LEFT JOIN n USING (qid)")
def applicable_rules(spark, d):
    return C.one_rule(asked(spark, d), rules(spark, d))


@query(f"WITH {_MET}, n AS (SELECT qid, count(*) AS n, min(rule_id) AS r FROM m WHERE clause = rc GROUP BY 1) SELECT q.qid, CASE WHEN n = 1 THEN r END AS rule_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'multiple' ELSE 'ok' END AS state FROM q LEFT JOIN n USING (qid)")
def cited_rules(spark, d):
    """The rule of the clause that a query cites."""
    return C.one_rule(asked(spark, d), rules(spark, d), by_clause=True)


@query(f"WITH r AS ({_RULES}) SELECT rule_id, code, lo FROM r WHERE clause = 'C7'")
def rules_of_clause(spark, d):
    return C.rules_of_clause(rules(spark, d), "C7").select("rule_id", "code", "lo")


@query(f"WITH {_MET}, n AS (SELECT qid, count(DISTINCT rc) AS n, min(rc) AS c FROM m WHERE limit_type = 'T1' GROUP BY 1) SELECT q.qid, CASE WHEN n = 1 THEN c END AS clause, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'multiple' ELSE 'ok' END AS state FROM q LEFT JOIN n USING (qid)")
def looked_up_clauses(spark, d):
    return C.one_clause(asked(spark, d), rules(spark, d), "T1")


@query(f"""
WITH r AS ({_RULES}), c AS (SELECT DISTINCT l_orderkey AS unit, 'D' || (l_linenumber + 1) % 8 AS code FROM lineitem), x AS ({_ASKED}), q AS (SELECT unit, c.code, material, method, scheme, level, t FROM c JOIN x ON qid = unit),
n AS (SELECT unit, q.code, count(DISTINCT clause) AS n, min(clause) AS clause FROM q JOIN r ON r.active AND r.canonical AND q.code = r.code AND r.material IN (q.material, 'ALL') AND r.method IN (q.method, 'ALL') AND q.scheme = r.scheme AND q.level = r.level AND q.t >= r.lo AND (r.hi IS NULL OR q.t < r.hi) GROUP BY 1, 2)
SELECT unit, q.code, CASE WHEN n = 1 THEN clause END AS clause, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'multiple' ELSE 'ok' END AS state FROM q LEFT JOIN n USING (unit, code)""")
def gold_pairs(spark, d):
    codes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.concat(F.lit("D"), ((F.col("l_linenumber") + 1) % 8).cast("string")).alias("code"))
    return C.gold_pairs(asked(spark, d).drop("code", "clause").withColumnRenamed("qid", "unit"), codes, rules(spark, d))


@query(f"WITH r AS ({_RULES}) SELECT code, material, method, lo, hi, scheme, level, limit_type, array_to_string(list(DISTINCT clause ORDER BY clause), ';') AS clauses FROM r WHERE active AND canonical GROUP BY ALL HAVING count(DISTINCT clause) > 1")
def gold_conflicts(spark, d):
    return C.gold_conflicts(rules(spark, d))


@query(f"WITH r AS ({_RULES}) SELECT code, material, method, lo, hi, scheme, level, limit_type, min(clause) AS clause, min(rule_id) AS rule_id FROM r WHERE active AND canonical GROUP BY ALL HAVING count(DISTINCT clause) = 1")
def gold_clauses(spark, d):
    """The keys of one clause; the others are ``gold_conflicts`` and would stop the whole table."""
    r = rules(spark, d)
    keys = ["code", "material", "method", "lo", "hi", "scheme", "level", "limit_type"]
    same = None
    bad = C.gold_conflicts(r).alias("b")
    for k in keys:
        c = F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = c if same is None else same & c
    return C.gold_clauses(r.alias("r").join(bad, same, "left_anti")).select(*keys, "clause", "rule_id")


_TOKENS = f"""r0 AS ({_RULES}), r AS (SELECT rule_id, active, canonical, 'D' || rule_id % 40 AS code, material, method, CASE WHEN rule_id % 9 > 0 THEN 'K' || rule_id % 7 END AS class, 'C' || rule_id % 40 AS clause,
 CASE rule_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['mix:K' || rule_id % 5] WHEN 2 THEN ['far:K' || (rule_id + 3) % 7, 'mix:K' || rule_id % 6] ELSE ['premise'] END AS conditions FROM r0)"""


def tokens(spark, d):
    """The rules with a class and condition tokens, the clauses such that most codes have one."""
    k = F.col("rule_id")
    tag = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    cond = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(tag("mix:K", k % 5))).when(k % 4 == 2, F.array(tag("far:K", (k + 3) % 7), tag("mix:K", k % 6))).otherwise(F.array(F.lit("premise")))
    return rules(spark, d).select(k, "active", "canonical", tag("D", k % 40).alias("code"), "material", "method", F.when(k % 9 > 0, tag("K", k % 7)).alias("class"), tag("C", k % 40).alias("clause"), cond.alias("conditions"))


@query(f"""
WITH {_TOKENS}, p AS (SELECT * FROM r WHERE active AND canonical AND method IN ('RT', 'ALL')), g AS (SELECT code, mt FROM (SELECT DISTINCT code FROM p), (VALUES ('AL'), ('ST')) t(mt)),
x AS (SELECT p.*, mt FROM p JOIN (VALUES ('AL'), ('ST')) t(mt) ON material IN (mt, 'ALL')), mn AS (SELECT mt, code, list(DISTINCT clause ORDER BY clause) AS mains FROM x GROUP BY 1, 2),
w AS (SELECT DISTINCT mt, code, split_part(tok, ':', 2) AS class FROM (SELECT mt, code, unnest(conditions) AS tok FROM x) WHERE split_part(tok, ':', 1) = 'far'),
au AS (SELECT w.mt, w.code, list(DISTINCT x.clause ORDER BY x.clause) AS aux FROM w JOIN x ON w.mt = x.mt AND w.class = x.class GROUP BY 1, 2)
SELECT mt AS material, code, CASE WHEN len(mains) = 1 THEN mains[1] END AS main, coalesce(array_to_string(aux, ';'), '') AS auxiliary, CASE WHEN mains IS NULL THEN 'none' WHEN len(mains) > 1 THEN 'mains' WHEN list_contains(coalesce(aux, []), mains[1]) THEN 'self' ELSE 'ok' END AS state
FROM g LEFT JOIN mn USING (mt, code) LEFT JOIN au USING (mt, code)""")
def clause_roles(spark, d):
    return C.clause_roles(tokens(spark, d), "RT", ["AL", "ST"], "far")


@query(f"""
WITH {_TOKENS}, k AS (SELECT rule_id, material, method, class, split_part(tok, ':', 1) AS kind, split_part(tok, ':', 2) AS mate FROM (SELECT *, unnest(conditions) AS tok FROM r) WHERE split_part(tok, ':', 1) IN ('mix', 'far')),
p AS (SELECT k.*, m.rule_id AS mr, m.conditions AS mc FROM k LEFT JOIN r m ON k.material = m.material AND k.method = m.method AND k.mate = m.class WHERE k.material <> 'ALL' AND k.method <> 'ALL')
SELECT DISTINCT * FROM (SELECT 'classes' AS "check", material || '/' || method || '/' || code AS key FROM r WHERE class IS NOT NULL GROUP BY material, method, code HAVING count(DISTINCT class) > 1
UNION ALL SELECT 'all', rule_id::VARCHAR FROM k WHERE material = 'ALL' OR method = 'ALL' UNION ALL SELECT 'no_mate', rule_id::VARCHAR FROM p WHERE mr IS NULL
UNION ALL SELECT 'one_sided', mr::VARCHAR FROM p WHERE mr IS NOT NULL AND NOT coalesce(list_contains(mc, kind || ':' || class), false) UNION ALL SELECT 'clause', clause FROM r GROUP BY clause HAVING count(DISTINCT coalesce(class, '') || '#' || array_to_string(conditions, '|')) > 1)""")
def token_faults(spark, d):
    return C.token_faults(tokens(spark, d), ["mix", "far"])


_GRADES = {"S1": {"B": ["x", "y"], "C": ["y"]}, "S2": {"D": ["B"]}}
_CHUNKS = """SELECT p_brand AS chunk_id, CASE WHEN min(p_partkey) % 9 = 0 THEN [] ELSE list(DISTINCT 'D' || (p_size % 8)) END AS codes, CASE min(p_partkey) % 3 WHEN 0 THEN [] WHEN 1 THEN ['RT'] ELSE ['VT', 'ALL'] END AS methods, CASE WHEN min(p_partkey) % 2 = 0 THEN ['ST'] ELSE ['AL', 'ALL'] END AS materials,
CASE WHEN min(p_partkey) % 4 > 0 THEN 'S' || min(p_partkey) % 4 END AS scheme, CASE min(p_partkey) % 5 WHEN 0 THEN [] WHEN 1 THEN ['x'] WHEN 2 THEN ['y', 'C'] ELSE ['B', 'D'] END AS levels, CASE WHEN min(p_partkey) % 7 > 0 THEN min(p_size) END AS lo, CASE WHEN min(p_partkey) % 6 > 0 THEN min(p_size) + 30 END AS hi FROM part GROUP BY 1"""
_FOUND = f"""c AS ({_CHUNKS}), q0 AS ({_ASKED}), q AS (SELECT qid, code, material, method, CASE WHEN qid % 5 > 0 THEN 'S' || qid % 3 END AS scheme, CASE WHEN qid % 7 > 0 THEN level END AS level, CASE WHEN qid % 11 > 0 THEN t END AS t FROM q0),
gm(s, lv, ok) AS (VALUES ('S1', 'B', ['x', 'y']), ('S1', 'C', ['y']), ('S2', 'D', ['B'])),
j AS (SELECT qid, chunk_id, c.scheme AS cs, q.scheme AS qs, q.level AS ql, c.levels, coalesce(list_has_any(ok, c.levels), false) AS thru FROM q JOIN c ON list_contains(c.codes, q.code) AND (len(c.methods) = 0 OR list_contains(c.methods, q.method) OR list_contains(c.methods, 'ALL')) AND (len(c.materials) = 0 OR list_contains(c.materials, q.material) OR list_contains(c.materials, 'ALL'))
 AND ((c.lo IS NULL AND c.hi IS NULL) OR coalesce((c.lo IS NULL OR q.t >= c.lo) AND (c.hi IS NULL OR q.t < c.hi), false) AND (q.t IS NOT NULL)) LEFT JOIN gm ON s = c.scheme AND lv = q.level),
m AS (SELECT qid, chunk_id FROM j WHERE CASE WHEN cs IS NOT NULL AND cs IS DISTINCT FROM qs THEN qs IS NOT DISTINCT FROM 'S0' AND ql IS NOT NULL AND thru ELSE len(levels) = 0 OR ql IS NULL OR list_contains(levels, ql) OR thru END)"""


def chunks(spark, d):
    m = F.min("p_partkey")
    a = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("chunk_id")).agg(m.alias("m"), F.collect_set(F.concat(F.lit("D"), (F.col("p_size") % 8).cast("string"))).alias("codes"), F.min("p_size").alias("s"))
    k = F.col("m")
    return g.select(
        "chunk_id", F.when(k % 9 == 0, a()).otherwise(F.col("codes")).alias("codes"), F.when(k % 3 == 0, a()).when(k % 3 == 1, a("RT")).otherwise(a("VT", "ALL")).alias("methods"), F.when(k % 2 == 0, a("ST")).otherwise(a("AL", "ALL")).alias("materials"),
        F.when(k % 4 > 0, F.concat(F.lit("S"), (k % 4).cast("string"))).alias("scheme"), F.when(k % 5 == 0, a()).when(k % 5 == 1, a("x")).when(k % 5 == 2, a("y", "C")).otherwise(a("B", "D")).alias("levels"),
        F.when(k % 7 > 0, F.col("s")).alias("lo"), F.when(k % 6 > 0, F.col("s") + 30).alias("hi"),
    )


def chunk_queries(spark, d):
    k = F.col("qid")
    return asked(spark, d).select("qid", "code", "material", "method", F.when(k % 5 > 0, F.concat(F.lit("S"), (k % 3).cast("string"))).alias("scheme"), F.when(k % 7 > 0, F.col("level")).alias("level"), F.when(k % 11 > 0, F.col("t")).alias("t"))


@query(f"WITH {_FOUND} SELECT qid, chunk_id FROM m")
def filtered_chunks(spark, d):
    return C.chunk_matches(chunk_queries(spark, d), chunks(spark, d), _GRADES, "S0")


@query(f"""WITH {_FOUND}, s AS (SELECT qid, chunk_id, (qid * 31 + length(chunk_id) * 7 + ascii(substr(chunk_id, 7, 1))) % 17 AS score FROM m), r AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r, count(*) OVER (PARTITION BY qid) AS n FROM s),
t AS (SELECT qid, any_value(n) AS n, string_agg(chunk_id, ',' ORDER BY r) AS ids FROM r WHERE r <= 3 GROUP BY 1) SELECT q.qid, coalesce(ids, '') AS chunk_ids, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'NO_CLAUSE' WHEN n = 1 THEN 'DIRECT' ELSE 'RANKED' END AS reason FROM q LEFT JOIN t USING (qid)""")
def ranked_chunks(spark, d):
    """The three best chunks of a query by a score, which stands for an embedding's."""
    q, c = chunk_queries(spark, d), chunks(spark, d)
    m = C.chunk_matches(q, c, _GRADES, "S0")
    score = (F.col("qid") * 31 + F.length("chunk_id") * 7 + F.ascii(F.substr("chunk_id", F.lit(7), F.lit(1)))) % 17
    out = C.ranked_chunks(q, m, m.withColumn("score", score.cast("double")))
    return out.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("WITH t AS (SELECT p_type AS model, max(p_size) AS top1 FROM part GROUP BY 1), m AS (SELECT max(top1) AS m FROM t) SELECT CASE WHEN bool_or(model = 'PROMO') THEN 'PROMO' ELSE min(model) END AS model, max(top1) AS top1 FROM t, m WHERE top1 = m")
def picked_model(spark, d):
    return C.pick_best(table(spark, d, "part").groupBy(F.col("p_type").alias("model")).agg(F.max("p_size").alias("top1")), "model", "top1", "PROMO")


@query("""
WITH m AS (SELECT l_orderkey AS unit, CASE WHEN l_partkey % 37 > 0 THEN l_suppkey % 3 END AS cited, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 3 END AS gold, l_partkey % 41 > 0 AS found, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ALL' ELSE 'RT' END AS rm, CASE WHEN l_partkey % 29 > 0 THEN 'RT' ELSE 'VT' END AS mt,
 CASE WHEN l_partkey % 31 > 0 THEN l_quantity::INT - 1 END AS x, CASE WHEN l_suppkey % 7 > 0 THEN 40 END AS lim, CASE l_suppkey % 2 WHEN 0 THEN 'le' ELSE 'lt' END AS op, CASE l_suppkey % 9 WHEN 0 THEN 'none_permitted' ELSE 'const' END AS rule FROM lineitem),
t AS (SELECT unit, bool_or(cited IS NULL) AS a, bool_or(NOT found) AS b, bool_or(rm IS NOT NULL AND rm <> 'ALL' AND rm <> mt) AS c, bool_or(x IS NULL) AS d, bool_or(coalesce(CASE WHEN rule = 'none_permitted' THEN x <= 0 ELSE x < 0 OR lim IS NULL END, false)) AS e,
 bool_or(coalesce(rule = 'none_permitted' OR NOT CASE WHEN op = 'lt' THEN x < lim ELSE x <= lim END, false)) AS f, bool_or(gold IS NOT NULL AND cited IS DISTINCT FROM gold) AS g FROM m GROUP BY 1),
v AS (SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 13 = 0 THEN 'UNDECIDABLE' WHEN o_orderkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS p FROM orders)
SELECT unit, CASE WHEN a THEN 'no_citation' WHEN b THEN 'no_rule' WHEN c THEN 'wrong_method' WHEN d THEN 'no_measure' WHEN e THEN 'undecidable' WHEN p = 'UNDECIDABLE' THEN 'evaded' WHEN p = CASE WHEN coalesce(f, false) THEN 'FAIL' ELSE 'PASS' END THEN 'ok' WHEN coalesce(g, false) THEN 'wrong_clause' ELSE 'wrong_comparison' END AS state FROM v LEFT JOIN t USING (unit)""")
def verdict_consistency(spark, d):
    k, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    m = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("unit"), F.when(k % 37 > 0, s % 3).alias("cited"), F.when(k % 5 > 0, k % 3).alias("gold"), (k % 41 > 0).alias("row_found"), F.when(s % 4 == 1, "ALL").when(s % 4 > 1, "RT").alias("row_method"), F.when(k % 29 > 0, "RT").otherwise("VT").alias("method"),
        F.when(k % 31 > 0, q - 1).alias("measured"), F.when(s % 7 > 0, 40).alias("limit"), F.when(s % 2 == 0, "le").otherwise("lt").alias("op"), F.when(s % 9 == 0, "none_permitted").otherwise("const").alias("rule"),
    )
    o = F.col("o_orderkey")
    v = table(spark, d, "orders").select(o.alias("unit"), F.when(o % 13 == 0, "UNDECIDABLE").when(o % 2 == 0, "PASS").otherwise("FAIL").alias("predicted"))
    return C.consistency(v, m)


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS unit, l_suppkey AS clause FROM lineitem), g AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS code, l_suppkey AS clause FROM lineitem WHERE l_quantity > 30),
i AS (SELECT s_suppkey AS clause FROM supplier WHERE s_acctbal > 0), a AS (SELECT DISTINCT unit, clause FROM g), k AS (SELECT c.unit % 5 + 1.0 AS w, a.unit IS NOT NULL AS ok, i.clause IS NOT NULL AS known FROM c LEFT JOIN a ON c.unit = a.unit AND c.clause = a.clause LEFT JOIN i ON c.clause = i.clause)
SELECT sum(w)::DOUBLE AS cited, sum(w) FILTER (ok)::DOUBLE AS correct, coalesce(sum(w) FILTER (known AND NOT ok), 0)::DOUBLE AS irrelevant, coalesce(sum(w) FILTER (NOT known), 0)::DOUBLE AS nonexistent, (SELECT sum(unit % 5 + 1) FROM g)::DOUBLE AS pairs, (SELECT sum(unit % 5 + 1) FROM g SEMI JOIN c USING (unit, clause))::DOUBLE AS matched FROM k""")
def weighted_citations(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("code"), F.col("l_suppkey").alias("clause"), "l_quantity")
    index = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("clause"))
    weights = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 5 + 1.0).cast("double").alias("weight"))
    return C.weighted_citations(li.select("unit", "clause").distinct(), li.where("l_quantity > 30").select("unit", "code", "clause").distinct(), index, weights)


_LEVELS = """SELECT p_partkey AS rule_id, substr('BCD', 1 + (p_partkey % 3)::INT, 1) AS level, p_brand AS code, p_size::DECIMAL(18,2) AS lo, CASE WHEN p_size % 5 > 0 THEN (p_size + 9)::DECIMAL(18,2) END AS hi, CASE p_partkey % 2 WHEN 0 THEN 'const' ELSE 'prop_t_cap' END AS rule,
(p_partkey % 11 + 1)::DECIMAL(18,2) AS value, CASE WHEN p_partkey % 2 = 1 THEN ((p_partkey % 7 + 1) / 10)::DECIMAL(18,2) END AS factor, CASE WHEN p_partkey % 2 = 1 THEN (p_partkey % 13 + 1)::DECIMAL(18,2) END AS cap FROM part"""


@query(f"""
WITH r AS ({_LEVELS}), x AS (SELECT a.rule_id AS strict, b.rule_id AS lenient, a, b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, round((a.cap / a.factor)::DECIMAL(18,8), 2) AS ta, round((b.cap / b.factor)::DECIMAL(18,8), 2) AS tb FROM r a JOIN r b ON a.code = b.code AND a.level < b.level AND (a.hi IS NULL OR b.lo < a.hi) AND (b.hi IS NULL OR a.lo < b.hi)),
p AS (SELECT DISTINCT strict, lenient, a, b, t FROM (SELECT strict, lenient, a, b, unnest([lo, CASE WHEN hi - 0.01 >= lo THEN hi - 0.01 END, CASE WHEN ta >= lo AND (hi IS NULL OR ta < hi) THEN ta END, CASE WHEN tb >= lo AND (hi IS NULL OR tb < hi) THEN tb END]::DECIMAL(18,2)[]) AS t FROM x) WHERE t IS NOT NULL),
l AS (SELECT strict, lenient, t, CASE a.rule WHEN 'const' THEN a.value ELSE least(round((a.factor * t)::DECIMAL(30,8), 2), a.cap) END AS la, CASE b.rule WHEN 'const' THEN b.value ELSE least(round((b.factor * t)::DECIMAL(30,8), 2), b.cap) END AS lb FROM p)
SELECT strict, lenient, t::DOUBLE AS t, la::DOUBLE AS strict_limit, lb::DOUBLE AS lenient_limit FROM l WHERE la > lb""")
def level_order(spark, d):
    """Where a stricter level permits more, at the ends of common intervals and where capped limits turn flat."""
    from quern.functions.scalars import effective_limit

    k, z = F.col("p_partkey"), F.col("p_size")
    dec = lambda c: c.cast("decimal(18,2)")
    odd = k % 2 == 1
    r = table(spark, d, "part").select(
        k.alias("rule_id"), F.substr(F.lit("BCD"), (k % 3 + 1).cast("int"), F.lit(1)).alias("level"), F.col("p_brand").alias("code"), dec(z).alias("lo"), F.when(z % 5 > 0, dec(z + 9)).alias("hi"), F.when(odd, "prop_t_cap").otherwise("const").alias("rule"),
        dec(k % 11 + 1).alias("value"), F.when(odd, dec((k % 7 + 1) / 10)).alias("factor"), F.when(odd, dec(k % 13 + 1)).alias("cap"),
    )
    limit = effective_limit(F.col("rule"), F.col("value"), F.col("factor"), F.col("cap"), F.col("t"))
    out = C.levels_out_of_order(r, ["B", "C", "D"], limit, ["code"])
    return out.select("strict", "lenient", *[F.col(c).cast("double").alias(c) for c in ("t", "strict_limit", "lenient_limit")])


@query("""
WITH r AS (SELECT min(p_partkey) AS rule_id, p_brand, p_size AS lo, CASE WHEN p_size % 11 > 0 THEN p_size + 2 END AS hi, p_size % 3 AS doc, p_size % 5 AS lim FROM part GROUP BY p_brand, p_size)
SELECT a.rule_id AS a, b.rule_id AS b, CASE WHEN a.rule_id % 3 = 0 AND b.rule_id % 3 = 0 THEN 'both_canonical' WHEN a.rule_id % 3 = 0 OR b.rule_id % 3 = 0 THEN 'resolved' ELSE 'unresolved' END AS state FROM r a JOIN r b ON a.rule_id < b.rule_id AND a.p_brand = b.p_brand AND a.doc <> b.doc AND a.lim <> b.lim
AND a.lo < coalesce(b.hi, 1000000) AND b.lo < coalesce(a.hi, 1000000)""")
def conflict_states(spark, d):
    """Conflicts between documents and whether a canonical rule settles them."""
    from quern.operators.rules import conflicts

    z = F.col("p_size")
    g = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("rule_id"))
    r = g.select("rule_id", "p_brand", z.alias("lo"), F.when(z % 11 > 0, z + 2).alias("hi"), (z % 3).alias("doc"), (z % 5).alias("lim"))
    pairs = conflicts(r, ["p_brand"], "doc", "lim")
    return C.resolved_conflicts(pairs.withColumn("a_canonical", F.col("a") % 3 == 0).withColumn("b_canonical", F.col("b") % 3 == 0)).select("a", "b", "state")


@query("""
WITH r AS (SELECT p_partkey AS rule_id, CASE p_partkey % 4 WHEN 0 THEN 'none_permitted' WHEN 1 THEN 'const' ELSE 'prop_t' END AS rule, CASE p_partkey % 5 WHEN 0 THEN 'a' ELSE 't' END AS basis, p_partkey % 3 = 0 AS pct, p_size AS lo, p_size + 40 AS hi FROM part),
l AS (SELECT *, CASE rule WHEN 'const' THEN (rule_id % 200 / 2)::DECIMAL(18,2) WHEN 'prop_t' THEN round((0.05 * lo)::DECIMAL(30,8), 2) END AS ll, CASE rule WHEN 'const' THEN (rule_id % 200 / 2)::DECIMAL(18,2) WHEN 'prop_t' THEN round((0.05 * hi)::DECIMAL(30,8), 2) END AS lh FROM r)
SELECT rule_id, unnest(list_filter([CASE WHEN rule <> 'none_permitted' AND basis = 'a' THEN 'basis' END, CASE WHEN rule <> 'none_permitted' AND basis <> 'a' AND ll < 0.1 THEN 'too_small' END, CASE WHEN rule <> 'none_permitted' AND basis <> 'a' AND pct AND 1.1 * lh >= 100 THEN 'no_room' END], lambda x: x IS NOT NULL)) AS reason FROM l""")
def infeasible_rules(spark, d):
    from quern.functions.scalars import effective_limit

    k, z = F.col("p_partkey"), F.col("p_size")
    dec = lambda c: c.cast("decimal(18,2)")
    rule = F.when(k % 4 == 0, "none_permitted").when(k % 4 == 1, "const").otherwise("prop_t")
    r = table(spark, d, "part").select(k.alias("rule_id"), rule.alias("rule"), F.when(k % 5 == 0, "a").otherwise("t").alias("basis"), (k % 3 == 0).alias("percent"), dec(z).alias("lo"), dec(z + 40).alias("hi"), dec(k % 200 / 2).alias("value"))
    at = lambda t: effective_limit(F.col("rule"), F.col("value"), F.lit("0.05").cast("decimal(10,2)"), F.lit(None).cast("decimal(10,2)"), F.col(t))
    return C.infeasible(r, at("lo"), at("hi"), F.col("percent"))
