"""Queries on rule tables and graphs; part stands for rules, their sizes for perceptual hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import rules as R
from quern.operators.relational import close_hashes, distances
from quern.plans.registry import query, table

_HASHES = "SELECT p_partkey, p_type, CASE WHEN p_size % 4 > 0 THEN (1::BIGINT << (p_size * 7 % 53)) - 1 + ((regexp_extract(p_brand, '[0-9]+')::BIGINT % 8) << 54) END AS h FROM part"


def hashes(spark, d):
    """(p_partkey, p_type, h): a scale of the size and the brand's number in 57 bits, so that near sizes are near; null for some."""
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long") % 8
    scale = F.expr("shiftleft(1L, p_size * 7 % 53) - 1")
    return table(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_size") % 4 > 0, scale + F.shiftleft(brand, 54)).alias("h"))


@query("SELECT p_brand, p_type, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_rule_keys(spark, d):
    return R.repeated_keys(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], "p_partkey")


_RULES = "SELECT min(p_partkey) AS rule_id, p_brand, p_size AS lo, CASE WHEN p_size % 11 > 0 THEN p_size + 2 END AS hi, p_size % 3 AS doc, p_size % 5 AS lim FROM part GROUP BY p_brand, p_size"


@query(f"""
WITH r AS ({_RULES}) SELECT a.rule_id AS a, b.rule_id AS b FROM r a JOIN r b ON a.rule_id < b.rule_id AND a.p_brand = b.p_brand AND a.doc <> b.doc AND a.lim <> b.lim
AND a.lo < coalesce(b.hi, 1000000) AND b.lo < coalesce(a.hi, 1000000)""")
def cross_document_conflicts(spark, d):
    size = F.col("p_size")
    rules = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("rule_id"))
    return R.conflicts(rules.select("rule_id", "p_brand", size.alias("lo"), F.when(size % 11 > 0, size + 2).alias("hi"), (size % 3).alias("doc"), (size % 5).alias("lim")), ["p_brand"], "doc", "lim")


@query("""
WITH r AS (SELECT p_brand, p_size, max(p_partkey % 97) AS lim FROM part GROUP BY 1, 2), l AS (SELECT *, lag(lim) OVER (PARTITION BY p_brand ORDER BY p_size) AS laxer FROM r)
SELECT p_brand, p_size, lim, laxer FROM l WHERE lim > laxer""")
def level_monotonicity(spark, d):
    r = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.max(F.col("p_partkey") % 97).alias("lim"))
    return R.unordered_levels(r, ["p_brand"], "p_size", "lim")


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.b AND q.b = p.a)""")
def token_symmetry(spark, d):
    """Pairs (supplier, part) whose reverse is missing."""
    return R.one_sided(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")), "a", "b")


@query("""
SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS p_type, CASE WHEN count(lo) = count(*) THEN min(lo) END AS lo, CASE WHEN count(hi) = count(*) THEN max(hi) END AS hi,
CASE WHEN count(DISTINCT scope) = 1 THEN min(scope) ELSE 'mixed' END AS scope FROM (SELECT p_brand, p_type, p_size AS lo, nullif(p_size, 50) AS hi, CASE WHEN p_size > 49 THEN 'b' ELSE 'a' END AS scope FROM part) GROUP BY 1""")
def derive_chunk_meta(spark, d):
    r = table(spark, d, "part").select("p_brand", "p_type", F.col("p_size").alias("lo"), F.nullif("p_size", F.lit(50)).alias("hi"), F.when(F.col("p_size") > 49, "b").otherwise("a").alias("scope"))
    return R.chunk_meta(r, "p_brand", ["p_type"], "lo", "hi", "scope").withColumn("p_type", F.array_join("p_type", ";"))


@query("""
WITH c AS (SELECT p_brand || '/' || (p_size // 10) AS id, p_brand, (p_size // 10) * 10 AS lo, CASE WHEN p_size < 50 THEN (p_size // 10) * 10 + 15 END AS hi, list(DISTINCT p_type) AS codes FROM part GROUP BY 1, 2, 3, 4),
q AS (SELECT DISTINCT p_type AS code, p_size AS t FROM part), e AS (SELECT DISTINCT id, lo, hi, unnest(codes) AS code FROM c),
j AS (SELECT q.code || q.t AS qid, list_sort(list(DISTINCT id) FILTER (id IS NOT NULL)) AS ids FROM q LEFT JOIN e ON q.code = e.code AND q.t >= lo AND (hi IS NULL OR q.t < hi) GROUP BY 1)
SELECT qid, array_to_string(ids[1:3], ',') AS chunk_ids, coalesce(len(ids), 0)::INT AS n, CASE WHEN coalesce(len(ids), 0) = 0 THEN 'NO_CLAUSE' WHEN len(ids) = 1 THEN 'DIRECT' ELSE 'RANKED' END AS reason FROM j""")
def retrieve_clauses(spark, d):
    part, ten = table(spark, d, "part"), F.floor(F.col("p_size") / 10)
    c = part.groupBy(F.concat_ws("/", "p_brand", ten.cast("string")).alias("chunk_id"), (ten * 10).alias("lo"), F.when(F.col("p_size") < 50, ten * 10 + 15).alias("hi")).agg(F.collect_set("p_type").alias("codes"))
    q = part.select(F.col("p_type").alias("code"), F.col("p_size").alias("t")).distinct().withColumn("qid", F.concat("code", F.col("t").cast("string")))
    return R.retrieve(q, c, "code", "t").withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("""
WITH c AS (SELECT DISTINCT p_brand, p_type FROM part), n AS (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY p_brand, p_type) AS r FROM c)
SELECT p_brand, p_type, least(1000, k * 30) // k + CASE WHEN r <= least(1000, k * 30) % k THEN 1 ELSE 0 END AS n FROM n""")
def allocate_counts(spark, d):
    return R.round_robin(table(spark, d, "part").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"], 1000, 30)


@query(None)
def decompose_counts(spark, d):
    """Per size and rule kind the examples of each stratum; tests hold it against brute force."""
    n = table(spark, d, "part").groupBy("p_size").agg((F.count(F.lit(1)) % 60).alias("n")).withColumn("permits", F.col("p_size") % 7 > 0)
    s = n.select("p_size", "n", "permits", R.decompose(F.col("n"), F.col("permits")).alias("s"))
    return s.select("p_size", "n", "permits", *[F.get("s", F.lit(i)).alias(k) for i, k in enumerate(R.SHARES)])


@query("""
WITH x AS (SELECT DISTINCT p_size * 7 + 10 AS l FROM part)
SELECT l, b, CASE b WHEN 'pass' THEN 1 WHEN 'boundary_low' THEN (9 * l + 9) // 10 WHEN 'boundary_eq' THEN l WHEN 'boundary_high' THEN l + 1 ELSE 11 * l // 10 + 1 END::BIGINT AS lo,
CASE b WHEN 'pass' THEN (9 * l + 9) // 10 - 1 WHEN 'boundary_low' THEN l - 1 WHEN 'boundary_eq' THEN l WHEN 'boundary_high' THEN 11 * l // 10 ELSE 5 * l // 2 END::BIGINT AS hi
FROM x, (VALUES ('pass'), ('fail'), ('boundary_low'), ('boundary_eq'), ('boundary_high')) t(b)""")
def bucket_interval(spark, d):
    x = table(spark, d, "part").select((F.col("p_size") * 7 + 10).alias("l")).distinct().select("l", F.explode(F.array(*[F.lit(k) for k in R.SHARES])).alias("b"))
    return x.select("l", "b", R.bucket(F.col("l"), F.col("b")).alias("i")).select("l", "b", "i.lo", "i.hi")


@query(f"""
WITH RECURSIVE h AS ({_HASHES}), k AS (SELECT p_type, h, min(p_partkey) AS id FROM h WHERE h IS NOT NULL GROUP BY 1, 2),
e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.p_type = b.p_type AND a.id <> b.id AND bit_count(xor(a.h, b.h)) <= 1),
r AS (SELECT id, id AS c FROM k UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY 1),
g AS (SELECT p_partkey, coalesce(c, p_partkey) AS component FROM h LEFT JOIN k USING (p_type, h) LEFT JOIN m USING (id))
SELECT p_partkey, component, count(*) OVER (PARTITION BY component) AS size FROM g""")
def build_groups(spark, d):
    return G.evidence_groups(hashes(spark, d), "p_partkey", "h", 1, 57, "p_type")


@query(f"""
WITH h AS ({_HASHES}), c AS (SELECT h, min(p_partkey) AS id, count(*) AS n FROM h WHERE h IS NOT NULL GROUP BY 1)
SELECT a.id AS a, a.n AS n_a, b.id AS b, b.n AS n_b, bit_count(xor(a.h, b.h))::INT AS distance FROM c a JOIN c b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 3""")
def close_hash_pairs(spark, d):
    return close_hashes(hashes(spark, d), "p_partkey", "h", 3, 57)


@query(f"""
WITH h AS ({_HASHES}), c AS (SELECT h, count(*) AS n FROM h WHERE h IS NOT NULL GROUP BY 1)
SELECT bit_count(xor(a.h, b.h))::INT AS distance, sum(a.n * b.n)::BIGINT AS pairs FROM c a JOIN c b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 3 GROUP BY 1
UNION ALL SELECT 0, sum(n * (n - 1) // 2)::BIGINT FROM c""")
def distance_histogram(spark, d):
    """How many pairs of rows are at each distance up to the radius, counted by classes."""
    return distances(hashes(spark, d), "p_partkey", "h", 3, 57)


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS a, 1000000000 + o_custkey * 7 % 1009 AS b FROM orders), s AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 400000),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h1 AS (SELECT DISTINCT b AS id FROM u WHERE a IN (FROM s) AND b NOT IN (FROM s)),
h2 AS (SELECT DISTINCT b AS id FROM u WHERE a IN (FROM h1) AND b NOT IN (FROM s) AND b NOT IN (FROM h1))
SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def hop_sets(spark, d):
    o = table(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("a"), (F.lit(1000000000) + F.col("o_custkey") * 7 % 1009).alias("b")).distinct()
    return G.hops(o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")), e, 2)


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT p_partkey AS id, p_partkey // 3 AS needs FROM part WHERE p_partkey % 4 < 3 AND p_partkey > 0),
bad AS (SELECT p_partkey AS id FROM part WHERE p_size = 7 UNION SELECT n.id FROM n JOIN bad ON n.needs = bad.id)
SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (FROM bad)""")
def required_context(spark, d):
    part = table(spark, d, "part")
    needs = part.where("p_partkey % 4 < 3 AND p_partkey > 0").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("needs"))
    return G.supported(part.where("p_size <> 7").select(F.col("p_partkey").alias("id")), needs)
