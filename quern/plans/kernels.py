"""Queries on 256-bit hashes, vectors, components and reach; digests of documents, near ones among them, stand for perceptual hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import kernels as K
from quern.plans.registry import query, table

# A hash for each customer: a digest of its segment and a few bits of its own, so that near ones occur; both engines make the same.
_HEX = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 > 0 THEN sha256('seg' || c_nationkey % 12)[1:56] || lpad(lower(hex(1 << (c_custkey % 5)::INT)), 8, '0') END AS h, 'M' || c_nationkey % 2 AS mat, sha256('f' || c_custkey // 3) AS sha, CASE WHEN c_custkey % 50 = 0 THEN 'k' || c_custkey % 3 ELSE '' END AS meta FROM customer"
_BITS = "SELECT id, h, mat, sha, meta, list_transform(range(32), lambda i: ('0x' || h[i * 2 + 1:i * 2 + 2])::UTINYINT) AS b FROM x"
_HAM = "list_sum(list_transform(range(1, 33), lambda i: bit_count(xor(a.b[i], c.b[i]))))"


def hashes(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    low = F.lpad(F.lower(F.hex(F.pow(F.lit(2), k % 5).cast("long"))), 8, "0")
    seg = F.substr(F.sha2(F.concat(F.lit("seg"), (n % 12).cast("string")), 256), F.lit(1), F.lit(56))
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 11 > 0, F.concat(seg, low)).alias("h"), F.concat(F.lit("M"), (n % 2).cast("string")).alias("mat"), F.sha2(F.concat(F.lit("f"), F.floor(k / 3).cast("string")), 256).alias("sha"),
        F.when(k % 50 == 0, F.concat(F.lit("k"), (k % 3).cast("string"))).otherwise("").alias("meta"),
    )


@query(f"""WITH x AS ({_HEX}), k AS (SELECT mat, h, min(id) AS id, count(*) AS n FROM x WHERE h IS NOT NULL GROUP BY 1, 2), y AS (SELECT mat, id, n, list_transform(range(32), lambda i: ('0x' || h[i * 2 + 1:i * 2 + 2])::UTINYINT) AS b FROM k)
SELECT a.mat, a.id AS a, a.n AS n_a, c.id AS b, c.n AS n_b, {_HAM}::INT AS distance FROM y a JOIN y c ON a.mat = c.mat AND a.id < c.id WHERE {_HAM} <= 10""")
def close_256(spark, d):
    """Hashes of 256 bits at most ten apart."""
    return K.close_classes(K.hash_classes(hashes(spark, d), "id", "h", ["mat"]), 10, ["mat"])


@query(f"WITH x AS ({_HEX}), y AS (SELECT id, b FROM ({_BITS}) WHERE h IS NOT NULL AND id < 120) SELECT a.id AS a, c.id AS b, {_HAM}::INT AS distance FROM y a, y c")
def hamming_matrix(spark, d):
    """The full matrix of a bounded set: that it is bounded is the feature."""
    return K.distance_matrix(hashes(spark, d).where("h is not null and id < 120"), "id", "h")


@query(f"WITH x AS ({_HEX}), y AS (SELECT id, b FROM ({_BITS}) WHERE h IS NOT NULL), p AS (SELECT {_HAM}::BIGINT AS distance FROM y a, y c WHERE a.id < c.id) SELECT distance, coalesce(n, 0) AS pairs FROM range(257) r(distance) LEFT JOIN (SELECT distance, count(*) AS n FROM p GROUP BY 1) USING (distance)")
def distance_histogram_256(spark, d):
    """How many pairs of all rows are 0 to 256 bits apart."""
    h = hashes(spark, d)
    return K.hash_scan(h, h, "id", "h", 0, same=True, pairs=False)[0]


@query(f"WITH x AS ({_HEX}), y AS (SELECT id, b FROM ({_BITS}) WHERE h IS NOT NULL) SELECT a.id AS a, c.id AS b, {_HAM}::BIGINT AS distance FROM y a, y c WHERE a.id % 20 = 1 AND c.id % 20 <> 1 AND {_HAM} <= 3")
def eval_hash_pairs(spark, d):
    """A stated set of rows against all others."""
    h = hashes(spark, d)
    return K.hash_scan(h.where("id % 20 = 1"), h.where("id % 20 <> 1"), "id", "h", 3)[1]


_GROUPS = f"""x AS ({_HEX}), y AS MATERIALIZED ({_BITS}), k AS MATERIALIZED (SELECT mat, h, min(id) AS id, count(*) AS n, any_value(b) AS b FROM y WHERE h IS NOT NULL GROUP BY 1, 2),
near AS MATERIALIZED (SELECT a.mat AS ma, c.mat AS mc, a.id AS a, c.id AS b, a.n AS na, c.n AS nc, {_HAM}::INT AS d FROM k a JOIN k c ON a.id < c.id WHERE {_HAM} <= 2),
e AS (SELECT y.id AS a, f.id AS b FROM y JOIN (SELECT mat, sha, min(id) AS id FROM x GROUP BY 1, 2) f USING (mat, sha) UNION SELECT y.id, f.id FROM y JOIN (SELECT mat, meta, min(id) AS id FROM x WHERE meta <> '' GROUP BY 1, 2) f USING (mat, meta) UNION SELECT y.id, k.id FROM y JOIN k USING (mat, h) UNION SELECT a, b FROM near WHERE ma = mc),
u AS MATERIALIZED (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT id, id AS c FROM x UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id), m AS (SELECT id, min(c) AS g FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {_GROUPS}, n AS (SELECT g, 'grp_' || min(mat) || '_' || min(sha)[1:12] AS group_id, count(*) AS size FROM m JOIN x USING (id) GROUP BY 1) SELECT id, group_id, size FROM m JOIN n USING (g)")
def evidence_groups_256(spark, d):
    """Groups by content, meta keys and near hashes, with ids from their content."""
    return K.evidence_groups(hashes(spark, d), "id", "sha", "h", "mat", 2, "meta")[0]


@query(f"""WITH RECURSIVE {_GROUPS} SELECT 'content' AS kind, sum(n - 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM x GROUP BY mat, sha) UNION ALL SELECT 'meta', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM x WHERE meta <> '' GROUP BY mat, meta)
UNION ALL SELECT 'hash', (SELECT sum(n * (n - 1) // 2) FROM k)::BIGINT + (SELECT sum(na * nc) FROM near WHERE ma = mc)::BIGINT""")
def evidence_edges(spark, d):
    return K.evidence_groups(hashes(spark, d), "id", "sha", "h", "mat", 2, "meta")[1]


@query(f"""WITH RECURSIVE {_GROUPS}, f AS (SELECT mat, sha, min(id) AS b FROM x GROUP BY 1, 2), g AS (SELECT mat, meta, min(id) AS b FROM x WHERE meta <> '' GROUP BY 1, 2)
SELECT DISTINCT * FROM (SELECT (min(b) OVER (PARTITION BY sha)) AS a, b, 0 AS distance FROM f UNION ALL SELECT (min(b) OVER (PARTITION BY meta)), b, NULL FROM g UNION ALL SELECT a, b, d FROM near WHERE ma <> mc AND d > 0 UNION ALL SELECT (min(id) OVER (PARTITION BY h)), id, 0 FROM k) WHERE a <> b""")
def evidence_crossing(spark, d):
    """What is as close but of another material."""
    return K.evidence_groups(hashes(spark, d), "id", "sha", "h", "mat", 2, "meta")[2]


_UNIT = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS v0 FROM embeddings WHERE embedding IS NOT NULL"
_NORM = f"u0 AS ({_UNIT}), ua AS (SELECT id, label, v0, list_avg(v0) AS mean FROM u0), u1 AS (SELECT id, label, list_transform(v0, lambda x: x - mean) AS c FROM ua), u2 AS MATERIALIZED (SELECT id, label, c, sqrt(list_sum(list_transform(c, lambda y: y * y))) AS n FROM u1), u AS MATERIALIZED (SELECT id, label, list_transform(c, lambda x: CASE WHEN n < 0.001 THEN 0.0 ELSE x / n END) AS v FROM u2)"


def units(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("id"), "label", K.unit_vectors(F.col("embedding").cast("array<double>")).alias("v"))


@query(f"WITH {_NORM} SELECT id, round(v[1], 9) AS first, round(v[len(v)], 9) AS last, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length FROM u")
def unit_vectors(spark, d):
    return units(spark, d).select("id", F.round(F.get("v", F.lit(0)), 9).alias("first"), F.round(F.element_at("v", -1), 9).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@query(f"WITH {_NORM}, s AS (SELECT a.id AS a, c.id AS b, round(list_inner_product(a.v, c.v), 12) AS s FROM u a JOIN u c ON a.id <> c.id) SELECT a, row_number() OVER (PARTITION BY a ORDER BY s DESC, b)::INT AS rank, b, round(s, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 3")
def nearest_vectors(spark, d):
    """The three nearest of all rows for each row."""
    return K.nearest(units(spark, d), "id", "v", 3).withColumn("score", F.round("score", 9))


@query(f"""WITH {_NORM}, s AS (SELECT a.id AS query, c.id // 4 AS owner, c.id % 4 AS win, round(list_inner_product(a.v, c.v), 12) AS s FROM u a JOIN u c ON a.id % 25 = 0 AND c.id % 25 > 0),
b AS (SELECT query, owner, win, s FROM s QUALIFY row_number() OVER (PARTITION BY query, owner ORDER BY s DESC, win) = 1) SELECT query, row_number() OVER (PARTITION BY query ORDER BY s DESC, owner)::INT AS rank, owner, win AS "window", round(s, 9) AS score FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, owner) <= 4""")
def best_owners(spark, d):
    """The best owners of windows for each query, an owner once."""
    u = units(spark, d)
    w = u.where("id % 25 > 0").select(F.floor(F.col("id") / 4).alias("owner"), (F.col("id") % 4).alias("window"), "v")
    return K.best_owners(u.where("id % 25 = 0").select(F.col("id").alias("query"), "v"), w, 4).withColumn("score", F.round("score", 9))


@query(f"WITH u0 AS ({_UNIT}), p AS (SELECT round(sqrt(list_sum(list_transform(range(1, len(a.v0) + 1), lambda i: pow((a.v0[i] - c.v0[i]) * 8, 2))) / len(a.v0)), 9) AS d FROM u0 a, u0 c WHERE a.id % 40 = 0 AND c.id % 40 > 0), h AS (SELECT CASE WHEN d < 30 THEN floor(d)::INT END AS bin, count(*) AS n FROM p GROUP BY 1) SELECT bin::INT AS bin, coalesce(n, 0) AS pairs FROM (SELECT unnest(range(30)) AS bin UNION ALL SELECT NULL) LEFT JOIN h ON h.bin IS NOT DISTINCT FROM bin".replace("ON h.bin IS NOT DISTINCT FROM bin", "ON h.bin IS NOT DISTINCT FROM z").replace("SELECT bin::INT AS bin, coalesce(n, 0) AS pairs FROM (SELECT unnest(range(30)) AS bin UNION ALL SELECT NULL)", "SELECT z::INT AS bin, coalesce(n, 0) AS pairs FROM (SELECT unnest(range(30)) AS z UNION ALL SELECT NULL)"))
def rms_histogram(spark, d):
    """Root mean square differences of a stated set to all others, by whole units."""
    e = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("v"))
    return K.rms_scan(e.where("id % 40 = 0"), e.where("id % 40 > 0"), "id", "v", 0.5, 10_000_000)[0]


@query("""
WITH p AS (SELECT c_nationkey AS f, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('rp|' || c_custkey), c_custkey) - 1 AS k FROM customer), n AS (SELECT f, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT f, n, sha256('rp|' || f || '|' || i) AS s FROM n, range(5) t(i)), x AS (SELECT f, n, ('0x' || s[1:12])::BIGINT % n AS x, ('0x' || s[13:24])::BIGINT AS z FROM e), y AS (SELECT f, x, (x + 1 + z % (n - 1)) % n AS y FROM x)
SELECT DISTINCT y.f AS folder, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM y JOIN p a ON a.f = y.f AND a.k = y.x JOIN p b ON b.f = y.f AND b.k = y.y""")
def random_pairs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_custkey").alias("id"))
    return K.seeded_pairs(c, "folder", "id", 5, "rp")


@query("""
WITH h AS (SELECT l_suppkey AS pic, (l_partkey % 256)::INT AS level, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT pic, sum(n) AS t FROM h GROUP BY 1), g AS (SELECT pic, t, r.l::INT AS level FROM t, range(256) r(l)),
c AS (SELECT g.pic, g.level, sum(coalesce(n, 0)) OVER (PARTITION BY g.pic ORDER BY g.level) / t AS c FROM g LEFT JOIN h ON h.pic = g.pic AND h.level = g.level), r AS (SELECT i AS l, round((i + 1) * (i + 1) / 65536.0::DOUBLE, 9) AS f FROM range(256) t(i))
SELECT pic, level, (SELECT least(count(*), 255) FROM r WHERE f < c)::INT AS mapped FROM c""")
def matched_levels(spark, d):
    """Grey levels mapped so that a picture's distribution becomes a given one."""
    li = table(spark, d, "lineitem")
    h = li.groupBy(F.col("l_suppkey").alias("pic"), (F.col("l_partkey") % 256).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    i = F.col("id")
    ref = spark.range(256).select(i.cast("int").alias("level"), F.round((i + 1) * (i + 1) / 65536.0, 9).alias("cdf"))
    return K.matched_levels(h, ref, "pic")


@query("""
WITH RECURSIVE g AS (SELECT c_custkey AS id, c_nationkey AS grp FROM customer), e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + 13) % (SELECT count(*) FROM customer) AS b FROM orders), j AS (SELECT e.a, e.b, x.grp AS ga, y.grp AS gb FROM e JOIN g x ON x.id = e.a JOIN g y ON y.id = e.b),
s AS (SELECT least(ga, gb) AS a, greatest(ga, gb) AS b FROM j WHERE ga <> gb GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r AS (SELECT DISTINCT grp AS id, grp AS c FROM g UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT g.id, m.c::BIGINT AS component FROM g JOIN m ON m.id = g.grp""")
def groups_by_edges(spark, d):
    """Groups that at least two edges join."""
    return K.groups_by_edges(*_linked(spark, d), "id", "grp", 2)[0]


def _linked(spark, d):
    c = table(spark, d, "customer")
    n = c.count()
    g = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("grp"))
    k = F.col("o_custkey")
    return g, table(spark, d, "orders").select(k.alias("a"), ((k * 7 + 13) % n).alias("b")).distinct()


@query("""
WITH RECURSIVE g AS (SELECT c_custkey AS id, c_nationkey AS grp FROM customer), e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + 13) % (SELECT count(*) FROM customer) AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT id FROM g WHERE id % 40 = 0),
o AS (SELECT DISTINCT b AS id FROM u WHERE a IN (FROM s) AND b NOT IN (FROM s)), og AS (SELECT id FROM o UNION SELECT id FROM g WHERE grp IN (SELECT grp FROM g WHERE id IN (FROM o)) AND id NOT IN (FROM s)),
t AS (SELECT id FROM og UNION SELECT b FROM u WHERE a IN (FROM og) AND b NOT IN (FROM s)), tg AS (SELECT id FROM t UNION SELECT id FROM g WHERE grp IN (SELECT grp FROM g WHERE id IN (FROM t)) AND id NOT IN (FROM s))
SELECT id, 1 AS hop FROM og UNION ALL SELECT id, 2 FROM tg WHERE id NOT IN (FROM og)""")
def group_reach(spark, d):
    """One and two steps from seeds, each with all of the groups it reaches."""
    g, e = _linked(spark, d)
    return K.reach(g.where("id % 40 = 0"), e, g, True)


@query(None)
def greedy_component_split(spark, d):
    """Components that a greedy pass holds out; tests hold it against a plain loop."""
    merged, _ = K.groups_by_edges(*_linked(spark, d), "id", "grp", 2)
    c = merged.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum")), "id")
    return K.greedy_split(c.groupBy("component", "stratum").agg(F.count(F.lit(1)).alias("n")), 0.2)


@query(None)
def correlation_peaks(spark, d):
    """Peaks of correlation of vectors as pictures of four rows, each with the next one; tests hold them against plain sums."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return K.correlation_peaks(j, "x", "y", 4, 0.25).select("vec_id", F.round("peak", 9).alias("peak"), "dx", "dy")
