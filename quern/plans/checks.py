"""Queries on constraints, reasons and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import checks as C
from quern.operators import ordered as O
from quern.plans.registry import query, table


@query("""
SELECT 'line_key' AS "check", k AS key FROM (SELECT l_orderkey || '/' || l_linenumber AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orphan', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'status', CAST(l_suppkey AS VARCHAR) FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1)
UNION ALL SELECT 'count', CAST(o_orderkey AS VARCHAR) FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) WHERE n <> o_orderkey % 7""")
def check_invariants(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("declared"))
    line = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return C.violations({
        "line_key": C.repeated(li.select(line.alias("k")), "k"), "orphan": C.orphans(li, "l_orderkey", o, "o_orderkey"),
        "status": C.several(li, "l_suppkey", F.col("l_linestatus")), "count": C.count_mismatch(o, "o_orderkey", "declared", li, "l_orderkey"),
    })


@query("""
WITH a AS (SELECT c_custkey AS k, c_nationkey % 3 AS v FROM customer WHERE c_custkey % 5 > 0), b AS (SELECT c_custkey AS k, c_nationkey % 4 AS v FROM customer WHERE c_custkey % 7 > 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def compare_log(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return C.compare_full(c.where("k % 5 > 0").select("k", (F.col("c_nationkey") % 3).alias("v")), c.where("k % 7 > 0").select("k", (F.col("c_nationkey") % 4).alias("v")), "k", "v")


_GATE = {"short": "n_chars < 200", "long": "n_chars > 5000", "lang": "lang <> 'en'", "quality": "quality = 0", "toxic": "toxic = 1", "unlabelled": "quality IS NULL"}


def _gated(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", C.reasons({k: F.expr(v) for k, v in _GATE.items()}).alias("reasons"))


_GATE_SQL = f"SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {v} THEN {chr(39)}{k}{chr(39)} END' for k, v in _GATE.items())}], lambda x: x IS NOT NULL) AS r FROM documents LEFT JOIN labels USING (doc_id)"


@query(f"SELECT doc_id, array_to_string(r, '+') AS reasons FROM ({_GATE_SQL})")
def gate_reasons(spark, d):
    return _gated(spark, d).withColumn("reasons", F.array_join("reasons", "+"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN ['accepted'] ELSE r END) AS reason FROM ({_GATE_SQL})) GROUP BY 1")
def gate_reason_counts(spark, d):
    return C.reason_counts(_gated(spark, d), "reasons")


@query("""
SELECT flag, n_with::BIGINT AS n_with, n, n_with * 10 >= n * 3 AS "on" FROM (SELECT count(*) AS n, count(*) FILTER (n_chars > 1000) AS a, count(*) FILTER (lang = 'en') AS b FROM documents), LATERAL (VALUES ('long', a), ('english', b)) t(flag, n_with)""")
def derive_capabilities(spark, d):
    return C.capabilities(table(spark, d, "documents"), {"long": F.col("n_chars") > 1000, "english": F.col("lang") == "en"}, 3, 10)


@query("""
WITH e AS (SELECT DISTINCT user_id, hour(ts)::INT AS hour FROM events) SELECT u.user_id, t.hour FROM (SELECT DISTINCT user_id FROM e) u, (SELECT DISTINCT hour FROM e) t
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = u.user_id AND e.hour = t.hour)""")
def audit_rounds(spark, d):
    return C.missing_grid(table(spark, d, "events").select("user_id", F.hour("ts").alias("hour")), "user_id", "hour")


@query("""
WITH t AS (SELECT sha256(text) AS c, count(*) AS n, min(source) AS lo, max(source) AS hi FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS contents, coalesce(sum(n), 0)::BIGINT AS rows, count(*) FILTER (lo <> hi) AS conflicts FROM t""")
def same_bytes(spark, d):
    return C.shared_content(table(spark, d, "documents"), F.sha2(F.col("text").cast("binary"), 256), F.col("source"))


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def gold_map(spark, d):
    return C.last_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
WITH x AS (SELECT l_suppkey AS a, l_partkey AS b, 'air' AS s FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_partkey, l_suppkey, 'sea' FROM lineitem WHERE l_quantity < 20)
SELECT least(a, b) AS a, greatest(a, b) AS b, array_to_string(list_sort(list(DISTINCT s)), '+') AS sources FROM x WHERE a <> b GROUP BY 1, 2""")
def union_candidates(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return C.tagged_union({"air": li.where("l_quantity > 40"), "sea": li.where("l_quantity < 20").select(F.col("b").alias("a"), F.col("a").alias("b"))}, "a", "b")


@query("SELECT path, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS path FROM events) GROUP BY 1")
def walk_keys(spark, d):
    return C.key_paths(table(spark, d, "events"), "props")


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_hours(spark, d):
    """Tumbling windows of an hour; quern.streaming.ledger.by_hour is the same plan on a stream."""
    from quern.streaming.ledger import by_hour

    h = by_hour(table(spark, d, "events"), None)
    return h.select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("""
WITH s AS (SELECT l_suppkey AS k, l_partkey AS id FROM lineitem GROUP BY 1, 2)
SELECT a.k, a.id AS a, b.id AS b FROM s a JOIN s b ON a.k = b.k AND b.id - a.id BETWEEN 1 AND 3""")
def id_pairs(spark, d):
    return O.close_numbers(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("id")), "k", "id", 3)
