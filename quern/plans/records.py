"""Queries on records, status texts and lists, composed from orders and lines with known faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.plans.registry import query, table
from quern.sources import records as R

_JSON = """'{"id": ' || o_orderkey || ', "s": {"w_mm": 1.5, "tags": ["a", null, ' || o_custkey % 3 || ']}' || CASE WHEN o_orderkey % 2 = 0 THEN ', "list": [{"k": true}, {"k": "x", "px": {}}]' ELSE '' END || '}'"""


@query("""
WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS e, count(*) FILTER (o_orderkey % 17 = 0) AS b, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 17 = 0) AS be FROM orders), v AS (SELECT n - b AS n, e - be AS e, b FROM o)
SELECT 'key' AS what, p AS path, NULL::VARCHAR AS kind, CASE WHEN ev THEN (SELECT e FROM v) * m ELSE (SELECT n FROM v) END::BIGINT AS n, NULL::INT AS least, NULL::INT AS most FROM (VALUES ('id', false, 1), ('s', false, 1), ('s.w_mm', false, 1), ('s.tags', false, 1), ('list', true, 1), ('list[].k', true, 2), ('list[].px', true, 1)) t(p, ev, m)
UNION ALL SELECT 'mark', 's.w_mm', NULL, n, NULL, NULL FROM v UNION ALL SELECT 'mark', 'list[].px', NULL, e, NULL, NULL FROM v UNION ALL SELECT 'list', 's.tags[]', NULL, n, 3, 3 FROM v UNION ALL SELECT 'list', 'list[]', NULL, e, 2, 2 FROM v UNION ALL SELECT 'broken', NULL, NULL, b, NULL, NULL FROM v WHERE b > 0
UNION ALL SELECT 'leaf', 'id', 'int', n, NULL, NULL FROM v UNION ALL SELECT 'leaf', 's.w_mm', 'float', n, NULL, NULL FROM v UNION ALL SELECT 'leaf', 's.tags[]', k, n, NULL, NULL FROM v, (VALUES ('str'), ('null'), ('int')) t(k) UNION ALL SELECT 'leaf', 'list[].k', k, e, NULL, NULL FROM v, (VALUES ('bool'), ('str')) t(k)""")
def json_census(spark, d):
    """Key paths, leaf types, list lengths and marked keys of nested JSON."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 17 == 0, "{").otherwise(F.expr(_JSON)).alias("j"))
    return R.census(o, "j", ("mm", "px")).drop("samples")


@query("""SELECT path, array_to_string(s, ',') AS samples FROM (SELECT 's.tags[]' AS path, list_sort(list_distinct(list_concat(['None', 'a'], list(DISTINCT (o_custkey % 3)::VARCHAR)))) AS s FROM orders UNION ALL SELECT 's.w_mm', ['1.5'] UNION ALL SELECT 'list[].k', ['True', 'x'])""")
def json_samples(spark, d):
    o = table(spark, d, "orders").select(F.expr(_JSON).alias("j"))
    c = R.census(o, "j").where("what = 'leaf' and path <> 'id'")
    return c.select("path", F.array_join("samples", ",").alias("samples")).distinct()


_LINE = "o_orderkey || ',' || CASE WHEN o_orderkey % 13 = 0 THEN 'x,' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 11 = 0 THEN '' ELSE o_custkey::VARCHAR END || ',' || CASE WHEN o_orderkey % 5 = 0 THEN 'maybe' ELSE 'True' END"


@query("""
WITH o AS (SELECT o_orderkey AS n, o_orderkey - o_orderkey % 19 % 2 AS k, o_orderkey % 13 = 0 AS r, o_orderkey % 7 = 0 AS u, o_orderkey % 5 = 0 AS b FROM orders), f AS (SELECT k, min(n) AS first FROM o WHERE NOT r GROUP BY 1)
SELECT n, 'ragged' AS fault, NULL AS field FROM o WHERE r UNION ALL SELECT n, 'unreadable', 'v' FROM o WHERE NOT r AND u UNION ALL SELECT n, 'unreadable', 'flag' FROM o WHERE NOT r AND b UNION ALL SELECT n, 'repeated', 'k' FROM o JOIN f USING (k) WHERE NOT r AND n > first""".replace("NULL AS field", "NULL::VARCHAR AS field"))
def csv_faults(spark, d):
    """Ragged lines, fields that cannot be read and repeated keys, all of them."""
    return R.csv_rows(_csv(spark, d), {"k": "bigint", "v": "bigint", "flag": "boolean"}, "k")[1]


@query("""
WITH o AS (SELECT o_orderkey AS n, o_orderkey - o_orderkey % 19 % 2 AS k, o_orderkey % 13 = 0 AS r, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS v FROM orders), f AS (SELECT k, min(n) AS first FROM o WHERE NOT r GROUP BY 1)
SELECT n, k, v, true AS flag FROM o JOIN f USING (k) WHERE NOT r AND n % 7 > 0 AND n % 5 > 0 AND n = first""")
def csv_good_rows(spark, d):
    return R.csv_rows(_csv(spark, d), {"k": "bigint", "v": "bigint", "flag": "boolean"}, "k")[0]


def _csv(spark, d):
    line = _LINE.replace("::VARCHAR", "").replace("ELSE o_custkey END", "ELSE CAST(o_custkey AS STRING) END").replace("o_orderkey || ','", "CAST(o_orderkey - o_orderkey % 19 % 2 AS STRING) || ','")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.expr(line).alias("line"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 IN (0, 1, 2) THEN NULL WHEN o_orderkey % 8 = 3 THEN '2.0' WHEN o_orderkey % 8 < 6 THEN '1.3' ELSE '1.4' END AS version, CASE o_orderkey % 8 WHEN 0 THEN 'blank' WHEN 1 THEN 'no_object' WHEN 2 THEN 'version' WHEN 3 THEN 'version' WHEN 4 THEN 'missing:seed' WHEN 6 THEN 'missing:gen_stop' END AS fault FROM orders""")
def prediction_faults(spark, d):
    k = F.col("o_orderkey") % 8
    base = '"image_id": "i", "cell": "c", "parse_ok": true'
    t = F.when(k == 0, "  ").when(k == 1, "[1]").when(k == 2, "{}").when(k == 3, '{"schema_version": "2.0"}').when(k == 4, '{"schema_version": "1.3", ' + base + "}").when(k == 5, '{"schema_version": "1.3", "seed": 1, ' + base + "}")
    t = t.when(k == 6, '{"schema_version": "1.4", "seed": 1, "n_new_tokens": 3, "coord_space": "x", ' + base + "}").otherwise('{"schema_version": "1.4", "seed": 1, "n_new_tokens": 3, "gen_stop": "eos", "coord_space": "x", ' + base + "}")
    return R.prediction_faults(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), t.alias("t")), "k", "t")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 AS t, o_custkey AS c FROM orders) SELECT k, CASE t WHEN 0 THEN 'bom' WHEN 1 THEN 'cr' WHEN 2 THEN 'empty' WHEN 3 THEN 'no_newline' WHEN 4 THEN 'utf8' WHEN 5 THEN 'blank' WHEN 6 THEN 'blank' WHEN 7 THEN 'twice' END AS fault,
CASE WHEN t = 8 THEN sha256('b' || c || chr(10) || 'a' || c || chr(10)) END AS file_sha256, CASE WHEN t = 8 THEN sha256('a' || c || chr(10) || 'b' || c || chr(10)) END AS set_sha256 FROM o""")
def list_faults(spark, d):
    """Byte checks of lists of ids, and the digests of good ones."""
    k, c = F.col("o_orderkey") % 9, F.col("o_custkey").cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p]).cast("binary")
    content = (
        F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), cat("a\n"))).when(k == 1, cat("a\r\n")).when(k == 2, cat("")).when(k == 3, cat("a\nb")).when(k == 4, F.concat(F.unhex(F.lit("61FF")), cat("\n"))).when(k == 5, cat("a\n\nb\n"))
        .when(k == 6, cat("a \n")).when(k == 7, cat("a\nb\na\n")).otherwise(cat("b", c, "\na", c, "\n"))
    )
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), content.alias("content")).withColumn("fault", R.list_fault(F.col("content")))
    return x.select("k", "fault", *[F.when(F.col("fault").isNull(), R.list_digests(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content")))[c]).alias(c) for c in ("file_sha256", "set_sha256")])


_HEADER = ["epoch", "time", "metrics/a", "val/b", "lr/x"]


@query("""
WITH o AS (SELECT o_orderkey AS n, o_orderkey % 6 AS t, o_custkey AS c FROM orders) SELECT n, CASE t WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'remapped' WHEN 3 THEN 'epoch' ELSE 'ok' END AS state, CASE WHEN t IN (2, 4, 5) THEN c::DOUBLE END AS epoch, CASE WHEN t IN (4, 5) THEN 0.5 END AS a, CASE WHEN t IN (2, 4, 5) THEN 0.01 END AS lr FROM o""")
def result_states(spark, d):
    """Result rows: kept, older ones put in place, others dropped with why."""
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    line = F.when(k == 0, "1,2,3,4,5,6").when(k == 1, F.concat(c, F.lit(",1"))).when(k == 2, F.concat(c, F.lit(", 3 ,0.01"))).when(k == 3, "x,1,0.5,1,0.01").when(k == 4, F.concat(F.lit("﻿"), c, F.lit(",1,0.5,,0.01"))).otherwise(F.concat(c, F.lit(",1,0.5,2,0.01")))
    r = R.result_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), line.alias("line")), _HEADER)
    return r.select("n", "state", F.col("values")["epoch"].alias("epoch"), F.col("values")["metrics/a"].alias("a"), F.col("values")["lr/x"].alias("lr"))


@query("""SELECT o_orderkey AS k, o_orderkey % 9 IN (0, 1) AS available, o_orderkey % 9 <> 0 AS stale, CASE o_orderkey % 9 WHEN 0 THEN 60 WHEN 1 THEN 300 END::BIGINT AS age, CASE o_orderkey % 9 WHEN 2 THEN 'no_object' WHEN 3 THEN 'run' WHEN 4 THEN 'time' WHEN 5 THEN 'time' WHEN 6 THEN 'count' WHEN 7 THEN 'rows' WHEN 8 THEN 'pending' END AS reason FROM orders""")
def live_states(spark, d):
    """Status texts: available or not, fresh or stale."""
    k = F.col("o_orderkey") % 9
    def status(at="2026-01-01T00:09:00Z", run="r", g=2, rows=128, judged=64, pending=936):
        return f'{{"run_id": "{run}", "identity": "i", "observed_at_utc": "{at}", "generated_shards": {g}, "generated_rows": {rows}, "judged_shards": 1, "judged_rows": {judged}, "pending_judge_rows": {pending}}}'
    t = (
        F.when(k == 0, status()).when(k == 1, status("2026-01-01T00:05:00Z")).when(k == 2, "nothing").when(k == 3, status(run="x")).when(k == 4, status("2026-01-01T00:09:00")).when(k == 5, status("2026-01-01T00:11:00+00:00")).when(k == 6, status(g=99))
        .when(k == 7, status(rows=127)).otherwise(status(pending=1))
    )
    now = F.to_timestamp(F.lit("2026-01-01T00:10:00Z"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), R.live_status(t, now, "r", "i", 1000).alias("s")).select("k", "s.*")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 't' || event_id ELSE 'u' END AS at, event_type AS event, CASE WHEN event_id % 3 = 0 THEN 'details_redacted' ELSE 'ok 1' END AS reason, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 7)::DOUBLE END AS judged_shards, CASE WHEN event_type = 'error' THEN 'Failed' ELSE '' END AS message FROM events""")
def event_views(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit('{"event": "'), "event_type", F.lit('", '), F.when(k % 2 == 0, F.concat(F.lit('"at": "t'), s(k), F.lit('", '))).otherwise('"observed_at_utc": "u", '), F.when(k % 3 == 0, '"reason": "/root/x$", ').otherwise('"reason": "ok 1", '),
        F.when(k % 5 == 0, '"shards": 1e13').otherwise(F.concat(F.lit('"shards": '), s(k % 7))), F.lit("}"),
    )
    v = e.select(k, R.event_view(text, {"error": "Failed"}).alias("v"))
    return v.select("event_id", "v.at", "v.event", "v.reason", "v.judged_shards", "v.message")


@query("""
WITH b AS (SELECT l_orderkey AS u, l_returnflag AS c, l_linenumber::DOUBLE AS x, l_quantity AS y FROM lineitem WHERE l_quantity > 30), g AS (SELECT u, string_agg('{"code":"' || c || '","box":[' || x || ',0.0,' || y || ',1.0]}', ',' ORDER BY c, x, y) AS s FROM b GROUP BY 1)
SELECT o_orderkey * 2 AS place, '{"image_id":' || o_orderkey || ',"defects":[' || coalesce(s, '') || ']}' AS line FROM orders LEFT JOIN g ON u = o_orderkey""")
def prediction_lines(spark, d):
    """One JSON line for each image in a given order."""
    b = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("u"), F.col("l_returnflag").alias("code"), F.col("l_linenumber").cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.lit(1.0).alias("y2"))
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("u"), (F.col("o_orderkey") * 2).alias("place"))
    return R.prediction_lines(b, order, "u")


@query("""
WITH c AS (SELECT c_custkey + 2 AS n, c_custkey AS k, 's' || c_nationkey AS st, c_nationkey AS z FROM customer), l AS (SELECT n, k, st, z, k % 23 = 0 AS ragged, k % 29 = 0 AS nodig, k % 31 = 0 AS big, k % 37 = 0 AS other, k % 41 = 0 AND k > 0 AS dup FROM c)
SELECT n, 'fields' AS fault FROM l WHERE ragged UNION ALL SELECT n, 'integer' FROM l WHERE NOT ragged AND nodig UNION ALL SELECT n, 'size' FROM l WHERE NOT ragged AND NOT nodig AND big
UNION ALL SELECT n, 'stratum' FROM (SELECT l.*, CASE WHEN big THEN 99 WHEN other THEN 4 ELSE 5 END AS nh, first(CASE WHEN big THEN 99 WHEN other THEN 4 ELSE 5 END) OVER (PARTITION BY st ORDER BY n) AS f FROM l WHERE NOT ragged AND NOT nodig) WHERE nh <> f
UNION ALL SELECT n, 'twice' FROM l WHERE NOT ragged AND dup AND (k - 1) % 23 > 0 UNION ALL SELECT n, 'order' FROM l WHERE ragged OR dup""")
def side_file_faults(spark, d):
    """A side file's lines against the list of ids."""
    k, s = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    name = F.concat(F.lit("i"), F.when((k % 41 == 0) & (k > 0), k - 1).otherwise(k).cast("string"))
    size = F.when(k % 29 == 0, "05").when(k % 31 == 0, "99").when(k % 37 == 0, "4").otherwise("5")
    line = F.concat_ws(",", name, F.concat(F.lit("s"), s), F.lit("10"), size)
    c = table(spark, d, "customer")
    lines = c.select((k + 2).alias("n"), F.when(k % 23 == 0, F.concat(line, F.lit(",x"))).otherwise(line).alias("line"))
    head = spark.createDataFrame([(1, "image_id,stratum,G_h,n_h")], "n long, line string")
    ids = c.select((k + 1).alias("n"), F.concat(F.lit("i"), k.cast("string")).alias("id"))
    return R.side_faults(head.union(lines), ids)


@query("""SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 9 >= l_suppkey % 9 OR l_quantity::INT % 5 = 0 AS degenerate, l_suppkey % 9 - l_partkey % 9 AS w, (l_quantity::INT % 5) AS h, l_orderkey AS number, l_returnflag IN ('A', 'ALL') OR l_linenumber % 3 = 0 AS method, l_linenumber % 2 = 0 AND l_returnflag <> 'N' AS fires FROM lineitem""")
def small_predicates(spark, d):
    """Degenerate boxes, corners to sizes, numbers of ids, wildcards and fired records."""
    x1, x2, h = F.col("l_partkey") % 9, F.col("l_suppkey") % 9, F.col("l_quantity").cast("int") % 5
    box = (x1, F.lit(0), x2, h)
    size = S.xywh(box)
    none = F.array().cast("array<string>")
    accepted = F.when(F.col("l_linenumber") % 3 == 0, none).otherwise(F.array("l_returnflag"))
    codes = F.when(F.col("l_returnflag") != "N", F.array("l_returnflag")).otherwise(none)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), S.degenerate(box).alias("degenerate"), size[2].alias("w"), size[3].alias("h"), S.id_number(F.concat(F.lit("a:b:"), F.col("l_orderkey").cast("string"))).alias("number"),
        S.matches_or_all(accepted, F.lit("A")).alias("method"), S.fires(F.col("l_linenumber") % 2 == 0, codes).alias("fires"),
    )


@query("SELECT o_orderkey, o_orderstatus = 'O' AS normal, o_orderpriority LIKE '1%' AS placed FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority NOT LIKE '1%'")
def flagged_images(spark, d):
    """Images without defects, and those that can be localised; null flags are false."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", False).when(F.col("o_orderstatus") == "F", True).otherwise(True).alias("has_defect"), F.when(F.col("o_orderpriority").startswith("1"), True).alias("has_localization"), "o_orderstatus")
    kept = o.where((F.col("o_orderstatus") != "P") | ~S.flag(F.col("has_localization")))
    return kept.select("o_orderkey", (~S.flag(F.col("has_defect"))).alias("normal"), S.flag(F.col("has_localization")).alias("placed"))


@query("""
WITH s AS (SELECT o_orderkey AS unit, o_orderkey % 3 = 0 AS defect FROM orders WHERE o_custkey % 4 > 0), r AS (SELECT l_orderkey AS unit, bool_or(l_quantity > 40) AS fired FROM lineitem WHERE l_orderkey % 11 > 0 GROUP BY 1), j AS (SELECT s.*, r.unit IS NULL AS missing, coalesce(fired, false) AS fired FROM s LEFT JOIN r USING (unit))
SELECT defect, count(*) FILTER (NOT missing) AS n, count(*) FILTER (missing) AS n_missing, round(count(*) FILTER (fired AND NOT missing) / count(*) FILTER (NOT missing), 9) AS rate FROM j GROUP BY 1""")
def fire_rates(spark, d):
    """Fire rates by gold over the images of one provenance; images without a record are counted apart."""
    from quern.operators.evaluation import fire_rates as rates

    contexts = table(spark, d, "orders").where("o_custkey % 4 > 0").select(F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 3 == 0).alias("defect"))
    r = table(spark, d, "lineitem").where("l_orderkey % 11 > 0").groupBy(F.col("l_orderkey").alias("unit")).agg(F.bool_or(F.col("l_quantity") > 40).alias("fired"))
    return rates(contexts, r, "unit").withColumn("rate", F.round("rate", 9))


@query("""
WITH t AS (SELECT lang AS label, source AS unit, max(n_chars) AS s, max((doc_id % 3 = 0)::INT) AS g FROM documents WHERE n_chars IS NOT NULL GROUP BY 1, 2), u AS (SELECT label, s, count(*) AS n, sum(g) AS pos FROM t GROUP BY 1, 2), r AS (SELECT label, pos, sum(n) OVER w AS n, sum(pos) OVER w AS hits FROM u WINDOW w AS (PARTITION BY label ORDER BY s DESC))
SELECT label, round(CASE WHEN sum(pos) > 0 THEN sum(pos * hits / n) / sum(pos) END, 9) AS ap FROM r GROUP BY 1""")
def image_level_ap_by_class(spark, d):
    """Average precision by class, an image once by its best score, ties together."""
    from quern.operators.evaluation import average_precision_by

    docs = table(spark, d, "documents").where("n_chars is not null").select(F.col("lang").alias("label"), F.col("source").alias("unit"), F.col("n_chars").alias("s"), (F.col("doc_id") % 3 == 0).cast("int").alias("g"))
    return average_precision_by(docs, ["label"], "unit", "s", "g").withColumn("ap", F.round("ap", 9))


@query("""
WITH v AS (SELECT l_linenumber % 4 AS cell, l_suppkey AS g, l_quantity AS s, l_returnflag = 'R' AS p FROM lineitem), t AS (SELECT cell, s, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM v GROUP BY 1, 2), r AS (SELECT cell, a, b, coalesce(sum(b) OVER (PARTITION BY cell ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
c AS (SELECT cell, sum(a * (2 * below + b)) / (sum(a) * sum(b)) - 1 AS gini FROM r GROUP BY 1), x AS (SELECT max(gini) FILTER (cell = 0) AS c, max(gini) FILTER (cell = 1) AS f, avg(gini) FILTER (cell > 1) AS l FROM c)
SELECT unnest(['fed_minus_central', 'fed_minus_local_mean', 'central_minus_local_mean']) AS contrast, round(unnest([f - c, f - l, c - l]), 9) AS value FROM x""")
def gini_contrasts(spark, d):
    """Threshold-free scores by cell and their contrasts."""
    from quern.operators.evaluation import gini_by, gini_contrasts as contrasts

    n = F.col("l_linenumber") % 4
    rows = table(spark, d, "lineitem").select(F.when(n == 0, "central").when(n == 1, "fed").otherwise(F.concat(F.lit("local"), n.cast("string"))).alias("cell"), F.col("l_quantity").alias("s"), (F.col("l_returnflag") == "R").alias("p"))
    return contrasts(gini_by(rows, ["cell"], "s", F.col("p")), "central", "fed", "local").withColumn("value", F.round("value", 9))


@query("""
WITH w AS (SELECT l_orderkey AS u, l_orderkey % 3 AS w FROM lineitem GROUP BY 1), h AS (SELECT l_returnflag AS label, l_orderkey AS u, l_orderkey * 10 + l_linenumber AS id, min(l_partkey % 500) / 500.0 AS s, min(l_suppkey) % 3 > 0 AS hit FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT label, sum((l_orderkey % 3) * 1) AS n FROM (SELECT DISTINCT l_returnflag AS label, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1),
r AS (SELECT label, hit, w, sum(CASE WHEN hit THEN w ELSE 0 END) OVER o AS tp, sum(w) OVER o AS n FROM h JOIN w USING (u) WINDOW o AS (PARTITION BY label ORDER BY s DESC, u, id)), q AS (SELECT r.label, floor(tp * 100 / g.n) AS reach, max(tp / r.n) AS p FROM r JOIN g USING (label) WHERE hit AND w > 0 GROUP BY 1, 2),
k AS (SELECT g.label, i AS reach, p FROM g CROSS JOIN range(101) t(i) LEFT JOIN q ON q.label = g.label AND q.reach = i), m AS (SELECT label, coalesce(max(p) OVER (PARTITION BY label ORDER BY reach DESC), 0) AS p FROM k) SELECT label, round(avg(p), 9) AS ap FROM m GROUP BY 1""")
def weighted_ap(spark, d):
    """Average precision in which each image counts its weight; weights of one give the plain score."""
    from quern.operators.evaluation import weighted_precision

    li = table(spark, d, "lineitem")
    h = li.groupBy(F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pred_id")).agg((F.min(F.col("l_partkey") % 500) / 500.0).alias("score"), (F.min("l_suppkey") % 3 > 0).alias("hit"))
    gold = li.select(F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("unit"), "l_linenumber").distinct()
    w = li.select(F.col("l_orderkey").alias("unit"), (F.col("l_orderkey") % 3).alias("weight")).distinct()
    return weighted_precision(h, gold, w, "label").withColumn("ap", F.round("ap", 9))
