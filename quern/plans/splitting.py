"""Queries on splits: customers are groups, their orders images, segments labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import splitting as S
from quern.plans.registry import query, table

_ALPHA, _BAND = (1 / 3, 1 / 6), (0.60, 0.73)
_LABELS = 5
# The shares that the driver draws, for each attempt and label's turn, as the SQL must know them.
_DRAWS = ", ".join(f"({k}, {i + 1}, {p!r}::DOUBLE)" for k in range(50) for i, p in enumerate(S.drawn_shares(_LABELS, _ALPHA, k)))


def _partition(groups: str, prefix: str) -> str:
    """SQL of the accepted partition of a table (g, label, size): tables {prefix}chosen (k) and {prefix}sides (k, g, side)."""
    p = prefix
    return f"""{p}gr AS ({groups}), {p}tot AS (SELECT label, sum(size) AS total, row_number() OVER (ORDER BY sum(size), label) AS turn FROM {p}gr GROUP BY 1), dw(k, turn, share) AS (VALUES {_DRAWS}),
{p}run AS (SELECT k, g, label, size, coalesce(sum(size) OVER (PARTITION BY k, label ORDER BY sha256(k || '|' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {p}gr, range(50) t(k)),
{p}sides AS (SELECT r.k, g, r.label, size, CASE WHEN before < share * total THEN 0 ELSE 1 END AS side FROM {p}run r JOIN {p}tot USING (label) JOIN dw ON dw.k = r.k AND dw.turn = {p}tot.turn),
{p}sh AS (SELECT k, sum(CASE WHEN side = 0 THEN size ELSE 0 END) / sum(size) AS share FROM {p}sides GROUP BY 1), {p}chosen AS (SELECT min(k) AS k FROM {p}sh WHERE share BETWEEN {_BAND[0]} AND {_BAND[1]})"""


_GROUPS = "SELECT c_custkey AS g, c_mktsegment AS label, count(*) AS size FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"


def groups(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").select("o_custkey").join(c, "o_custkey").groupBy(F.col("o_custkey").alias("g"), F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("size"))


@query(f"WITH {_partition(_GROUPS, '')} SELECT g, side FROM sides JOIN chosen USING (k)")
def accepted_partition(spark, d):
    """Two sides by Dirichlet draws, drawn anew until the first side's share is within a band."""
    return S.accepted_partition(groups(spark, d), _ALPHA, _BAND, "g", "label", "size")[0].select("g", "side")


_MATERIAL = "CASE c_nationkey % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'AL' ELSE 'UNK' END"
_GS = f"gs AS (SELECT c_custkey AS g, {_MATERIAL} AS m, c_mktsegment AS label, {_MATERIAL} || '|' || c_mktsegment AS s, count(*) AS size FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4)"


def _ahead(by: str, seed: str, table_: str) -> str:
    return f"SELECT g, coalesce(sum(size) OVER (PARTITION BY {by} ORDER BY sha256('{seed}|' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY {by}) AS total FROM {table_}"


@query(f"""
WITH {_GS}, ev AS (SELECT g FROM ({_ahead("s", "split-eval", "gs")}) WHERE before * 5 < total), po AS (SELECT * FROM gs ANTI JOIN ev USING (g)), {_partition("SELECT g, label, size FROM po WHERE m = 'ST'", "st")},
cl AS (SELECT g, CASE side WHEN 0 THEN 'C1' ELSE 'C2' END AS client FROM stsides JOIN stchosen USING (k) UNION ALL SELECT g, 'C3' FROM po WHERE m = 'AL' UNION ALL SELECT g, 'C' || ((row_number() OVER (ORDER BY g) - 1) % 3 + 1) FROM po WHERE m = 'UNK'),
pc AS (SELECT po.*, client FROM po JOIN cl USING (g)), va AS (SELECT g FROM ({_ahead("client, s", "split-val", "pc")}) WHERE before * 10 < total),
ju AS (SELECT g FROM (SELECT g, row_number() OVER (PARTITION BY s ORDER BY sha256('split-judged|' || g), g) AS place, count(*) OVER (PARTITION BY s) AS n FROM gs SEMI JOIN ev USING (g)) WHERE place <= greatest(1, round_even(n * (1 / 7.0::DOUBLE), 0)))
SELECT o_orderkey AS unit, o_custkey AS g, CASE WHEN o_custkey IN (FROM ev) THEN 'eval' WHEN o_custkey IN (FROM va) THEN 'val' ELSE 'train' END AS split, client, o_custkey IN (FROM ju) AS judged FROM orders LEFT JOIN cl ON cl.g = o_custkey""")
def assigned_splits(spark, d):
    """Evaluation, clients, validation and the judged sample, whole groups at a time."""
    n = F.col("c_nationkey") % 3
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("g"), F.when(n == 0, "ST").when(n == 1, "AL").otherwise("UNK").alias("m"), F.col("c_mktsegment").alias("label"))
    units = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("g")).join(c, "g")
    return S.assign_splits(units, "unit", "g", "m", "label", _ALPHA, _BAND)


@query("""
WITH w AS (SELECT c_mktsegment AS client, count(*) * 3 // 4 AS k FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1), u AS (SELECT c_mktsegment AS client, c_custkey AS unit, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('n|' || c_custkey), c_custkey) AS place FROM customer WHERE c_nationkey % 4 = 1)
SELECT client, unit FROM u JOIN w USING (client) WHERE place <= k""")
def normal_sample(spark, d):
    return _normal(spark, d)[0]


@query("""
WITH w AS (SELECT c_mktsegment AS client, count(*) * 3 // 4 AS k FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1), u AS (SELECT c_mktsegment AS client, count(*) AS h FROM customer WHERE c_nationkey % 4 = 1 GROUP BY 1)
SELECT client, k - coalesce(h, 0) AS shortfall FROM w LEFT JOIN u USING (client) WHERE k > coalesce(h, 0)""")
def normal_shortfalls(spark, d):
    return _normal(spark, d)[1]


def _normal(spark, d):
    c = table(spark, d, "customer")
    pairs = c.where("c_nationkey % 2 = 0").groupBy(F.col("c_mktsegment").alias("client")).agg(F.count(F.lit(1)).alias("n"))
    return S.normal_sample(c.where("c_nationkey % 4 = 1").select(F.col("c_mktsegment").alias("client"), F.col("c_custkey").alias("unit")), pairs, "unit", 3, 4, "n")


_CELLS = ["AUTOMOBILE", "BUILDING", "NOWHERE"]


@query("""
WITH r AS (SELECT c_custkey AS key, c_mktsegment AS cell, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('b|' || c_custkey), c_custkey) AS place FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'NOWHERE')), t AS (SELECT key FROM r WHERE place <= 20)
SELECT row_number() OVER (ORDER BY sha256('b-sheet|' || key), key) AS place, key FROM t""")
def blind_sheet(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("cell"))
    return S.blind_sheet(c, "key", "cell", _CELLS, 60, "b")[0]


@query("""
WITH n AS (SELECT cell, count(c_custkey) AS population FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('NOWHERE')) t(cell) LEFT JOIN customer ON c_mktsegment = cell GROUP BY 1)
SELECT cell, population, least(20, population) AS drawn, 20 - least(20, population) AS shortfall, CASE WHEN population > 0 THEN round(least(20, population) / population, 6) END AS p FROM n""")
def sheet_cells(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("cell"))
    return S.blind_sheet(c, "key", "cell", _CELLS, 60, "b")[1]


@query(f"""
WITH x AS ({_GROUPS}), r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY label ORDER BY sha256('q|' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY label) AS total, sum(size) OVER () AS everything FROM x),
q AS (SELECT *, greatest(1, round_even(300 * total / everything, 0))::BIGINT AS quota FROM r) SELECT label, g, size, quota FROM q WHERE before < quota""")
def quota_groups(spark, d):
    return S.quota_groups(groups(spark, d), "label", "g", "size", 300, "q")


@query(None)
def source_splits(spark, d):
    """Whole lineages to validation by a greedy pass with a cap for each document; tests hold it against a plain loop."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("lineage"), F.col("o_orderpriority").alias("doc"))
    return S.source_split(o, "lineage", "doc", 0.2, 0.25, "s")


@query("""SELECT o_orderkey, (o_orderkey % 7 + ('0x' || substr(sha256('t|' || o_orderkey || '|' || o_custkey), 1, 12))::BIGINT % (o_custkey % 50 + 1))::BIGINT AS t FROM orders""")
def seeded_thicknesses(spark, d):
    """A seeded whole number inside each row's interval."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(k, S.seeded_values(k % 7, k % 7 + c % 50, F.lit("t"), k, c).alias("t"))
