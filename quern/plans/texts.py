"""Queries on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.functions import texts as T
from quern.plans.registry import query, table

_FACETS = {"number": r"[0-9]", "mail": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+", "license": "[Ll]icense", "link": "https?://"}
_KINDS = {"number": r"[0-9]+(?:\.[0-9]+)?", "unit": r"[0-9] ?(?:mm|cm|kg|%)"}


@query(r"""
WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
g AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN [] ELSE string_split(list_reduce(p, lambda a, s: a || CASE WHEN length(string_split(a, chr(1))[-1]) < 8 THEN ' ' ELSE chr(1) END || s), chr(1)) END AS s FROM p)
SELECT doc_id, len(s)::INT AS n, sha256(array_to_string(s, chr(10))) AS sha FROM g""")
def split_sentences(spark, d):
    s = S.sentences(F.coalesce("text", F.lit("")))
    out = table(spark, d, "documents").select("doc_id", s.alias("s"))
    return out.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\n").cast("binary"), 256).alias("sha"))


@query(None)
def pack_windows(spark, d):
    """Sentences cut at 600 characters and packed into windows of at most 1,200; (doc_id, window, chars, sha), none of texts without words."""
    s = table(spark, d, "documents").where("text is not null").select("doc_id", S.sentences(F.col("text")).alias("s"))
    w = s.select("doc_id", F.flatten(F.transform("s", lambda x: T.hard_split(x, 600))).alias("p")).select("doc_id", F.posexplode(T.pack(F.col("p"), 1200, 200)).alias("window", "text"))
    return w.select("doc_id", "window", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query(f"""
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _FACETS.items())}], lambda x: x IS NOT NULL), '+') AS facets FROM documents""")
def classify_facets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.facets(F.col("text"), _FACETS), "+").alias("facets"))


@query(r"""
WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS w, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}]', '', 'g')) AS h FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, array_to_string(list_filter([CASE WHEN h > 0 THEN 'other_script' END, CASE WHEN l = 0 THEN 'no_letters' END, CASE WHEN l > 0 AND w < l * 0.9 THEN 'low_share' END], lambda x: x IS NOT NULL), '+') AS problems FROM c""")
def language_problems(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.script_problems(F.coalesce("text", F.lit("")), "a-zA-Z", 0.9), "+").alias("problems"))


@query(r"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
k AS (SELECT conv_id, turn, text, before, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)?') AS an, regexp_extract_all(coalesce(before, ''), '[0-9]+(?:\.[0-9]+)?') AS bn,
 regexp_extract_all(coalesce(text, ''), '[0-9] ?(?:mm|cm|kg|%)') AS au, regexp_extract_all(coalesce(before, ''), '[0-9] ?(?:mm|cm|kg|%)') AS bu FROM t)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN len(list_filter(an, lambda x: NOT list_contains(bn, x))) > 0 THEN 'extra_number' END, CASE WHEN len(list_filter(bn, lambda x: NOT list_contains(an, x))) > 0 THEN 'missing_number' END,
 CASE WHEN len(list_filter(au, lambda x: NOT list_contains(bu, x))) > 0 THEN 'extra_unit' END, CASE WHEN len(list_filter(bu, lambda x: NOT list_contains(au, x))) > 0 THEN 'missing_unit' END], lambda x: x IS NOT NULL), '+') AS reasons FROM k""")
def numeric_lock(spark, d):
    """Each turn's numbers and units against those of the turn before."""
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = table(spark, d, "conversations").withColumn("before", F.coalesce(before, F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    return t.select("conv_id", "turn", F.array_join(T.lock_reasons(F.col("text"), F.col("before"), _KINDS), "+").alias("reasons"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, CASE WHEN regexp_matches(t, '\bAccept\b') THEN 'OK' WHEN regexp_matches(t, '\bReject\b') THEN 'NG' WHEN regexp_matches(t, '[0-9]') THEN 'NUM' END AS value FROM p""")
def parse_judgement(spark, d):
    return table(spark, d, "pages").select("page_id", T.anchored_verdict(F.col("html"), [(r"\bAccept\b", "OK"), (r"\bReject\b", "NG"), ("[0-9]", "NUM")]).alias("value"))


@query("""
WITH i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS p FROM lineitem), s AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY o ORDER BY p) <= 2 THEN 0 ELSE 1 END AS b FROM i),
g AS (SELECT *, sum(b) OVER (PARTITION BY o ORDER BY p) AS g FROM s), r AS (SELECT o, g, min(p) AS lo, max(p) AS hi FROM g GROUP BY 1, 2)
SELECT o, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS ranges FROM r GROUP BY 1""")
def group_pages(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set("l_suppkey").alias("p"))
    return i.select("o", F.array_join(T.page_ranges(F.col("p")), ",").alias("ranges"))


@query(r"""
SELECT c_custkey, coalesce(list_last(regexp_extract_all(c_name, '[0-9]+')), '') AS digits, split_part(c_name, '#', 1) AS name FROM customer""")
def id_scalars(spark, d):
    hashed = F.replace("c_name", F.lit("#"), F.lit(":"))
    return table(spark, d, "customer").select("c_custkey", T.last_digits(F.col("c_name")).alias("digits"), F.get(T.flag_names(F.array(hashed)), F.lit(0)).alias("name"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, coalesce(sha256(substr(l[1], 1, 200)), sha256('')) AS sha FROM l""")
def clean_reason(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.clean_reason(F.col("text")).cast("binary"), 256).alias("sha"))


@query(r"""
WITH x AS (SELECT doc_id, text, substr(text, 5, 20) AS q FROM documents)
SELECT doc_id, CASE WHEN contains(text, replace(q, ' ', '-')) THEN 'exact'
 WHEN regexp_replace(q, '[^0-9A-Za-z]', '', 'g') <> '' AND contains(lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')), lower(regexp_replace(q, '[^0-9A-Za-z]', '', 'g'))) THEN 'loose' ELSE 'failed' END AS state FROM x""")
def text_layer_check(spark, d):
    """A passage with hyphens for blanks against its whole text."""
    quote = F.replace(F.substr("text", F.lit(5), F.lit(20)), F.lit(" "), F.lit("-"))
    return table(spark, d, "documents").select("doc_id", T.contained(quote, F.col("text")).alias("state"))
