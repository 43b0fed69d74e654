"""DuckDB SQL that gives the same rows as the queries of ``queries``.

The learned, sampled and keyed operators (1, 4, 5, 7) and the pipeline have none; tests hold them against brute force or held-out labels.
"""

_WORDS = r"[^\x20\x09-\x0D]+"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '</turn>', '\c'), '###', '\h')"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
 SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, coalesce(k.k, 0)::BIGINT AS verified_links
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id""",
    "op3_chat_formatting": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
f AS (SELECT *, '### ' || replace({_ESCAPED.format("role")}, ':', '\d') || ': ' || {_ESCAPED.format("text")} || '</turn>' || chr(10) AS f FROM t),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(f)) AS c FROM f GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(every) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, c::BIGINT AS formatted_chars FROM g""",
    "op10_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, {_PARTS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_PARTS} AS v FROM benchmark),
i AS (SELECT item_id, len(v) AS l, least(len(v), 5) AS k, v FROM b WHERE len(v) > 0),
ig AS (SELECT item_id, l, k, array_to_string(v[p:p + k - 1], ' ') AS g, count(*) AS m FROM i, unnest(range(1, l - k + 2)) AS t(p) GROUP BY ALL),
dg AS (SELECT doc_id, len(w) AS n, kk AS k, p, array_to_string(w[p:p + kk - 1], ' ') AS g FROM d, (SELECT DISTINCT k AS kk FROM i), unnest(range(1, len(w) - kk + 2)) AS t(p) WHERE len(w) >= kk),
h AS (SELECT doc_id, n, item_id, l, k, p, g, m FROM dg JOIN ig USING (k, g)),
o AS (SELECT doc_id, item_id, s, least(count(*), any_value(m)) AS c, any_value(least(l, n) - k + 1) AS a, any_value(l - k + 1) AS z, any_value(least(l, n)) AS width
 FROM h, unnest(range(greatest(p - (least(l, n) - k), 1), least(p, n - least(l, n) + 1) + 1)) AS t(s) GROUP BY doc_id, item_id, s, g),
q AS (SELECT doc_id, item_id, s, any_value(width) AS width, sum(c)::DOUBLE / (any_value(a) + any_value(z) - sum(c)) AS similarity FROM o GROUP BY doc_id, item_id, s)
SELECT doc_id, item_id, (s - 1)::INTEGER AS start_word, width::INTEGER AS n_words, similarity FROM q WHERE similarity >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1""",
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(s) WHERE len(w) >= 50),
x AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id),
r AS (SELECT doc_id, list_sort(list(DISTINCT s + k)) AS gone FROM x, range(50) AS t(k) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, w, gone FROM d LEFT JOIN r USING (doc_id)),
e AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d) ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM r) USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN e USING (doc_id)""",
    "op9_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
