"""Queries on generated text: it is composed from lines and orders with known faults, so SQL knows what must be found without reading it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import generated as G
from quern.functions import locks as K
from quern.functions import texts as X
from quern.plans.registry import query, table

# One generated answer for each line, of kinds by part modulo 12: expressions both engines read.
_ITEM = """'{"iso_code": "' || CASE WHEN l_suppkey % 5 = 0 THEN '77' WHEN l_suppkey % 5 = 1 THEN '300' ELSE '100' END || '", "bbox_2d": [' || l_linenumber || ', 2.5, ' || (l_linenumber + CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 4 END) || ', 9]}'"""
_GOOD = f"""'{{"defects": [' || {_ITEM} || ', {{"bbox_2d": [1, 2]}}], "verdict": ' || CASE WHEN l_suppkey % 3 = 0 THEN '"PASS"' ELSE '7' END || ', "cited_clauses": ' || CASE WHEN l_suppkey % 2 = 0 THEN '["a", "b"]' ELSE '"a"' END || ', "s": "br{{ace]"}}'"""
_TEXT = f"""CASE l_partkey % 12 WHEN 0 THEN 'no object at all' WHEN 1 THEN substr({_GOOD}, 1, length({_GOOD}) - 3) WHEN 2 THEN '{{"defects": {{}}}}' WHEN 3 THEN '{{"defects": [1,]}} x' WHEN 4 THEN 'Here: ' || {_GOOD} || ' done' WHEN 5 THEN '```json\n' || {_GOOD} || '\n```' WHEN 6 THEN '  ' || {_GOOD}
WHEN 7 THEN '' WHEN 8 THEN {_GOOD} || {_GOOD} WHEN 9 THEN '{{"a": [1}}' WHEN 10 THEN '{{"defects": []}} tail' ELSE {_GOOD} END"""
_KEY = "l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, l_suppkey AS s, l_linenumber AS n"
_OK = "p % 12 IN (4, 5, 6, 8, 11)"


def answers(spark, d):
    return table(spark, d, "lineitem").selectExpr(*_KEY.split(", "), f"{_TEXT} AS text".replace("\n```json", "```json"))


def _distinct(df):
    """Lines of one key that are made from several rows: one is enough."""
    return df.distinct()


@query(f"""WITH t AS (SELECT DISTINCT {_KEY}, {_TEXT} AS text FROM lineitem)
SELECT id, p, s, p % 12 IN (1, 2, 3, 6, 8, 9, 10, 11) AS eligible, p % 12 IN (2, 3, 6, 8, 10, 11) AS closed, p % 12 = 9 AS invalid, CASE p % 12 WHEN 2 THEN 14 WHEN 3 THEN 16 WHEN 6 THEN length(text) - 1 WHEN 8 THEN length(text) // 2 - 1 WHEN 10 THEN 14 WHEN 11 THEN length(text) - 1 END::INT AS at FROM t""")
def object_ends(spark, d):
    """Where the object that a text begins with ends."""
    return _distinct(answers(spark, d)).select("id", "p", "s", G.object_close(F.col("text")).alias("c")).select("id", "p", "s", "c.*")


@query(f"""WITH t AS (SELECT DISTINCT {_KEY}, {_TEXT} AS text FROM lineitem)
SELECT id, p, s, CASE WHEN {_OK} OR p % 12 = 10 THEN 'ok' ELSE 'record_fail' END AS outcome, CASE WHEN p % 12 IN (0, 7) THEN 'no_json' WHEN p % 12 = 1 THEN 'truncated' WHEN p % 12 IN (3, 9) THEN 'json_decode' WHEN p % 12 = 2 THEN 'schema_violation' END AS reason,
CASE WHEN {_OK} AND s % 5 > 1 AND s % 7 > 0 THEN 1 ELSE 0 END::INT AS n_kept, CASE WHEN {_OK} THEN 1 + (s % 7 = 0)::INT ELSE 0 END::INT AS n_bad, ({_OK} AND s % 5 = 0 AND s % 7 > 0)::INT AS n_unknown, ({_OK} AND s % 5 = 1 AND s % 7 > 0)::INT AS n_out_of_scope,
CASE WHEN {_OK} AND s % 3 = 0 THEN 'PASS' END AS verdict, CASE WHEN {_OK} AND s % 2 = 0 THEN 'a+b' ELSE '' END AS cited,
CASE WHEN p % 12 = 10 THEN 'citations_invalid+verdict_invalid' WHEN NOT {_OK} THEN '' ELSE array_to_string(list_filter([CASE WHEN s % 2 > 0 THEN 'citations_invalid' END, CASE WHEN s % 3 > 0 THEN 'verdict_invalid' END], lambda x: x IS NOT NULL), '+') END AS clause_error FROM t""")
def read_predictions(spark, d):
    """Predictions read from generated texts, each failure by its class."""
    p = _distinct(answers(spark, d)).select("id", "p", "s", G.read_prediction(F.col("text"), ["100", "300"], ["100"], ["PASS", "FAIL"]).alias("r")).select("id", "p", "s", "r.*")
    return p.select("id", "p", "s", "outcome", "reason", F.size("kept").alias("n_kept"), "n_bad", "n_unknown", "n_out_of_scope", "verdict", F.array_join("cited", "+").alias("cited"), F.array_join("clause_error", "+").alias("clause_error"))


@query(f"""WITH t AS (SELECT DISTINCT {_KEY}, {_TEXT} AS text FROM lineitem), x AS (SELECT *, CASE s % 4 WHEN 0 THEN 'eos' WHEN 1 THEN 'length' WHEN 2 THEN 'other' END AS stop FROM t),
y AS (SELECT *, CASE p % 12 WHEN 4 THEN 'Here: done' WHEN 8 THEN substr(text, length(text) // 2 + 1) WHEN 10 THEN 'tail' ELSE '' END AS said, {_OK} OR p % 12 = 10 AS ok, coalesce(stop IN ('eos', 'length'), false) AS known FROM x)
SELECT id, p, s, CASE WHEN NOT known THEN 'validation_error' WHEN NOT ok THEN 'record_fail' WHEN said = '' THEN 'missing' WHEN stop = 'length' THEN 'truncated' ELSE 'complete' END AS state, CASE WHEN known AND ok THEN said END AS narrative, CASE WHEN known AND ok THEN p % 12 = 4 END AS front_text, CASE WHEN known AND ok THEN stop END AS stop_kept FROM y""")
def narratives(spark, d):
    """What is said around an object, and in which state the text is."""
    s = F.col("s") % 4
    stop = F.when(s == 0, "eos").when(s == 1, "length").when(s == 2, "other")
    n = _distinct(answers(spark, d)).select("id", "p", "s", G.narrative(F.col("text"), stop, ["eos", "length"]).alias("n"))
    return n.select("id", "p", "s", "n.state", "n.narrative", "n.front_text", "n.stop_kept")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 9 < 2 OR l_partkey % 9 IS NULL THEN 'unknown_code' WHEN l_suppkey % 6 = 0 OR l_suppkey % 6 = 1 OR l_linenumber >= l_quantity OR l_suppkey % 6 = 2 THEN 'bad_item' WHEN l_partkey % 9 < 5 THEN 'out_of_scope' ELSE 'kept' END AS state FROM lineitem""")
def item_states(spark, d):
    """Items by what becomes of them, without leaving the JVM."""
    k, s = F.col("l_partkey") % 9, F.col("l_suppkey") % 6
    code = F.when(k < 2, "x").otherwise(k.cast("string"))
    x1, x2 = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    box = F.when(s == 0, F.lit(None)).when(s == 1, F.array(x1, x2)).when(s == 2, F.array(x1, F.lit(0.0), x2, F.lit(float("nan")))).otherwise(F.array(x1, F.lit(0.0), x2, F.lit(1.0)))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), G.item_state(code, box, [str(i) for i in range(2, 9)], [str(i) for i in range(5, 9)]).alias("state"))


_JSONS = """CASE o_orderkey % 9 WHEN 0 THEN '{"a": 1, "a": 2}' WHEN 1 THEN '{"a": NaN}' WHEN 2 THEN '  ' WHEN 3 THEN '[1]' WHEN 4 THEN '{"a": ' WHEN 5 THEN '{"a": {"b": 1, "b": 1}}' WHEN 6 THEN NULL WHEN 7 THEN '{"a": -Infinity}' ELSE '{"a": ' || o_custkey || ', "b": [{"c": 1}, {"c": 1}]}' END"""


@query("SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'duplicate_key' WHEN 5 THEN 'duplicate_key' WHEN 1 THEN 'constant' WHEN 7 THEN 'constant' WHEN 2 THEN 'blank' WHEN 6 THEN 'blank' WHEN 3 THEN 'no_object' WHEN 4 THEN 'invalid' END AS fault FROM orders")
def strict_json_faults(spark, d):
    """What a strict JSON reader refuses."""
    return table(spark, d, "orders").select("o_orderkey", G.json_fault(F.expr(_JSONS)).alias("fault"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '') || ' e' || chr(769) || chr(44032)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS sha FROM documents""")
def normal_digests(spark, d):
    """Digests of texts in composed normal form; a decomposed letter is added to each, which must be composed."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" é가"))
    t = F.trim(F.regexp_replace(G.normal_form(text), r"\s+", " "))
    return table(spark, d, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("sha"))


@query("""
WITH t AS (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1 + (doc_id % 50)::INT, 40), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS sub FROM documents)
SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN length(sub) = 0 THEN 0 ELSE 1 END WHEN doc_id % 3 = 1 THEN 0 ELSE length(sub) / (length(sub) + 5) END, 9) AS ratio FROM t""")
def echo_ratios(spark, d):
    """How much of a reason echoes its text: all, nothing, or all but five signs that the text cannot hold."""
    t = F.coalesce("text", F.lit(""))
    sub, k = F.substr(t, (F.col("doc_id") % 50 + 1).cast("int"), F.lit(40)), F.col("doc_id") % 3
    signs = "☃" * 5
    reason = F.when(k == 0, sub).when(k == 1, signs).otherwise(F.concat(sub, F.lit(signs)))
    return table(spark, d, "documents").select("doc_id", F.round(G.echo_ratio(reason, t), 9).alias("ratio"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 2 THEN 'too short ' || o_custkey ELSE 'none' END AS reason, o_orderkey % 6 <> 2 AS echoed FROM orders""")
def own_reasons(spark, d):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    out = F.when(k == 0, "").when(k == 1, "<think>x</think>OK").when(k == 2, F.concat(F.lit("NG: too short "), c)).when(k == 3, F.concat(F.lit("NG - the weld number "), c)).when(k == 4, F.lit(None)).otherwise("NG.\n the weld")
    source = F.concat(F.lit("see the  weld number "), c)
    return table(spark, d, "orders").select("o_orderkey", G.own_reason(out, source, 0.8, "none").alias("r")).select("o_orderkey", "r.*")


@query("""SELECT o_orderkey, o_orderkey % 7 IN (1, 4) AS ok, o_orderkey % 7 IN (1, 2, 3, 4) AS parsed FROM orders""")
def judgements(spark, d):
    k = F.col("o_orderkey") % 7
    out = F.when(k == 0, "LOOKS GOOD").when(k == 1, "<think>NG?</think>Verdict: ok").when(k == 2, "ok\nVerdict: NG").when(k == 3, "first\nNG").when(k == 4, "text\n OK ").when(k == 5, " ").otherwise("TOKEN")
    return table(spark, d, "orders").select("o_orderkey", G.judgement(out, [r"Verdict:\s*(OK|NG)\b", r"^\s*(?:(OK)|(NG))\s*$"]).alias("j")).select("o_orderkey", "j.*")


# A locked text for each line, its fault by part modulo 10.
_SAY = """'Size ' || (l_quantity::BIGINT + 100) || '.50 mm at a thickness of ' || (l_linenumber + 10) || ' mm; limit ' || CASE WHEN l_partkey % 10 IN (2, 3) THEN '' ELSE '1,0' || (l_suppkey % 90 + 10) || CASE WHEN l_partkey % 10 = 4 THEN ' %' ELSE ' 밀리미터' END END || ' by KR-3.' || (l_linenumber % 3) || CASE l_partkey % 10 WHEN 1 THEN ' and 7777' WHEN 3 THEN ' or 7777' WHEN 5 THEN ' as ASTM asks' WHEN 8 THEN ' and KR-9.T4'
 WHEN 9 THEN ' per ISO 6520-1 cross-section' ELSE '' END || CASE l_partkey % 10 WHEN 6 THEN ' 불 합격' WHEN 7 THEN ' 합격 불합격' ELSE ' 합격' END || '.'"""
_WHY = """CASE l_partkey % 10 WHEN 1 THEN 'extra_value' WHEN 2 THEN 'missing_value' WHEN 3 THEN 'changed_value' WHEN 4 THEN 'changed_value' WHEN 5 THEN 'extra_value' WHEN 6 THEN 'verdict_flip' WHEN 7 THEN 'format_violation' WHEN 8 THEN 'extra_value' ELSE '' END"""


def _said(spark, d):
    # The text follows from the other columns: these are made distinct, not the text.
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").distinct()
    li = li.selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", _SAY.replace("::BIGINT", "").replace("(l_quantity + 100)", "(CAST(l_quantity AS BIGINT) + 100)") + " AS said")
    return li.withColumn("text", K.plain(F.col("said")))


def _allowed():
    mm = F.lit("mm")
    size, thick, limit = F.col("l_quantity").cast("long") + F.lit("100.5").cast("decimal(20,2)"), F.col("l_linenumber") + 10, F.col("l_suppkey") % 90 + 1010
    return K.allowed_numbers([(size, mm), (thick, mm), (limit, mm)]), F.array(*[v.cast("decimal(20,2)") for v in (size, thick, limit)])


@query(f"SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, l_quantity, {_WHY} AS reasons FROM lineitem")
def numeric_locks(spark, d):
    """Why a text does not say what its numbers, clause, standards and verdict must be."""
    rows, (allowed, required) = _said(spark, d), _allowed()
    clause = F.concat(F.lit("KR-3."), (F.col("l_linenumber") % 3).cast("string"))
    rows, scanned = K.with_scan(rows, "text")
    why = K.lock_reasons(F.col("text"), scanned, F.array(clause), F.array(F.lit("ISO 6520-1"), F.lit("KR")), allowed, required, F.array().cast("array<string>"), F.lit("PASS"))
    return rows.select("id", "l_partkey", "l_suppkey", "l_quantity", F.array_join(why, "+").alias("reasons"))


@query("""SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_partkey, CASE l_partkey % 8 WHEN 1 THEN 'defect_hallucination' WHEN 2 THEN 'extra_value' WHEN 3 THEN 'extra_value' WHEN 4 THEN 'changed_value' WHEN 5 THEN 'verdict_flip' WHEN 6 THEN 'defect_hallucination+extra_value' WHEN 7 THEN 'format_violation' ELSE '' END AS reasons FROM lineitem""")
def normal_locks(spark, d):
    """The same for pictures without defects."""
    k = F.col("l_partkey") % 8
    end = F.when(k == 1, " no Pore seen").when(k == 2, " 4").when(k == 3, " by KR-2.1").when(k == 5, " 합격").when(k == 6, " code 2011").otherwise("")
    text = F.when(k == 7, F.lit("  ")).otherwise(F.concat(F.lit("Assumed "), (F.col("l_linenumber") + 10).cast("string"), F.when(k == 4, "%").otherwise(" mm"), F.lit(", level 3"), end))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_linenumber", K.plain(text).alias("text")).distinct()
    allowed = F.concat(K.allowed_numbers([(F.col("l_linenumber") + 10, F.lit("mm"))]), K.numbers_of(F.lit("level 3")))
    why = K.normal_lock_reasons(F.col("text"), K.scan(F.col("text")), ["pore", "2011"], F.array().cast("array<string>"), allowed, F.lit(None).cast("string"))
    return rows.select("id", "l_partkey", F.array_join(why, "+").alias("reasons"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'enum' WHEN 1 THEN 'trailing_zero' WHEN 2 THEN 'literal+word' ELSE '' END AS found FROM orders""")
def text_artifacts(spark, d):
    """Traces of inner forms in a text, but for those that its source has too."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "in Unit.MM only").when(k == 1, "4.00 mm").when(k == 2, "None of twelve").when(k == 3, "4.00 mm").otherwise("plain")
    basis = F.when(k == 3, "gives 4.00").otherwise("gives nothing")
    pats = {"enum": r"\b(?:Unit|Verdict)\.[A-Za-z_]+", "trailing_zero": r"(?<![\d.])\d+\.\d*0(?![\d])", "literal": r"\b(?:None|True|False)\b", "word": r"(?i)\b(?:twelve|twenty)\b"}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(K.artifacts(text, basis, pats), "+").alias("found"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey::DOUBLE WHEN 1 THEN o_custkey + 0.5 WHEN 2 THEN 1200 ELSE NULL END::DOUBLE AS value FROM orders")
def exact_decimals(spark, d):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 1, F.concat(c, F.lit(".50"))).when(k == 2, "1.2e3").when(k == 3, "NaN").when(k == 4, F.concat(c, F.lit(",5"))).otherwise("Infinity")
    return table(spark, d, "orders").select("o_orderkey", K.exact_decimal(text).cast("double").alias("value"))


_SYSTEM = "Answer only in the language asked for and cite no source twice."
_SQUEEZED = "regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')"


@query(f"""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), j AS (SELECT a.conv_id, a.turn, {_SQUEEZED.format("a.text || CASE WHEN a.conv_id % 4 = 0 THEN ' language asked  for' WHEN a.conv_id % 4 = 1 THEN ' ASSISTANT:' ELSE '' END")} AS t, {_SQUEEZED.format("b.text")} AS p, a.conv_id % 4 AS k FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1),
w AS (SELECT conv_id, turn, k, t, p, list_transform(range(1, length(t) - 10), lambda i: t[i:i + 11]) AS w12, list_transform(range(1, length(t) - 14), lambda i: t[i:i + 15]) AS w16, list_transform(range(1, length(p) - 14), lambda i: p[i:i + 15]) AS p16, {_SQUEEZED.format("'" + _SYSTEM + "'")} AS s FROM j)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN k = 1 OR contains(lower(t), 'assistant:') THEN 'instruction_leak_marker' END, CASE WHEN len(list_filter(w12, lambda x: contains(s, x))) > 0 THEN 'instruction_leak_system' END, CASE WHEN list_has_any(w16, p16) THEN 'instruction_leak_prompt' END], lambda x: x IS NOT NULL), '+') AS leaks FROM w""")
def instruction_leaks(spark, d):
    """Answers that repeat marker words, the system's text or the turn before them."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    j = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")), ["conv_id", "turn"])
    k = F.col("conv_id") % 4
    text = F.concat("text", F.when(k == 0, " language asked  for").when(k == 1, " ASSISTANT:").otherwise(""))
    return j.select("conv_id", "turn", F.array_join(K.leaks(text, _SYSTEM, F.col("prompt"), ["assistant:", "<think>"]), "+").alias("leaks"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT *, doc_id % 6 AS k FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN k = 0 THEN 'mixed_cjk' END, CASE WHEN regexp_matches(t2, '(?:^|[^\\p{L}\\p{N}_])[A-Za-z][A-Za-z''’\\-]*(?:[ \\t\\n\\x0B\\f\\r,;:]+[A-Za-z][A-Za-z''’\\-]*){5,}') THEN 'mixed_sentence' END, CASE WHEN n = 0 OR h < 0.6 * n THEN 'low_share' END], lambda x: x IS NOT NULL), '+') AS problems
FROM (SELECT doc_id, k, t2, length(regexp_replace(t2, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(t2, '[^가-힣A-Za-z\\x{4E00}-\\x{9FFF}]', '', 'g')) AS n FROM (SELECT doc_id, k, t || CASE WHEN k = 0 THEN ' 漢字' WHEN k < 3 THEN repeat('가나다', length(t)::INT + 1) ELSE '' END AS t2 FROM l))""")
def mixed_languages(spark, d):
    """Texts that should be Korean and hold other scripts, an English sentence, or too little of their own."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    text = F.concat(t, F.when(k == 0, " 漢字").when(k < 3, F.repeat(F.lit("가나다"), F.length(t) + 1)).otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.mixed_language(text, "가-힣", 0.6, 6), "+").alias("problems"))


@query("""SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2, 3) AS refers, CASE o_orderkey % 6 WHEN 1 THEN 'third_party_quote' WHEN 2 THEN 'paid_numeric' WHEN 3 THEN 'paid_numeric' END AS reason FROM orders""")
def paid_sentences(spark, d):
    """Sentences that quote a paid standard, or give a number with a unit and name one."""
    k = F.col("o_orderkey") % 6
    s = F.when(k == 0, "See ISO 5817 for it.").when(k == 1, "A crack (AWS, 2010) grows.").when(k == 2, "ISO 5817 allows 3 mm here.").when(k == 3, "By clause 6.26.1 up to 1/2 in. is fine.").when(k == 4, "By clauses one may use 3 mm.").otherwise("Plain words.")
    doc = F.when(k == 3, "MANUAL").otherwise("OTHER")
    r = X.paid_reason(s, doc)
    return table(spark, d, "orders").select("o_orderkey", X.paid_reference(s, doc).alias("refers"), r.alias("reason"))


@query("""
WITH s AS (SELECT o_orderkey, unnest(['First one here.', 'Second ' || o_custkey || ' here.', 'Third.']) AS s, unnest([1, 1, CASE WHEN o_custkey >= 100 THEN 2 ELSE 2 END]) AS a, unnest([1, 2, 2]) AS b, unnest([0, 1, 2]) AS i FROM orders) SELECT o_orderkey, i::INT AS i, s AS sentence, a::INT AS first_page, b::INT AS last_page FROM s""")
def sentence_pages(spark, d):
    """Each sentence with the pages of its first and last character."""
    text = F.concat(F.lit("First one here. Second "), F.col("o_custkey").cast("string"), F.lit(" here. Third."))
    marks = F.array(F.struct(F.lit(0).alias("offset"), F.lit(1).alias("page")), F.struct(F.lit(22).alias("offset"), F.lit(2).alias("page")))
    each = table(spark, d, "orders").select("o_orderkey", F.posexplode(X.sentence_pages(text, marks)).alias("i", "p"))
    return each.select("o_orderkey", "i", "p.sentence", F.col("p.first").alias("first_page"), F.col("p.last").alias("last_page"))


@query("SELECT o_orderkey, 'a' || CASE WHEN o_orderkey % 3 = 0 THEN '°' ELSE '□' END || 'soft' || repeat('≥', (o_orderkey % 4)::INT) || chr(233) AS text, (o_orderkey % 3 = 0)::INT + (o_orderkey % 4)::INT AS mapped, (o_orderkey % 3 > 0)::INT AS unmapped, 1 AS joined FROM orders")
def cleaned_characters(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("a"), F.when(k % 3 == 0, "").otherwise(""), F.lit("so￾ft"), F.repeat(F.lit(""), (k % 4).cast("int")), F.lit("é"))
    return table(spark, d, "orders").select("o_orderkey", X.clean_characters(text, {"": "°", "": "≥", "": "×"}).alias("c")).select("o_orderkey", "c.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'One ' || o_custkey || ' two' ELSE 'T One' END AS body FROM orders")
def xml_bodies(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    xml = F.when(k % 2 == 0, F.concat(F.lit("<article><front>no</front><body><p>One <b>"), c, F.lit("</b></p>\n<p>two</p></body></article>"))).otherwise("<article><t>T</t><p> One</p></article>")
    return table(spark, d, "orders").select("o_orderkey", X.xml_body(xml).alias("body"))


@query("""
WITH f AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\\bcrack|pore') AS a, regexp_matches(coalesce(text, ''), '(?i)inspect|quality') AS b, regexp_matches(coalesce(text, ''), '(?i)weld|the') AS c FROM documents) SELECT doc_id, CASE WHEN a THEN 'specific' WHEN b THEN 'quality' WHEN c THEN 'general' END AS tier FROM f""")
def text_tiers(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tier(F.col("text"), [("specific", r"(?i)\bcrack|pore"), ("quality", "(?i)inspect|quality"), ("general", "(?i)weld|the")]).alias("tier"))


@query("""SELECT o_orderkey, list_sort(list_distinct([o_custkey::DECIMAL(28,10), 1200, 2, 7]::DECIMAL(28,10)[]))::VARCHAR AS numbers FROM orders""".replace("::VARCHAR AS numbers", " AS numbers0").replace("SELECT o_orderkey, ", "SELECT o_orderkey, array_to_string(list_transform(").replace(" AS numbers0", ", lambda x: x::DOUBLE::VARCHAR), ',') AS numbers"))
def traceable_numbers(spark, d):
    """The numbers that a text may give: those of its target and passages, and how many defects are locked."""
    c = F.col("o_custkey").cast("string")
    n = X.allowed_numbers([F.concat(F.lit("size "), c), F.lit("to 1,200 of C9")], [F.lit("page text 7 and " + "a1" * 32)], F.array(F.lit(1), F.lit(1)))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(n, lambda x: x.cast("double").cast("string")), ",").alias("numbers"))
