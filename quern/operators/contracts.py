"""Row contracts: what rows of generated pairs, questions, passages and training sets must be; every reason is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.functions.generated import normal_form
from quern.operators.checks import reasons, repeated, several, violations
from quern.operators.graph import cut

NO_LABEL = -100


def assembled(skeletons: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """(unit, n, verdict, cited, verdict_type, level, sample_id): one row for each unit, also without skeletons (which passes).

    skeletons: (unit, image_id, verdict, clause, conditional, level).  A skeleton of another image, or without a verdict, is an error.
    cited: sorted distinct clauses joined by ;.  level: the only one, else null.
    """
    other = F.assert_true(F.coalesce(F.col("image_id") == F.col(unit), F.lit(True)), "a skeleton of another image").isNull()
    ok = other & F.assert_true(F.col("verdict").isNotNull(), "a skeleton without a verdict").isNull()
    g = skeletons.where(ok).groupBy(unit).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("verdict") == "FAIL").alias("_f"), F.array_join(F.array_sort(F.collect_set("clause")), ";").alias("cited"), F.bool_or("conditional").alias("_c"),
        F.when(F.count_distinct("level") == 1, F.min("level")).alias("level"),
    )
    out = units.select(unit).join(g, unit, "left")
    some = F.col("n").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        unit, F.coalesce("n", F.lit(0)).alias("n"), F.when(yes(F.col("_f")), "FAIL").otherwise("PASS").alias("verdict"), F.coalesce("cited", F.lit("")).alias("cited"),
        F.when(yes(F.col("_c")), "conditional").otherwise("confirmed").alias("verdict_type"), "level", F.concat(F.col(unit).cast("string"), F.when(some, "-pair").otherwise("-normal")).alias("sample_id"),
    )


# The words of rules in Korean.
UNIT_WORDS = {"mm": "mm", "percent": "%"}
OP_WORDS = {"le": "이하", "lt": "미만"}
BASIS_WORDS = {"t": "모재 두께", "s": "용접부 공칭 두께", "a": "목두께"}
NOTHING, ALL_SIZES, TIMES, AND_MOST, FROM_, OVER, BELOW, UP_TO = "크기와 무관하게 허용하지 않는다", "모든 두께", "배", "이고 최대", "이상", "초과", "미만", "이하"


def trimmed(x: Column) -> Column:
    """A number as text without zeros at its end; null is empty."""
    t = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(t.rlike(r"^-?\d+\.\d+$"), F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")).otherwise(t)


def _open(x: Column) -> Column:
    """Whether a bound stands for an open one: a whole number and one hundredth."""
    d = x.cast("decimal(18,4)")
    return F.coalesce(d - F.round(d, 0) == F.lit("0.01").cast("decimal(10,2)"), F.lit(False))


def _bound(x: Column) -> Column:
    return F.when(_open(x), trimmed(F.round(x.cast("decimal(18,4)") - F.lit("0.01").cast("decimal(10,2)"), 2))).otherwise(trimmed(x))


def thickness_text(lo: Column, hi: Column) -> Column:
    """The half-open interval [lo, hi) in words; bounds that stand for open ones are said as such."""
    left = F.when(F.coalesce(lo, F.lit(0)) == 0, "").otherwise(F.concat(_bound(lo), F.lit(" mm "), F.when(_open(lo), OVER).otherwise(FROM_)))
    right = F.concat(_bound(hi), F.lit(" mm "), F.when(_open(hi), UP_TO).otherwise(BELOW))
    return F.when(hi.isNull(), F.when(left == "", ALL_SIZES).otherwise(left)).otherwise(F.trim(F.concat_ws(" ", left, right)))


def _word(table: dict[str, str], c: Column, what: str) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(c, F.lit("null")))).cast("string"))


def criterion_text(rule: Column, value: Column, factor: Column, cap: Column, basis: Column, op: Column, unit: Column) -> Column:
    """A rule's limit in words by its kind; an unknown kind, operator or basis is an error."""
    u, o = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_WORDS.items() for x in kv]), unit), unit, F.lit("mm")), _word(OP_WORDS, op, "operator")
    share = F.concat(_word(BASIS_WORDS, basis, "basis"), F.lit("의 "), trimmed(factor), F.lit(f" {TIMES} "), o)
    return (
        F.when(rule == "none_permitted", NOTHING).when(rule == "const", F.concat(trimmed(value), F.lit(" "), u, F.lit(" "), o)).when(rule == "prop_t", share)
        .when(rule == "prop_t_cap", F.concat(share, F.lit(f"{AND_MOST} "), trimmed(cap), F.lit(" "), u)).otherwise(F.raise_error(F.concat(F.lit("unknown rule: "), F.coalesce(rule, F.lit("null")))).cast("string"))
    )


def clause_basis(rules: DataFrame, method: str, material: str) -> DataFrame:
    """(code, clause, criteria, kinds): per code the clause and, in the order of rule ids, the criteria of its active rules for a method and material.

    rules: (rule_id, active, code, material, method, clause, rule, text).  A code of two clauses is an error.  criteria: joined by " / ".
    """
    mine = rules.where(F.col("active") & F.col("method").isin(method, "ALL") & F.col("material").isin(material, "ALL"))
    g = mine.groupBy("code").agg(F.min("clause").alias("clause"), F.max("clause").alias("_c"), F.array_sort(F.collect_list(F.struct("rule_id", "text", "rule"))).alias("_a"))
    ok = F.assert_true(F.col("clause") == F.col("_c"), "a code of two clauses").isNull()
    return g.where(ok).select("code", "clause", F.array_join(F.transform("_a", lambda x: x["text"]), " / ").alias("criteria"), F.array_join(F.array_distinct(F.transform("_a", lambda x: x["rule"])), ";").alias("kinds"))


def judged(measured: Column, limit: Column, op: Column, rule: Column) -> Column:
    """struct(verdict, margin): margin is the limit less the measure; null, and FAIL, where nothing is permitted.

    A measure below 0, or not above it where nothing is permitted, is an error.
    """
    m = F.round(measured.cast("decimal(30,8)"), 2).cast("decimal(18,2)")
    ok = F.assert_true(F.coalesce(F.when(rule == "none_permitted", m > 0).otherwise(m >= 0), F.lit(False)), "a measure that cannot be judged")
    v = F.when(ok.isNull(), S.verdict(m, limit, op, rule))
    return F.struct(v.alias("verdict"), F.when(rule != "none_permitted", (limit - m).cast("decimal(18,2)")).alias("margin"))


def condition_token(token: Column, bare: list[str], pairs: list[str], classes: list[str]) -> Column:
    """struct(kind, class) of a bare token or ``kind:class``; anything else is an error."""
    kind, cls = F.split_part(token, F.lit(":"), F.lit(1)), F.substr(token, F.instr(token, ":") + 1)
    good = F.contains(token, F.lit(":")) & kind.isin(pairs) & cls.isin(classes)
    wrong = F.raise_error(F.concat(F.lit("unknown token: "), F.coalesce(token, F.lit("null")))).cast("string")
    return F.struct(F.when(token.isin(bare), token).when(good, kind).otherwise(wrong).alias("kind"), F.when(good, cls).alias("class"))


def skeleton_faults(skeletons: DataFrame, rules: DataFrame) -> DataFrame:
    """(check, key): skeletons (sample_id, rule_id, measured, limit, verdict, margin, bucket, lo, hi) that are not what their rule gives.

    rules: (rule_id, rule, op, own_limit).  rule: no such rule; limit, verdict, margin: other than recomputed; bucket: the measure is not in [lo, hi].
    """
    j = skeletons.join(rules, "rule_id", "left")
    again = j.withColumn("_j", judged(F.coalesce("measured", F.lit(1)), F.col("own_limit"), F.col("op"), F.col("rule")))
    known = again.where("rule is not null")
    at = lambda df, cond: df.where(F.coalesce(cond, F.lit(False))).select("sample_id")
    return violations({
        "rule": at(again, F.col("rule").isNull()), "limit": at(known, ~F.col("limit").eqNullSafe(F.col("own_limit"))), "verdict": at(known, ~F.col("verdict").eqNullSafe(F.col("_j.verdict"))),
        "margin": at(known, ~F.col("margin").eqNullSafe(F.col("_j.margin"))), "bucket": at(known, (F.col("measured") < F.col("lo")) | (F.col("measured") > F.col("hi"))),
    })


def rule_combos(rules: DataFrame, method: str) -> DataFrame:
    """(key, rule_id): active canonical rules for a method, without those whose basis is not in the data; a key of two rules is an error.

    rules: (rule_id, active, canonical, method, basis, code, lo, hi, scheme, level)."""
    mine = rules.where(F.col("active") & F.col("canonical") & F.col("method").isin(method, "ALL") & ~F.coalesce(F.col("basis") == "a", F.lit(False)))
    key = F.concat_ws("|", "code", F.col("lo").cast("string"), F.coalesce(F.col("hi").cast("string"), F.lit("inf")), "scheme", "level")
    g = mine.select("rule_id", key.alias("key")).groupBy("key").agg(F.min("rule_id").alias("rule_id"), F.count(F.lit(1)).alias("_n"))
    return g.where(F.assert_true(F.col("_n") == 1, "a key of two rules").isNull()).drop("_n")


def squashed(question: Column) -> Column:
    """A question to compare: compatibility normal form, small letters, no white space."""
    return F.regexp_replace(F.lower(normal_form(question, "NFKC")), r"\s+", "")


def qa_reasons(records: DataFrame, passages: DataFrame, place: str, most: int) -> DataFrame:
    """``records`` (question, answer, evidence: array) with reasons: schema_question, schema_answer, schema_evidence, evidence (a passage id
    that is not there), duplicate (an equal question has an earlier ``place``), length (question and answer beyond ``most``)."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    ids = F.coalesce("evidence", F.array().cast("array<string>"))
    good = (F.size(ids) > 0) & F.forall(ids, lambda e: F.coalesce(e != "", F.lit(False)))
    rows = records.withColumn("_q", F.when(text("question"), squashed(F.col("question"))))
    # The first of equal questions, by aggregation.
    first = rows.where("_q is not null").groupBy("_q").agg(F.min(place).alias("_first"))
    lost = rows.select(place, F.explode(ids).alias("e")).join(passages.select(F.col("passage_id").alias("e")).distinct(), "e", "left_anti").select(place).distinct().withColumn("_lost", F.lit(True))
    j = rows.join(first, "_q", "left").join(lost, place, "left")
    size = F.length(F.coalesce("question", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))
    return j.select(*records.columns, reasons({
        "schema_question": ~text("question"), "schema_answer": ~text("answer"), "schema_evidence": ~good, "evidence": good & F.col("_lost"), "duplicate": F.col(place) > F.col("_first"), "length": size > most,
    }).alias("reasons"))


def training_faults(rows: DataFrame) -> DataFrame:
    """(check, key): repeated ids and lineages that are in train and in val."""
    return violations({"id": repeated(rows, "id"), "lineage": several(rows, "lineage", F.col("split"))})


def training_rows(rows: DataFrame, scope: str, clients: list[str]) -> DataFrame:
    """The train rows of a scope: central (all), public_text (questions on sources) or one of the clients; an unknown scope is an error."""
    if scope not in ("central", "public_text", *clients):
        raise ValueError(f"unknown scope {scope}")
    own = F.lit(True) if scope == "central" else F.col("kind") == "source_qa" if scope == "public_text" else F.col("client") == scope
    return rows.where((F.col("split") == "train") & own)


def assistant_labels(ids: Column, prompt: Column, mask: Column, most: int) -> Column:
    """struct(labels, reason): ids behind the prompt, NO_LABEL elsewhere; or why there are none.

    invalid (empty, of different length, a mask of other than 0 and 1), padding (inside), long, prefix (the prompt does not begin it), empty.
    """
    n = F.size(ids)
    first = F.array_position(mask, F.lit(1)).cast("int")
    ones = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    inside = F.slice(mask, F.greatest(first, F.lit(1)), F.greatest(ones, F.lit(0)))
    sequence = F.slice(ids, F.greatest(first, F.lit(1)), F.greatest(ones, F.lit(0)))
    k = F.size(prompt)
    invalid = (n <= 0) | (n != F.size(mask)) | (k <= 0) | F.exists(mask, lambda x: ~x.isin(0, 1)) | F.exists(ids, lambda x: x.isNull()) | F.exists(prompt, lambda x: x.isNull())
    reason = (
        F.when(F.coalesce(invalid, F.lit(True)), "invalid").when((ones == 0) | F.exists(inside, lambda x: x != 1), "padding").when(ones > most, "long")
        .when(F.slice(sequence, F.lit(1), k) != prompt, "prefix").when(ones <= k, "empty")
    )
    labels = F.transform(ids, lambda x, i: F.when((i >= first - 1 + k) & (i < first - 1 + ones), x).otherwise(F.lit(NO_LABEL)))
    return F.struct(F.when(reason.isNull(), labels).alias("labels"), reason.alias("reason"))


def box_lines(images: DataFrame, defects: DataFrame, classes: DataFrame, unit: str) -> DataFrame:
    """(unit, lines, n_boxes, n_invalid): for each image the lines ``class cx cy w h`` of its valid boxes, as shares with six places, sorted.

    images: (unit, width, height); defects: (unit, defect_type, valid, x1, y1, x2, y2); classes: (defect_type, class_id).  Images without a box
    have an empty text; an unknown class is an error.
    """
    j = defects.join(images, unit).join(F.broadcast(classes), "defect_type", "left")  # a label map
    cls = F.coalesce("class_id", F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce("defect_type", F.lit("null")))).cast("int"))
    six = lambda v: S.fixed(v, 6)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    line = F.concat_ws(" ", F.when(F.col("valid"), cls).cast("string"), six((x1 + x2) / 2 / w), six((y1 + y2) / 2 / h), six((x2 - x1) / w), six((y2 - y1) / h))
    g = j.groupBy(unit).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("valid"), line))), "\n").alias("lines"), F.count_if("valid").alias("n_boxes"), F.count_if(~F.col("valid")).alias("n_invalid"))
    out = images.select(unit).join(g, unit, "left")
    return out.select(unit, F.coalesce("lines", F.lit("")).alias("lines"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"))


def axis_ratios(pairs: DataFrame, by: list[str], threshold: float | None, least: int | None) -> DataFrame:
    """(by, status, reason, n_pairs, n_unusable): whether the median ratio of centres is within ``threshold`` of 1 on both axes.

    pairs: (by, px, py, gx, gy); a gold centre of 0 is unusable.  indeterminate: nothing registered, or fewer than ``least`` pairs.
    """
    ok = (F.col("gx") != 0) & (F.col("gy") != 0)
    t = pairs.groupBy(*by).agg(F.count_if(ok).alias("n_pairs"), F.count_if(~ok).alias("n_unusable"), F.median(F.when(ok, F.col("px") / F.col("gx"))).alias("_x"), F.median(F.when(ok, F.col("py") / F.col("gy"))).alias("_y"))
    if threshold is None or least is None:
        return t.select(*by, F.lit("indeterminate").alias("status"), F.lit("not registered").alias("reason"), "n_pairs", "n_unusable")
    bad = F.concat_ws("+", F.when(F.abs(F.col("_x") - 1) > threshold, "x"), F.when(F.abs(F.col("_y") - 1) > threshold, "y"))
    few = F.col("n_pairs") < least
    return t.select(*by, F.when(few, "indeterminate").when(bad == "", "pass").otherwise("fail").alias("status"), F.when(few, "sample").otherwise(bad).alias("reason"), "n_pairs", "n_unusable")


def frame_statistics(images: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_images, ratio_x, ratio_y, slope_x, slope_y, n_pairs, pair_x, pair_y): how predicted centres follow gold ones.

    images: (by, gx, gy, px, py), mean centres of images with as many predictions as gold; ratios are medians, slopes of least squares (null
    without variance).  pairs: (by, gx, gy, px, py) of mutual best boxes, medians of ratios.
    """
    over = lambda p, g: F.median(F.when(F.col(g) != 0, F.col(p) / F.col(g)))
    slope = lambda p, g: F.when(F.var_pop(g) > 0, F.covar_pop(p, g) / F.var_pop(g))
    a = images.groupBy(*by).agg(F.count(F.lit(1)).alias("n_images"), over("px", "gx").alias("ratio_x"), over("py", "gy").alias("ratio_y"), slope("px", "gx").alias("slope_x"), slope("py", "gy").alias("slope_y"))
    b = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), over("px", "gx").alias("pair_x"), over("py", "gy").alias("pair_y"))
    return a.join(b, by, "full")


def registered_verdicts(evidence: DataFrame, intervals: DataFrame, seeds: int) -> DataFrame:
    """(model, seeds_ok, above_ok, direction, passed): whether a model beats its baseline with every registered seed and the paired difference's
    interval is above 0.

    evidence: (model, seed, score, baseline); intervals: (model, lo, hi).  Conditions are null (and passed is false) where a score, a baseline, a
    seed or an interval is missing.  direction: above, below or indeterminate.
    """
    s = evidence.groupBy("model").agg(F.count_distinct("seed").alias("n"), F.count_if(F.col("score").isNull() | F.col("baseline").isNull()).alias("lost"), F.bool_and(F.col("score") > F.col("baseline")).alias("all"))
    one = F.when((F.col("n") == seeds) & (F.col("lost") == 0), F.col("all"))
    j = s.join(intervals, "model", "left")
    direction = F.when(F.col("lo") > 0, "above").when(F.col("hi") < 0, "below").otherwise("indeterminate")
    two = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.col("lo") > 0)
    return j.select("model", one.alias("seeds_ok"), two.alias("above_ok"), direction.alias("direction"), (F.coalesce(one, F.lit(False)) & F.coalesce(two, F.lit(False))).alias("passed"))


def gate_results(gates: dict[str, DataFrame], blocking: list[str]) -> DataFrame:
    """(gate, passed, skipped, blocks): all gates, each a table of one row (passed, skipped); blocks: it is blocking, failed and was not skipped."""
    each = [df.select(F.lit(k).alias("gate"), F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("skipped", F.lit(False)).alias("skipped")) for k, df in sorted(gates.items())]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out.withColumn("blocks", F.col("gate").isin(blocking) & ~F.col("passed") & ~F.col("skipped"))


def label_scores(predictions: DataFrame, labels: DataFrame, weights: DataFrame, candidates: list[str]) -> DataFrame:
    """(candidate, n_missing, precision, recall, weighted_precision, weighted_recall, n_unweighted) of candidates' verdicts against human labels.

    predictions: (id, stratum, a boolean column for each candidate); labels: (id, ok); weights: (stratum, weight).  A row whose stratum has no weight
    counts 1 and is counted; null rates for empty denominators; four places.
    """
    j = labels.where("ok is not null").join(predictions, "id", "left").join(F.broadcast(weights), "stratum", "left")  # strata are few
    each = F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("p")) for c in candidates])
    r = j.select("ok", F.coalesce("weight", F.lit(1.0)).alias("w"), F.col("weight").isNull().alias("bare"), F.inline(each))
    has = F.col("p").isNotNull()
    s = lambda cond, w: F.sum(F.when(has & cond, w).otherwise(0.0))
    g, p, one, w = F.col("ok"), F.col("p"), F.lit(1.0), F.col("w")
    over = lambda a, b: F.round(F.when(b > 0, a / b), 4)
    return r.groupBy("candidate").agg(
        F.count_if(~has).alias("n_missing"), over(s(g & p, one), s(p, one)).alias("precision"), over(s(g & p, one), s(g, one)).alias("recall"), over(s(g & p, w), s(p, w)).alias("weighted_precision"),
        over(s(g & p, w), s(g, w)).alias("weighted_recall"), F.count_if(has & F.col("bare")).alias("n_unweighted"),
    )


def passage_shape(rights: list[str], facets: list[str], defects: list[str], modern: list[str], version: int) -> Column:
    """All faults of a passage row's shape, as names; columns as the passage bank has them."""
    hexes = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    a, b = F.col("page_start"), F.col("page_end")
    names = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda x: F.split_part(x, F.lit(":"), F.lit(1)))
    out = lambda c, known, tag: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~x.isin(known)), lambda x: F.concat(F.lit(tag + ":"), x))
    fixed = reasons({
        **{f"missing:{c}": blank(c) for c in ("passage_id", "doc_id", "edition", "source_file_sha256", "text_kind", "text_sha256", "lineage_group_id", "scope", "rights_status")},
        **{f"missing:{c}": F.col(c).isNull() for c in ("facets", "defect_classes", "flags")},
        "schema_version": ~F.col("schema_version").eqNullSafe(F.lit(version)), "locator:pdf_page": a.isNull() | b.isNull(), "locator:pdf_page_order": (a < 1) | (b < a),
        "rights_status:enum": ~F.coalesce(F.col("rights_status").isin(rights), F.lit(False)), "facet:historical_row_with_modern_facet": F.array_contains(names, "historical_only") & F.arrays_overlap("facets", F.array(*[F.lit(x) for x in modern])),
        "source_file_sha256:form": hexes("source_file_sha256"), "text_sha256:form": hexes("text_sha256"),
    })
    return F.concat(fixed, out("facets", facets, "facet"), out("defect_classes", defects, "defect"))


def passage_reasons(rows: DataFrame, pointers: DataFrame, registry: DataFrame, rights: DataFrame, reviews: DataFrame, use: str) -> DataFrame:
    """(passage_id, reasons): all reasons why a passage may not be used: from its pointer, its document's entry, the rights granted and the review.

    rows: (passage_id, doc_id, sha, text_sha, holds: array); pointers: (passage_id, text_sha, has_text); registry: (doc_id, sha, withdrawn);
    rights: (doc_id, sha, uses: array); reviews: (passage_id, text_sha, verdict).
    """
    p = pointers.select("passage_id", F.col("text_sha").alias("p_sha"), F.col("has_text").alias("p_text"), F.lit(True).alias("_p"))
    g = registry.select("doc_id", F.col("sha").alias("g_sha"), "withdrawn", F.lit(True).alias("_g"))
    r = rights.groupBy("doc_id", "sha").agg(F.flatten(F.collect_set("uses")).alias("uses"))
    v = reviews.groupBy("passage_id").agg(F.count(F.lit(1)).alias("_n"), F.min("text_sha").alias("v_sha"), F.min("verdict").alias("verdict"))
    j = rows.join(p, "passage_id", "left").join(g, "doc_id", "left").join(r, ["doc_id", "sha"], "left").join(v, "passage_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    why = reasons({
        "pointer:missing": F.col("_p").isNull(), "pointer:text": yes(F.col("p_text")), "pointer:sha": F.col("p_sha") != F.col("text_sha"), "registry:missing": F.col("_g").isNull(), "registry:sha": F.col("g_sha") != F.col("sha"),
        "registry:withdrawn": yes(F.col("withdrawn")), "rights:missing": F.col("uses").isNull(), "rights:use": F.col("uses").isNotNull() & ~yes(F.array_contains("uses", use)), "review:missing": F.col("_n").isNull(),
        "review:several": F.col("_n") > 1, "review:stale": F.col("v_sha") != F.col("text_sha"), "review:rejected": F.col("verdict") != "accepted",
    })
    holds = F.transform(F.coalesce("holds", F.array().cast("array<string>")), lambda h: F.concat(F.lit("hold:"), h))
    return j.select("passage_id", F.concat(why, holds).alias("reasons"))


def with_context(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """(id, reason) for the accepted ids whose required context is not there: context:required_missing (an id that no row has),
    context:cross_lineage, context:required_not_selectable (one that is not accepted, or drops itself); null for those that stay.

    rows: (id, lineage, needs: array); accepted: (id).  Rounds until none drops.
    """
    needs = rows.select("id", F.col("lineage").alias("l"), F.explode("needs").alias("n"))
    known = needs.join(rows.select(F.col("id").alias("n"), F.col("lineage").alias("nl")), "n", "left")
    bad = known.groupBy("id").agg(F.bool_or(F.col("nl").isNull()).alias("lost"), F.bool_or(F.col("nl") != F.col("l")).alias("cross"))
    first = accepted.select("id").distinct().join(bad, "id", "left")
    reason = F.when(F.col("lost"), "context:required_missing").when(F.col("cross"), "context:cross_lineage")
    state = cut(first.select("id", reason.alias("reason")))
    left = state.where("reason is null").count()
    while True:
        ok = state.where("reason is null").select(F.col("id").alias("n"))
        stuck = needs.join(ok, "n", "left_anti").select("id").distinct().withColumn("_x", F.lit(True))
        state = cut(state.join(stuck, "id", "left").select("id", F.when(F.col("reason").isNull() & F.col("_x"), "context:required_not_selectable").otherwise(F.col("reason")).alias("reason")))
        now = state.where("reason is null").count()
        if now == left:
            return state
        left = now


def context_closure(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, context): all ids that an id of ``starts`` needs, over any number of steps, itself left out; cycles end.  A needed id that no row has is
    an error.  rows: (id, needs: array)."""
    needs = rows.select(F.col("id").alias("at"), F.explode("needs").alias("next"))
    lost = needs.join(rows.select(F.col("id").alias("next")), "next", "left_anti")
    if bad := lost.first():
        raise ValueError(f"{bad['at']} needs {bad['next']}, which is not there")
    seen = cut(starts.select("id").distinct().join(needs, F.col("id") == F.col("at")).select("id", F.col("next").alias("context")).distinct())
    last = seen
    while not last.isEmpty():
        more = last.join(needs, F.col("context") == F.col("at")).select("id", F.col("next").alias("context")).distinct()
        last = cut(more.join(seen, ["id", "context"], "left_anti"))
        seen = cut(seen.union(last))
    return seen.where("id <> context")


def pair_faults(images: DataFrame, defects: DataFrame, modalities: list[str], materials: list[str]) -> DataFrame:
    """(check, key): input faults for which no pair at all is made: vocabularies, keys, counts, and evaluation images that share an id's group,
    path or content with others."""
    ev, rest = images.where("split = 'eval'"), images.where("split <> 'eval'")
    shared = lambda c: ev.select(c).distinct().join(rest.select(c).distinct(), c)
    n = defects.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    m = images.join(n, "image_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return violations({
        "modality": images.where(~F.coalesce(F.col("modality").isin(modalities), F.lit(False))).select("image_id"), "material": images.where(~F.coalesce(F.col("material").isin(materials), F.lit(False))).select("image_id"),
        "image key": repeated(images, "image_id"), "defect key": repeated(defects, "ann_id"), "has_defect": m.where((F.col("has_defect") != (F.col("n_defects") > 0)) | (F.col("n_defects") != F.col("_n"))).select("image_id"),
        "eval group": shared("group_id"), "eval path": shared("rel_path"), "eval content": shared("sha256"),
    })
