"""Rule tables looked up by equal keys, wildcards and half-open intervals; gold clauses, roles, retrieval and verdicts from them.

rules: (rule_id, active, canonical, code, material, method, scheme, level, limit_type, lo, hi, clause); ALL in material or method takes
any; a null hi is open.  queries: (qid, code, material, method, scheme, level, t).  A lookup never falls back: none and several are states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars as S

EVERY = "ALL"


def applicable(queries: DataFrame, rules: DataFrame, limit_type: str | None = None, by_clause: bool = False) -> DataFrame:
    """(qid, rule_id, clause): all active canonical rules that apply to a query; ``by_clause``: of the query's own column ``clause`` only.

    ALL rules are met by an equi-join too: a query asks for its own material and method and for ALL.
    """
    r = rules.where("active and canonical")
    if limit_type is not None:
        r = r.where(F.col("limit_type") == limit_type)
    both = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit(EVERY))))
    q = queries.withColumn("_material", both("material")).withColumn("_method", both("method"))
    keys = ["code", "scheme", "level"] + (["clause"] if by_clause else [])
    q = q.select("qid", "t", *keys, "_material", "_method").alias("q")
    same = (F.col("q._material") == F.col("r.material")) & (F.col("q._method") == F.col("r.method"))
    for k in keys:
        same &= F.col(f"q.{k}") == F.col(f"r.{k}")
    met = q.join(r.alias("r"), same & (F.col("q.t") >= F.col("r.lo")) & (F.col("r.hi").isNull() | (F.col("q.t") < F.col("r.hi"))))
    return met.select("qid", "rule_id", F.col("r.clause").alias("clause"))


def one_rule(queries: DataFrame, rules: DataFrame, limit_type: str | None = None, by_clause: bool = False) -> DataFrame:
    """(qid, rule_id, state): the only rule that applies, else none or multiple.  A query for ALL methods is an error."""
    checked = queries.where(F.assert_true(F.col("method") != EVERY, "a query must name a method").isNull())
    n = applicable(checked, rules, limit_type, by_clause).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("r"))
    out = checked.select("qid").join(n, "qid", "left")
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "multiple").otherwise("ok")
    return out.select("qid", F.when(F.col("n") == 1, F.col("r")).alias("rule_id"), state.alias("state"))


def one_clause(queries: DataFrame, rules: DataFrame, limit_type: str | None = None) -> DataFrame:
    """(qid, clause, state): the only clause of the rules that apply (several rules of one clause are fine), else none or multiple.

    A qid occurs once.  Queries that ask the same are looked up once, against rules that say the same once.
    """
    asked = ["code", "material", "method", "scheme", "level", "t"]
    said = rules.where("active and canonical").select("active", "canonical", "code", "material", "method", "scheme", "level", "limit_type", "lo", "hi", "clause").distinct().withColumn("rule_id", F.lit(None).cast("long"))
    contexts = queries.select(asked).distinct().withColumn("qid", F.struct(*asked))
    n = applicable(contexts, said, limit_type).groupBy("qid").agg(F.count_distinct("clause").alias("n"), F.min("clause").alias("c"))
    # Where something asked is null no rule applies: such queries find none here either.
    out = queries.join(n.select("qid.*", "n", "c"), asked, "left")
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "multiple").otherwise("ok")
    return out.select("qid", F.when(F.col("n") == 1, F.col("c")).alias("clause"), state.alias("state"))


def rules_of_clause(rules: DataFrame, clause: str) -> DataFrame:
    """The active canonical rules of a clause in the order of their ids."""
    return rules.where(F.col("clause") == clause).orderBy("rule_id")


def gold_pairs(contexts: DataFrame, codes: DataFrame, rules: DataFrame) -> DataFrame:
    """(unit, code, clause, state): the clause of each distinct (unit, code), failures kept with their state.

    contexts: (unit, material, method, scheme, level, t); codes: (unit, code).
    """
    q = codes.select("unit", "code").distinct().join(contexts, "unit").withColumn("qid", F.struct("unit", "code"))
    return one_clause(q, rules).select("qid.unit", "qid.code", "clause", "state")


def gold_clauses(rules: DataFrame) -> DataFrame:
    """One row for each key of the active canonical rules with its clause; a key with two clauses is an error."""
    keys = ["code", "material", "method", "lo", "hi", "scheme", "level", "limit_type"]
    g = rules.where("active and canonical").groupBy(*keys).agg(F.min("clause").alias("clause"), F.max("clause").alias("_c"), F.min("rule_id").alias("rule_id"))
    return g.where(F.assert_true(F.col("clause") == F.col("_c"), "two clauses of one key").isNull()).drop("_c")


def gold_conflicts(rules: DataFrame) -> DataFrame:
    """The keys for which ``gold_clauses`` would stop, with their clauses joined by ;."""
    keys = ["code", "material", "method", "lo", "hi", "scheme", "level", "limit_type"]
    g = rules.where("active and canonical").groupBy(*keys).agg(F.array_sort(F.collect_set("clause")).alias("c"))
    return g.where(F.size("c") > 1).withColumn("clauses", F.array_join("c", ";")).drop("c")


def clause_roles(rules: DataFrame, method: str, materials: list[str], kind: str) -> DataFrame:
    """(material, code, main, auxiliary, state): the clause of a code and those of the classes that its condition tokens ``kind:class`` name.

    rules has also ``class`` and ``conditions`` (array).  state: ok, none (no rule), mains (several main clauses), self (the main one is
    auxiliary too).  auxiliary: sorted, joined by ;.
    """
    r = rules.where(F.col("active") & F.col("canonical") & F.col("method").isin(method, EVERY))
    codes = r.select("code").distinct()
    grid = codes.withColumn("m", F.explode(F.array(*[F.lit(m) for m in materials])))
    mine = r.withColumn("m", F.explode(F.when(F.col("material") == EVERY, F.array(*[F.lit(m) for m in materials])).otherwise(F.array("material"))))
    main = mine.groupBy("m", "code").agg(F.array_sort(F.collect_set("clause")).alias("mains"))
    wanted = mine.select("m", "code", F.explode("conditions").alias("token")).where(F.split_part("token", F.lit(":"), F.lit(1)) == kind)
    wanted = wanted.select("m", "code", F.split_part("token", F.lit(":"), F.lit(2)).alias("class")).distinct()
    aux = wanted.join(mine.select("m", "class", F.col("clause").alias("a")).distinct(), ["m", "class"]).groupBy("m", "code").agg(F.array_sort(F.collect_set("a")).alias("aux"))
    out = grid.join(main, ["m", "code"], "left").join(aux, ["m", "code"], "left").withColumn("aux", F.coalesce("aux", F.array().cast("array<string>")))
    state = F.when(F.col("mains").isNull(), "none").when(F.size("mains") > 1, "mains").when(F.array_contains("aux", F.get("mains", F.lit(0))), "self").otherwise("ok")
    return out.select(F.col("m").alias("material"), "code", F.when(F.size("mains") == 1, F.get("mains", F.lit(0))).alias("main"), F.array_join("aux", ";").alias("auxiliary"), state.alias("state"))


def level_matches(scheme: Column, levels: Column, asked_scheme: Column, asked: Column, grades: dict[str, dict[str, list[str]]], base: str) -> Column:
    """Whether a chunk's levels take the level asked for.

    Another scheme than the chunk's is taken only through ``grades`` (scheme, level of ``base``: levels) and only from ``base``.
    Else: a chunk without levels takes any, a query without one is taken, equal levels match, and ``grades`` of the chunk's scheme do.
    """
    none = F.array().cast("array<string>")
    flat = {f"{s}|{k}": v for s, m in grades.items() for k, v in m.items()}
    table = F.create_map(*[x for k, v in flat.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]) if v else none)]) if flat else F.create_map().cast("map<string,array<string>>")
    through = F.coalesce(F.arrays_overlap(F.coalesce(F.element_at(table, F.concat_ws("|", scheme, asked)), none), levels), F.lit(False)) & scheme.isNotNull()
    other = scheme.isNotNull() & ~scheme.eqNullSafe(asked_scheme)
    foreign = asked_scheme.eqNullSafe(F.lit(base)) & asked.isNotNull() & through
    own = (F.size(levels) == 0) | asked.isNull() | F.coalesce(F.array_contains(levels, asked), F.lit(False)) | through
    return F.when(other, foreign).otherwise(own)


def chunk_matches(queries: DataFrame, chunks: DataFrame, grades: dict[str, dict[str, list[str]]], base: str) -> DataFrame:
    """(qid, chunk_id): chunks (chunk_id, codes, methods, materials, scheme, levels, lo, hi) that answer a query
    (qid, code, method, material, scheme, level, t).  A chunk without codes answers none; the join is on the code."""
    c = chunks.select("*", F.explode(F.array_distinct("codes")).alias("_code")).alias("c")
    q = queries.alias("q")
    has = lambda a, x: (F.size(a) == 0) | F.coalesce(F.array_contains(a, x), F.lit(False)) | F.array_contains(a, EVERY)
    ok = has(F.col("c.methods"), F.col("q.method")) & has(F.col("c.materials"), F.col("q.material")) & S.within(F.col("q.t"), F.col("c.lo"), F.col("c.hi"))
    ok &= level_matches(F.col("c.scheme"), F.col("c.levels"), F.col("q.scheme"), F.col("q.level"), grades, base)
    return q.join(c, (F.col("q.code") == F.col("c._code")) & ok).select("q.qid", "c.chunk_id").distinct()


def ranked_chunks(queries: DataFrame, matches: DataFrame, scores: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(qid, chunk_ids, n, reason): NO_CLAUSE, the one chunk (DIRECT), or the ``most`` best by score (qid, chunk_id, score), then by id.

    Only ``most`` of a query's chunks are ever gathered.
    """
    m = matches.withColumn("score", F.lit(0.0)) if scores is None else matches.join(scores, ["qid", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))
    n = m.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    top = m.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_id"))).where(F.col("_r") <= most)
    ids = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    out = queries.select("qid").join(n, "qid", "left").join(ids, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("n") == 0, "NO_CLAUSE").when(F.col("n") == 1, "DIRECT").otherwise("RANKED")
    return out.select("qid", F.coalesce("ids", F.array().cast("array<string>")).alias("chunk_ids"), "n", reason.alias("reason"))


def pick_best(trials: DataFrame, name: str, score: str, preferred: str) -> DataFrame:
    """One row: the name of the highest score; of ties ``preferred`` if it is among them, else the least."""
    top = trials.agg(F.max(score).alias("_m"))
    best = trials.crossJoin(F.broadcast(top)).where(F.col(score) == F.col("_m"))  # one row
    return best.agg(F.when(F.bool_or(F.col(name) == preferred), F.lit(preferred)).otherwise(F.min(name)).alias(name), F.max(score).alias(score))


def consistency(verdicts: DataFrame, measures: DataFrame) -> DataFrame:
    """(unit, state): a predicted verdict against the one recomputed from the cited rules.

    verdicts: (unit, predicted).  measures: (unit, cited, gold, row_found, row_method, method, measured, limit, op, rule).  In order:
    no_citation, no_rule, wrong_method, no_measure, undecidable (a measure the rule cannot judge); then evaded, ok, wrong_clause or
    wrong_comparison.  A unit without measures passes.
    """
    m = measures
    other = F.col("row_method").isNotNull() & F.col("method").isNotNull() & ~F.col("row_method").isin(EVERY) & (F.col("row_method") != F.col("method"))
    nothing = F.col("rule") == "none_permitted"
    bad = F.when(nothing, F.col("measured") <= 0).otherwise((F.col("measured") < 0) | F.col("limit").isNull())
    fail = nothing | (S.verdict(F.col("measured"), F.col("limit"), F.col("op"), F.col("rule")) == "FAIL")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    t = m.groupBy("unit").agg(
        any_(F.col("cited").isNull()).alias("a"), any_(~F.col("row_found")).alias("b"), any_(other).alias("c"), any_(F.col("measured").isNull()).alias("d"), any_(bad).alias("e"), any_(fail).alias("f"),
        any_(F.col("gold").isNotNull() & ~F.col("cited").eqNullSafe(F.col("gold"))).alias("g"),
    )
    j = verdicts.join(t, "unit", "left")
    now = F.when(F.coalesce("f", F.lit(False)), "FAIL").otherwise("PASS")
    state = (
        F.when(F.col("a"), "no_citation").when(F.col("b"), "no_rule").when(F.col("c"), "wrong_method").when(F.col("d"), "no_measure").when(F.col("e"), "undecidable")
        .when(F.col("predicted") == "UNDECIDABLE", "evaded").when(F.col("predicted") == now, "ok").when(F.coalesce("g", F.lit(False)), "wrong_clause").otherwise("wrong_comparison")
    )
    return j.select("unit", state.alias("state"))


def weighted_citations(cited: DataFrame, gold: DataFrame, index: DataFrame, weights: DataFrame, unit: str = "unit") -> DataFrame:
    """One row: citation counts in which each pair and citation counts its unit's weight; a unit without weight is an error."""
    def weigh(df: DataFrame) -> DataFrame:
        w = F.coalesce("weight", F.raise_error(F.lit("a unit without weight")).cast("double"))
        return df.join(weights, unit, "left").withColumn("weight", w)
    allowed = gold.select(unit, "clause").distinct().withColumn("ok", F.lit(True))
    known = index.select("clause").distinct().withColumn("known", F.lit(True))
    c = weigh(cited.select(unit, "clause")).join(allowed, [unit, "clause"], "left").join(known, "clause", "left")
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0.0))
    ok, is_known = F.col("ok").isNotNull(), F.col("known").isNotNull()
    a = c.agg(s(F.lit(True)).alias("cited"), s(ok).alias("correct"), s(is_known & ~ok).alias("irrelevant"), s(~is_known).alias("nonexistent"))
    g = weigh(gold.select(unit, "code", "clause")).join(cited.select(unit, "clause").distinct().withColumn("hit", F.lit(True)), [unit, "clause"], "left")
    return a.crossJoin(g.agg(s(F.lit(True)).alias("pairs"), s(F.col("hit").isNotNull()).alias("matched")))  # one row each


def levels_out_of_order(rules: DataFrame, order: list[str], limit_at: Column, keys: list[str], step: str = "0.01") -> DataFrame:
    """(strict, lenient, t, strict_limit, lenient_limit): where a stricter level permits more than a more lenient one.

    rules: (rule_id, level, lo, hi, cap, factor, ...) with decimals; ``limit_at`` is an expression over its columns and ``t``.  Two rules of
    equal ``keys`` whose intervals overlap are compared at both ends of the overlap and where a capped rule turns flat (cap / factor).
    """
    place = F.coalesce(*[F.when(F.col("level") == x, F.lit(i)) for i, x in enumerate(order)])
    r = rules.withColumn("_i", place).where("_i is not null").withColumn("_turn", F.when(F.col("factor") > 0, F.round(F.col("cap") / F.col("factor"), 2)))
    names = [*rules.columns, "_i", "_turn"]
    side = lambda s: r.select(*[F.col(c).alias(f"{s}_{c}") for c in names])
    same = F.col("a__i") < F.col("b__i")
    for k in keys:
        same &= F.col(f"a_{k}") == F.col(f"b_{k}")
    meet = (F.col("a_hi").isNull() | (F.col("b_lo") < F.col("a_hi"))) & (F.col("b_hi").isNull() | (F.col("a_lo") < F.col("b_hi")))
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    last = hi - F.lit(step).cast("decimal(10,2)")
    turn = lambda c: F.when((F.col(c) >= lo) & (hi.isNull() | (F.col(c) < hi)), F.col(c))
    kind = "decimal(18,2)"
    points = F.array_distinct(F.array_compact(F.array(lo.cast(kind), F.when(last >= lo, last).cast(kind), turn("a__turn").cast(kind), turn("b__turn").cast(kind))))
    met = side("a").join(side("b"), same & meet).withColumn("t", F.explode(points))
    at = met.select("t", *[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in rules.columns], F.col("t")).alias(s) for s in ("a", "b")])
    limits = at.select("t", F.explode(F.array(F.struct(F.lit(0).alias("k"), "a", "b"), F.struct(F.lit(1).alias("k"), F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    one = limits.select("x.k", F.when(F.col("x.k") == 0, F.col("x.a.rule_id")).otherwise(F.col("x.b.rule_id")).alias("strict"), F.when(F.col("x.k") == 0, F.col("x.b.rule_id")).otherwise(F.col("x.a.rule_id")).alias("lenient"), "x.a.*")
    v = one.withColumn("_limit", limit_at).groupBy("strict", "lenient", "t").agg(F.max(F.when(F.col("k") == 0, F.col("_limit"))).alias("strict_limit"), F.max(F.when(F.col("k") == 1, F.col("_limit"))).alias("lenient_limit"))
    return v.where("strict_limit > lenient_limit")


def resolved_conflicts(pairs: DataFrame) -> DataFrame:
    """Conflicting pairs (a, b, a_canonical, b_canonical) with a state: resolved by the only canonical one, both_canonical or unresolved."""
    x, y = F.col("a_canonical"), F.col("b_canonical")
    return pairs.withColumn("state", F.when(x & y, "both_canonical").when(x | y, "resolved").otherwise("unresolved"))


def infeasible(rules: DataFrame, limit_low: Column, limit_high: Column, percent: Column, least: str = "0.1") -> DataFrame:
    """``rules`` (rule_id, rule, basis) that cannot be sampled, with a reason each: basis (its basis is not in the data), too_small
    (the limit at the least thickness is below ``least``), no_room (in percent, 1.1 times the limit reaches 100)."""
    ok = F.col("rule") != "none_permitted"
    basis = F.col("basis") == "a"
    found = F.array_compact(F.array(
        F.when(ok & basis, "basis"), F.when(ok & ~basis & (limit_low < F.lit(least).cast("decimal(10,2)")), "too_small"),
        F.when(ok & ~basis & percent & (F.lit("1.1").cast("decimal(10,1)") * limit_high >= 100), "no_room"),
    ))
    return rules.select("rule_id", F.explode(found).alias("reason"))


def token_faults(rules: DataFrame, kinds: list[str]) -> DataFrame:
    """(check, key): rules (rule_id, material, method, code, class, clause, conditions) whose pair tokens ``kind:class`` are not in order.

    classes: a (material, method, code) with several classes.  all: a token on a rule for ALL.  no_mate: no rule of the named class under the
    same material and method.  one_sided: a mate (its rule is the key) without the token back.  clause: rules of a clause that differ.
    """
    out = lambda df, name, key: df.select(F.lit(name).alias("check"), key.cast("string").alias("key")).distinct()
    several = rules.where("class is not null").groupBy("material", "method", "code").agg(F.count_distinct("class").alias("n")).where("n > 1")
    tokens = rules.select("rule_id", "material", "method", "class", F.explode("conditions").alias("token")).withColumn("kind", F.split_part("token", F.lit(":"), F.lit(1))).where(F.col("kind").isin(kinds))
    tokens = tokens.withColumn("mate", F.split_part("token", F.lit(":"), F.lit(2)))
    wild = F.col("material").isin(EVERY) | F.col("method").isin(EVERY)
    plain = tokens.where(~wild).alias("t")
    mates = rules.select("rule_id", "material", "method", "class", "conditions").alias("m")
    met = plain.join(mates, (F.col("t.material") == F.col("m.material")) & (F.col("t.method") == F.col("m.method")) & (F.col("t.mate") == F.col("m.class")), "left")
    lonely = met.where(F.col("m.rule_id").isNull())
    back = F.array_contains(F.col("m.conditions"), F.concat(F.col("t.kind"), F.lit(":"), F.col("t.class")))
    one = met.where(F.col("m.rule_id").isNotNull() & ~F.coalesce(back, F.lit(False)))
    mixed = rules.groupBy("clause").agg(F.count_distinct(F.struct(F.coalesce("class", F.lit("")), F.array_join("conditions", "|"))).alias("n")).where("n > 1")
    return (
        out(several, "classes", F.concat_ws("/", "material", "method", "code")).union(out(tokens.where(wild), "all", F.col("rule_id"))).union(out(lonely, "no_mate", F.col("t.rule_id")))
        .union(out(one, "one_sided", F.col("m.rule_id"))).union(out(mixed, "clause", F.col("clause")))
    )
