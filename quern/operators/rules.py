"""Rule tables: duplicate, conflicting and unordered rules, chunk retrieval, and the allocation of examples to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scalars as S

# Strata of a rule's examples in order, and their shares in percent.
PASS, FAIL, LOW, EQUAL, HIGH = "pass", "fail", "boundary_low", "boundary_eq", "boundary_high"
SHARES = {PASS: 40, FAIL: 40, LOW: 8, EQUAL: 4, HIGH: 8}


def repeated_keys(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys that more than one row has, how many, and the first row's ``order``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Half-open intervals that share a point; a null upper bound is infinite."""
    return F.coalesce(a_lo < b_hi, b_hi.isNull() & a_lo.isNotNull()) & F.coalesce(b_lo < a_hi, a_hi.isNull() & b_lo.isNotNull())


def conflicts(rules: DataFrame, keys: list[str], doc: str, limit: str) -> DataFrame:
    """Pairs (a, b), a < b, of rules (rule_id, keys, lo, hi) of different documents that overlap and differ in their limit."""
    a, b = rules.alias("a"), rules.alias("b")
    same = F.col("a.rule_id") < F.col("b.rule_id")
    for k in keys:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    same &= (F.col(f"a.{doc}") != F.col(f"b.{doc}")) & (F.col(f"a.{limit}") != F.col(f"b.{limit}"))
    return a.join(b, same & overlaps(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))).select(F.col("a.rule_id").alias("a"), F.col("b.rule_id").alias("b"))


def unordered_levels(rules: DataFrame, keys: list[str], level: str, limit: str) -> DataFrame:
    """Rules whose limit is above that of the next laxer level (higher ``level``: stricter) of the same keys."""
    before = F.lag(limit).over(W.partitionBy(*keys).orderBy(level))
    return rules.withColumn("laxer", before).where(F.col(limit) > F.col("laxer"))


def one_sided(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose reverse is missing."""
    return pairs.select(a, b).distinct().join(pairs.select(F.col(b).alias(a), F.col(a).alias(b)), [a, b], "left_anti")


def chunk_meta(rules: DataFrame, clause: str, sets: list[str], lo: str, hi: str, scope: str) -> DataFrame:
    """Per clause sorted distinct values, least lower and greatest upper bound (null if any is null), scope or 'mixed'."""
    whole = lambda c, f: F.when(F.count(c) == F.count(F.lit(1)), f(c)).alias(c)
    return rules.groupBy(clause).agg(
        *[F.array_sort(F.collect_set(c)).alias(c) for c in sets], whole(lo, F.min), whole(hi, F.max), F.when(F.count_distinct(scope) == 1, F.min(scope)).otherwise("mixed").alias(scope)
    )


def retrieve(queries: DataFrame, chunks: DataFrame, code: str, value: str, top: int = 3) -> DataFrame:
    """Per query (qid) its chunks with the code whose [lo, hi) holds the value: the first ``top`` ids, how many, and the reason.

    reason: NO_CLAUSE, DIRECT for one, else RANKED.  Chunks without codes never match; a code has as many chunks as the rule table has clauses for it.
    """
    each = chunks.where(F.size("codes") > 0).select("chunk_id", "lo", "hi", F.explode(F.array_distinct("codes")).alias(code))
    joined = queries.join(each, code, "left")
    hit = F.col("chunk_id").isNotNull() & S.within(F.col(value), F.col("lo"), F.col("hi"))
    ids = F.array_sort(F.collect_set(F.when(hit, F.col("chunk_id"))))
    out = joined.groupBy("qid").agg(ids.alias("ids"))
    n = F.size("ids")
    return out.select("qid", F.slice("ids", 1, top).alias("chunk_ids"), n.alias("n"), F.when(n == 0, "NO_CLAUSE").when(n == 1, "DIRECT").otherwise("RANKED").alias("reason"))


def round_robin(combos: DataFrame, order: list[str], total: int, cap: int) -> DataFrame:
    """Adds n: an equal share of ``total``, at most ``cap``, the rest one each to the first in order.  One row for each rule."""
    all_ = W.partitionBy()
    size, place = F.count(F.lit(1)).over(all_), F.row_number().over(W.orderBy(*order))
    got = combos.withColumn("_size", size).withColumn("_place", place)
    eff = F.least(F.lit(total), F.col("_size") * cap)
    base = F.floor(eff / F.col("_size"))
    extra = F.when(F.col("_place") <= eff - base * F.col("_size"), 1).otherwise(0)
    return got.withColumn("n", (base + extra).cast("long")).drop("_size", "_place")


def decompose(n: Column, permits: Column) -> Column:
    """How many of n examples go to each stratum, as an array in the order of SHARES.

    A rule that permits nothing has failures only; below 3 the boundaries come first (equal, high, low); else shares by largest
    remainder, and then each boundary gets at least one, taken from the largest stratum that can spare one.
    """
    names, shares = list(SHARES), list(SHARES.values())
    number = lambda v: F.lit(v).cast("long")
    floors = F.array(*[F.floor(n * s / 100).cast("long") for s in shares])
    rest = n - F.aggregate(floors, number(0), lambda a, x: a + x)
    order = F.array_sort(F.array(*[F.struct((-F.pmod(n * s, F.lit(100))).alias("f"), F.lit(i).alias("i")) for i, s in enumerate(shares)]))
    raised = F.transform(floors, lambda x, i: x + F.when(F.exists(F.slice(order, F.lit(1), rest.cast("int")), lambda o: o["i"] == i), 1).otherwise(0))
    edge = [i for i, s in enumerate(names) if s not in (PASS, FAIL)]

    def lend(acc: Column, t: int) -> Column:
        spare = F.transform(acc, lambda x, i: F.when((i != t) & (x > F.when(i.isin(*edge), 1).otherwise(0)), F.struct(x.alias("x"), (-i).alias("i"))))
        donor = -F.array_max(spare)["i"]
        moved = F.transform(acc, lambda x, i: x - F.when(i == donor, 1).otherwise(0) + F.when(i == t, 1).otherwise(0))
        return F.when(F.get(acc, F.lit(t)) >= 1, acc).otherwise(moved)

    targets = F.array(*[F.lit(names.index(s)) for s in (EQUAL, LOW, HIGH)])
    full = F.aggregate(targets, raised, lambda acc, t: lend(acc, t))
    few = F.array(*[number(0), number(0), number(0), F.when(n >= 1, number(1)).otherwise(number(0)), F.when(n >= 2, number(1)).otherwise(number(0))])
    none = F.array(number(0), n.cast("long"), number(0), number(0), number(0))
    return F.when(~permits, none).when(n < 3, few).otherwise(full)


def bucket(limit: Column, name: Column) -> Column:
    """The interval (lo, hi), ends included, of whole hundredths around a limit given in hundredths: up to 0.9, 1, 1.1 and 2.5 times it."""
    low, high, top = F.ceil(limit * 9 / 10), F.floor(limit * 11 / 10), F.floor(limit * 5 / 2)
    lo = F.when(name == PASS, F.lit(1)).when(name == LOW, low).when(name == EQUAL, limit).when(name == HIGH, limit + 1).when(name == FAIL, high + 1)
    hi = F.when(name == PASS, low - 1).when(name == LOW, limit - 1).when(name == EQUAL, limit).when(name == HIGH, high).when(name == FAIL, top)
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
