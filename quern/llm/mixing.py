"""Mixing sources to target weights.

Source shares of all tokens are raised to an exponent and normalised (temperature
mixing).  The exponent is bisected between 1 (proportional) and 0 (uniform) to
meet a target entropy, or to be the least that repeats no source more than
``max_epochs`` times.  The weights are realised within a token budget by block
permutations: the rows of a source fall into blocks by a keyed hash; each epoch runs through all blocks in an
order of its own; the last, partial epoch stops when the source's budget is reached.

A row has as many tokens as words, and one for its end.  Totals by source reach the driver if there are at most
``MAX_SOURCES``; of more sources the exponent is bisected by sums over their table, one for each step, and weights stay columns.
No step needs all rows of a source together: budgets are cut by
totals by block, and rows are ordered only within the one block where a budget ends.  Turns are made for each epoch and
block that is taken, so they are never more than the rows of the result, whatever the number of epochs.

Defined results: null text counts as empty; rows with null source form a source of their own; rows with null id are placed by their
text; repeated rows are taken or left together; an empty table gives an empty one.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import written

MAX_SOURCES = 100_000
STEPS = 60  # of a bisection


def temperature_weights(tokens: dict, budget: float, target_entropy: float | None = None, max_epochs: float | None = None) -> tuple[float, dict]:
    """(exponent, weight by source) by bisection; entropy in nats.

    With no target the weights are proportional.  A target beyond what exponents from 0 to 1 reach gives the nearest end.
    """
    total = math.fsum(tokens.values())

    def weights(power: float) -> dict:
        raw = {s: (n / total) ** power for s, n in tokens.items()}
        z = math.fsum(raw.values())
        return {s: x / z for s, x in raw.items()}

    def flat_enough(power: float) -> bool:
        """Whether a larger exponent may be taken: still too flat."""
        w = weights(power)
        if target_entropy is not None and -math.fsum(x * math.log(x) for x in w.values() if x) > target_entropy:
            return True
        return max_epochs is not None and max(w[s] * budget / tokens[s] for s in w) > max_epochs

    if target_entropy is None and max_epochs is None:
        return 1.0, weights(1.0)
    if not flat_enough(0.0):
        return 0.0, weights(0.0)
    power = _bisected(flat_enough)
    return power, weights(power)


def _bisected(flat: Callable[[float], bool]) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat(mid) else (lo, mid)
    return hi


def temperature_plan(totals: DataFrame, budget: int | None, target_entropy: float | None, max_epochs: float | None) -> DataFrame:
    """(source, full, rest) from a written table (source, n): whole epochs and tokens beyond, by ``temperature_weights`` over any number of sources."""
    total = int(totals.agg(F.sum("n")).first()[0])
    budget = total if budget is None else budget
    share = F.col("n") / F.lit(float(total))

    def sums(power: float) -> tuple[float, float, float]:
        """The normaliser, the sum for the entropy and the largest weight by tokens."""
        w = F.pow(share, F.lit(power))
        r = totals.agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("e"), F.max(w / F.col("n")).alias("m")).first()
        return r["z"], r["e"], r["m"]

    def flat(power: float) -> bool:
        z, e, m = sums(power)
        if target_entropy is not None and math.log(z) - e / z > target_entropy:
            return True
        return max_epochs is not None and m / z * budget > max_epochs

    power = 1.0 if target_entropy is None and max_epochs is None else _bisected(flat) if flat(0.0) else 0.0
    want = F.bround(F.pow(share, F.lit(power)) / F.lit(sums(power)[0]) * budget).cast("long")
    return totals.select("source", F.floor(want / F.col("n")).cast("int").alias("full"), (want % F.col("n")).alias("rest"))


def _place(*parts: Column | str) -> Column:
    """A keyed 60-bit place that other engines can compute too."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *parts).cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
    budget: int | None = None, target_entropy: float | None = None, max_epochs: float | None = 4.0, blocks: int = 1024, seed: int = 7,
) -> DataFrame:
    """One row for each time that a row is taken: doc_id, source, epoch (from 0), block_rank (from 1, the block's turn
    in the source's epoch), place (order inside a block), tokens, *keep.  budget: tokens in all, by default those of ``docs``.
    """
    spark = docs.sparkSession
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    ks = [f"k{i}" for i in range(len(keep))]
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = _place(F.lit(str(seed)), F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("null:"), text)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (words + 1).cast("long").alias("tokens"), place.alias("place"), *carried)
    rows = rows.select("*", F.pmod("place", F.lit(blocks)).cast("int").alias("block"))
    narrow = written(rows.select("doc_id", "source", "tokens", "place", "block"), "tokens")
    by_block = written(narrow.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")), "blocks")
    by_source = written(by_block.groupBy("source").agg(F.sum("block_tokens").alias("n")), "totals")
    n_sources = by_source.count()
    out_names = [F.col(k).alias(c) for k, c in zip(ks, keep)]
    if not n_sources:
        return rows.select("doc_id", "source", F.lit(0).alias("epoch"), F.lit(0).alias("block_rank"), "place", "tokens", *out_names)
    if n_sources > MAX_SOURCES:
        plan = temperature_plan(by_source, budget, target_entropy, max_epochs)
    else:
        totals = {r["source"]: int(r["n"]) for r in by_source.collect()}
        budget = sum(totals.values()) if budget is None else budget
        _, weight = temperature_weights(totals, budget, target_entropy, max_epochs)
        want = {s: round(weight[s] * budget) for s in totals}
        plan = F.broadcast(spark.createDataFrame([(s, want[s] // n, want[s] % n) for s, n in totals.items()], "source string, full int, rest long"))
    # (source, epoch, block): whether the block is taken whole, in part or not at all, and its turn in the epoch.
    turns = by_block.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "block", "block_tokens", "full", "rest")
    turns = turns.select("*", F.explode(F.sequence(F.lit(0), "full")).alias("epoch"))
    # The order of blocks is the source's own in each epoch; a source has at most `blocks` of them.
    order = W.partitionBy("source", "epoch").orderBy(_place(F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("epoch").cast("string"), F.col("block").cast("string")), "block")
    turns = turns.select("*", F.row_number().over(order).alias("block_rank"), F.sum("block_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    room = F.col("rest") - (F.col("upto") - F.col("block_tokens"))
    turns = turns.select("source", "block", "epoch", "block_rank", F.when(F.col("epoch") < F.col("full"), F.col("block_tokens")).otherwise(room).alias("room"), "block_tokens").where("room > 0")
    turns = written(turns, "turns")
    cut = turns.where("room < block_tokens").select("source", "block", "room").withColumnRenamed("room", "limit")
    # In the block where a source's budget ends, the rows whose place is below the first that does not fit.
    inside = narrow.alias("n").join(cut.alias("c"), F.col("n.source").eqNullSafe(F.col("c.source")) & (F.col("n.block") == F.col("c.block")))
    run = W.partitionBy("n.source", "n.block").orderBy("place").rangeBetween(W.unboundedPreceding, 0)
    inside = inside.select("n.source", "n.block", "place", "limit", F.sum("tokens").over(run).alias("upto"))
    bound = inside.groupBy("source", "block").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("limit"), F.col("place"))), F.lit(1 << 62)).alias("below"))
    turns = turns.alias("t").join(bound.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")) & (F.col("t.block") == F.col("b.block")) & (F.col("t.room") < F.col("t.block_tokens")), "left")
    turns = turns.select("t.source", "t.block", F.struct(F.col("t.epoch").alias("epoch"), F.col("t.block_rank").alias("block_rank"), F.coalesce("b.below", F.lit(1 << 62)).alias("below")).alias("turn"))
    taken = written(turns.groupBy("source", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns")), "taken")
    met = rows.alias("r").join(taken.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.block") == F.col("k.block")))
    out = met.select("r.doc_id", "r.source", "r.place", "r.tokens", *[f"r.{k}" for k in ks], F.inline("turns")).where("place < below")
    return out.select("doc_id", "source", "epoch", "block_rank", "place", "tokens", *out_names)
