"""Benchmark decontamination by fingerprints of item-sized windows.

Words are the runs of letters and digits of the lower-cased text.  A document
holds an item of L words if a window of L of its words (the whole document if
shorter) has a weighted Jaccard similarity of at least ``threshold`` with it: shingles of
``n`` words (the whole item if it has fewer), weighted by how often they occur.

1. *Places.*  A window of enough similarity holds enough places where a shingle of some item occurs: their number in a window is
   an upper bound of the weighted intersection.  It is counted by differences at the first and last window
   that cover a place and a running sum, and only windows that reach the bound for an item are fingerprinted, each once.  Without
   this, a SimHash of each of the corpus's windows for each item size would be needed.  Nothing is lost here.
2. *SimHash.*  Each such window and each item gets a fingerprint of 256 bits; the bit sums are plain aggregates.
3. *Multi-index blocks.*  Fingerprints within ``radius`` have one of 16 blocks of 16 bits within ``radius // 16`` bits, so items are listed by
   (size, block, value) for all values that near, windows look up their own values, and the full distance is checked.  All pairs within
   ``radius`` meet; which item a window meets comes from the fingerprints alone.
4. *Verification* by the exact weighted similarity on the words.

Cosine of 0.857 belongs to a similarity of 0.75 between equally large sets, so about 44 of 256 bits differ there, with a deviation of about 6;
the radius of 60 leaves out about one pair in 200 at 0.75 exactly and next to none above 0.8.  ``recall_report`` counts, by the same
similarity between all windows and items that share enough places, what the fingerprints miss.

Defined results: null or wordless texts and items match nothing; repeated rows and ids give one row for each (doc_id, item_id), and
of the best windows the first; rows with null id are ignored,
as nothing could name them; an empty table gives an empty one.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import bounded, written

ITEM_SHINGLES_BROADCAST = 500_000  # rows of 28 bytes
FOUND = "doc_id long, item_id long, start_word int, n_words int, hamming int, similarity double"
BLOCKS, BLOCK_BITS = 16, 16
PRINT = [f"fp{i}" for i in range(4)]


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(w: Column, k: Column) -> Column:
    """Hashes of all shingles of k words of an array; of the whole array if it is shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, k)))


def simhash(df: DataFrame, hashes: str, *keys: str) -> DataFrame:
    """(*keys, fp0 .. fp3): the 256-bit SimHash of each row's array of 64-bit hashes; repeated ones count repeatedly.

    Rows of equal keys must have equal arrays.  Every hash gives 256 bits (64 of each of four hashes of it); a sum holds the counts of two of them, 32 bits each.
    """
    two = (1 << 32) | 1
    each = df.select(*keys, F.explode(hashes).alias("h"))
    each = each.select(*keys, *[F.xxhash64("h", F.lit(i)).alias(f"h{i}") for i in range(4)])
    sums = [F.sum(F.shiftrightunsigned(f"h{i}", b).bitwiseAND(F.lit(two))).alias(f"s{i}_{b}") for i in range(4) for b in range(32)]
    counted = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hashes"), *sums)
    low = F.lit((1 << 32) - 1)

    def word(i: int) -> Column:
        out = F.lit(0).cast("long")
        for b in range(32):
            s = F.col(f"s{i}_{b}")
            for at, c in ((b, s.bitwiseAND(low)), (b + 32, F.shiftrightunsigned(s, 32))):
                bit = F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")
                out = out.bitwiseOR(F.when(2 * c > F.col("n_hashes"), bit).otherwise(F.lit(0).cast("long")))
        return out

    return counted.select(*keys, *[word(i).alias(f"fp{i}") for i in range(4)])


def _near(radius: int) -> list[list[int]]:
    """For each block the differences to list: with these all fingerprints within ``radius`` share an entry.

    Sixteen blocks with more than r_i differing bits each make up more than ``radius`` if all (r_i + 1) add up to it plus one.
    """
    least, more = divmod(radius + 1, BLOCKS)
    masks = [[sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(BLOCK_BITS), k)] if r >= 0 else [] for r in range(-1, least + 1)]
    return [masks[least + 1 if i < more else least] for i in range(BLOCKS)]


def _values() -> list[Column]:
    return [F.shiftrightunsigned(f"fp{i // 4}", 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(BLOCKS)]


def _hamming() -> Column:
    parts = [F.bit_count(F.col(f"fp{i}").bitwiseXOR(F.col(f"item_fp{i}"))) for i in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def _prepared(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, n: int) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text).cast("string")).alias("w")).where("item_id is not null and size(w) > 0").distinct()
    items = items.select("item_id", F.size("w").alias("len"), _hashes(F.col("w"), F.least(F.size("w"), F.lit(n))).alias("hs"))
    # Items of one id with several texts are told apart by their hashes.
    return docs, written(items.select("*", F.xxhash64("hs", "len").alias("item")), "items")


def _windows(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, n_doc, len, item_id, item, first, last): runs of window starts with enough places of an item; ``docs`` is read once."""
    grams = items.select("item_id", "item", "len", F.least("len", F.lit(n)).alias("k"), F.explode("hs").alias("gh"))
    grams = written(grams.groupBy("item_id", "item", "len", "k", "gh").agg(F.count(F.lit(1)).cast("int").alias("mult")), "grams")
    sizes = sorted(r["k"] for r in grams.select("k").distinct().collect())  # at most n numbers
    if not sizes:
        return items.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("n_doc"), "len", "item_id", "item", F.lit(0).alias("first"), F.lit(0).alias("last")).limit(0)
    # One row a word and shingle size; only the items' shingles pass the join.
    # A document shorter than an item of at least n words still has shingles of n words, or none in common.
    split = docs.select("doc_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    each = split.select("doc_id", "w", F.size("w").alias("n_doc"), F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("pos"))
    made = [F.struct(F.lit(k).alias("hk"), F.xxhash64(*[F.get("w", F.col("pos") + i) for i in range(k)]).alias("h")) for k in sizes]
    if len(made) == 1:
        each = each.select("doc_id", "n_doc", "pos", F.lit(sizes[0]).alias("hk"), made[0]["h"].alias("h"))
    else:
        each = each.select("doc_id", "n_doc", "pos", F.inline(F.array(*made)))
    mine = F.broadcast(grams) if grams.count() <= ITEM_SHINGLES_BROADCAST else grams
    hits = each.where(F.col("pos") + F.col("hk") <= F.col("n_doc")).join(mine, (F.col("h") == F.col("gh")) & (F.col("hk") == F.col("k")))
    # The windows of the item's size that cover the place start between pos - (len - k) and pos, inside the document.
    width = F.least("len", "n_doc")
    lo = F.greatest(F.col("pos") - (width - F.col("k")), F.lit(0))
    hi = F.least(F.col("pos"), F.col("n_doc") - width)
    steps = F.array(F.struct(lo.alias("at"), F.lit(1).alias("d")), F.struct((hi + 1).alias("at"), F.lit(-1).alias("d")))
    keys = ["doc_id", "n_doc", "item_id", "item", "len", "k"]
    hits = written(hits.select(*keys, "pos", steps.alias("steps")), "hits")
    # similarity = I / (A + B - I) >= t  needs  I >= t * (A + B) / (1 + t) for A and B shingles; too few places at all are too few in any window.
    total = (F.col("len") - F.col("k") + 1) + (width - F.col("k") + 1)
    enough = lambda c: F.col(c) * (1 + threshold) + 1e-9 >= F.lit(threshold) * total
    some = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("places")).where(enough("places")).drop("places")
    steps = hits.join(some, keys, "left_semi").distinct().select(*keys, F.inline("steps")).groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    run = W.partitionBy(*keys).orderBy("at")
    spans = steps.select(*keys, F.col("at").alias("first"), F.sum("d").over(run).alias("places"), (F.lead("at").over(run) - 1).alias("last"))
    return written(spans.where(F.col("last").isNotNull() & enough("places")).select("doc_id", "n_doc", "len", "item_id", "item", "first", "last"), "spans")


def _made(docs: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """(doc_id, len, start, n_words, hs): the shingle hashes of the windows that start in ``spans``."""
    starts = spans.select("doc_id", "n_doc", "len", F.explode(F.sequence("first", "last")).alias("start")).distinct()
    starts = starts.groupBy("doc_id", "n_doc", "len").agg(F.collect_list("start").alias("starts")).groupBy("doc_id", "n_doc").agg(F.collect_list(F.struct("len", "starts")).alias("wanted"))
    starts = written(starts, "windows")
    ids = bounded(starts.select("doc_id").distinct())
    split = docs.join(ids, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    made = (
        split.join(starts, "doc_id")
        .where(F.size("w") == F.col("n_doc"))
        .select("doc_id", "w", F.inline("wanted"))
        .select("doc_id", "len", "w", F.explode("starts").alias("start"))
        .select("doc_id", "len", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("part"))
        .select("doc_id", "len", "start", F.size("part").alias("n_words"), _hashes(F.col("part"), F.least("len", F.lit(n))).alias("hs"))
    )
    # Rows of one id with several texts of one length give several windows of one place: told apart by their hashes.
    return written(made.select("*", F.xxhash64("hs").alias("window")).distinct(), "prints")


def _verified(met: DataFrame, made: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``met`` (doc_id, len, start, window, item_id, item, ...) with the exact similarity, where it is at least ``threshold``."""
    both = met.join(made, ["doc_id", "len", "start", "window"]).join(items.select("item_id", "item", F.col("hs").alias("item_hs")), ["item_id", "item"])
    # Counts of equal hashes, by one pass over both sorted arrays' runs: the intersection's weight is the sum of the least counts.
    runs = lambda c: F.aggregate(
        F.sort_array(c), F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("i"), F.array().cast("array<struct<h: bigint, i: int>>").alias("out")),
        lambda acc, x: F.struct(x.alias("h"), F.when(acc["h"] == x, acc["i"] + 1).otherwise(1).alias("i"), F.concat(acc["out"], F.array(F.struct(x.alias("h"), F.when(acc["h"] == x, acc["i"] + 1).otherwise(1).alias("i")))).alias("out")),
        lambda acc: acc["out"],
    )
    # The i-th occurrence of a hash in one has its like in the other if that has i of them too.
    plain = F.size(F.array_distinct("hs")) == F.size("hs")
    shared = F.when(plain, F.size(F.array_intersect("hs", "item_hs"))).otherwise(F.size(F.array_intersect(runs("hs"), runs("item_hs"))))
    out = both.withColumn("i", shared).withColumn("total", F.size("hs") + F.size("item_hs"))
    return out.withColumn("similarity", F.col("i") / (F.col("total") - F.col("i"))).where(F.col("similarity") >= threshold).drop("hs", "item_hs", "i", "total")


def _met(made: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(doc_id, len, start, window, item_id, item, hamming): windows and items of a size whose fingerprints are within ``radius``."""
    prints = simhash(made, "hs", "doc_id", "len", "start", "window")
    prints = written(prints, "window-prints")
    item_prints = written(simhash(items, "hs", "item_id", "item", "len").withColumnsRenamed({c: "item_" + c for c in PRINT}), "item-prints")
    listed = [F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(_values())]
    left = prints.select("doc_id", "len", "start", "window", *PRINT, F.inline(F.array(*listed)))
    masks = made.sparkSession.createDataFrame([(i, m) for i, m in enumerate(_near(radius))], "block int, masks array<int>")
    pieces = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(f"item_fp{i // 4}", 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("own")) for i in range(BLOCKS)]
    right = item_prints.select("*", F.inline(F.array(*pieces))).join(F.broadcast(masks), "block")
    right = right.select("item_id", "item", "len", "block", *["item_" + c for c in PRINT], F.explode(F.transform("masks", lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
    met = left.join(right, ["len", "block", "value"]).withColumn("hamming", _hamming()).where(F.col("hamming") <= radius)
    return met.select("doc_id", "len", "start", "window", "item_id", "item", "hamming").distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    n: int = 5, threshold: float = 0.75, radius: int = 60,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each contaminated (document, item)."""
    docs, items = _prepared(docs, items, id_col, text_col, item_col, item_text, n)
    made = _made(docs, _windows(docs, items, n, threshold), n)
    checked = _verified(_met(made, items, radius), made, items, threshold)
    best = F.min_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "hamming"))
    out = checked.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", F.col("b.start").alias("start_word"), "b.n_words", "b.hamming", "b.similarity")


def recall_report(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 5, threshold: float = 0.75, radius: int = 60,
) -> DataFrame:
    """One row: pairs (document, item) that hold by the exact similarity, pairs whose fingerprints find them, windows, pairs of
    windows and items of a size, and those of them that met within ``radius``.  For measuring: it verifies without fingerprints too.
    """
    docs, items = _prepared(docs, items, id_col, text_col, item_col, item_text, n)
    spans = _windows(docs, items, n, threshold)
    made = _made(docs, spans, n)
    met = written(_met(made, items, radius), "met")
    exact = spans.select("doc_id", "len", "item_id", "item", F.explode(F.sequence("first", "last")).alias("start")).distinct()
    exact = _verified(exact.join(made.select("doc_id", "len", "start", "window"), ["doc_id", "len", "start"]), made, items, threshold)
    exact = exact.select("doc_id", "item_id").distinct()
    found = _verified(met, made, items, threshold).select("doc_id", "item_id").distinct()
    by_len = made.groupBy("len").agg(F.count(F.lit(1)).alias("a")).join(items.groupBy("len").agg(F.count(F.lit(1)).alias("b")), "len")
    one = lambda df, c, name: df.agg(c.alias(name))
    out = one(exact, F.count(F.lit(1)), "held").crossJoin(one(found, F.count(F.lit(1)), "found")).crossJoin(one(made, F.count(F.lit(1)), "windows"))
    return out.crossJoin(one(by_len, F.sum(F.col("a") * F.col("b")), "pairs")).crossJoin(one(met, F.count(F.lit(1)), "met"))
