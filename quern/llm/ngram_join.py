"""Near-duplicate documents by an n-gram Jaccard self-join.

Two documents link when the Jaccard similarity of their sets of word n-grams is
at least ``num/den``.  The join is a prefix-filter join:

1. *Order.* Every partition counts document frequencies of its n-grams in a
   count sketch (2**21 to 2**23 counters, by the size of the input); the sketches, merged in two levels, order all n-grams
   rare first (estimate, then hash).  Any one order is right; a rare-first one makes the
   posting lists short.
2. *Prefix.* Sets of n elements that reach the threshold share one of their
   first ``n - ceil(n*num/den) + 1`` elements.  Only these are dealt out, packed
   by hash bucket, and n-grams that one document alone has are dropped there.  N-grams
   that may be in ``hot`` documents or more (the estimate is an upper bound) skip this: they are dealt out by
   document, so no bucket holds a long list.
   Of documents with equal sets in one batch, one emits its prefix, so a group
   of copies reaches the shuffle once for a batch.
3. *Pairs.* Documents that share a prefix n-gram are candidates if the length
   and positional filters allow.  Class ids need links, not all pairs, so in each round a
   few pivots of each posting list are compared with the rest of the list, and
   documents that are already connected are not compared again.  The number of
   pivots grows eightfold by the round until every list is connected or exhausted:
   no link between different components can be missed, and no cap holds.
4. *Verify.* Each pair once: a suffix filter (halving the sets around a
   middle element bounds their overlap), then the exact size of the intersection.
5. *Count.* Linked sets are of one component, so with the components known the links of all
   sets are counted by comparing the sets of each component in blocks, exactly and without a cap.

Defined results: null or wordless text has no n-gram and links with nothing;
a text of fewer than n words has one element, its whole sequence; repeated rows give repeated
rows; a null id gets a row with null component and links with nothing; an id with several texts
is one document that links by each of them; an empty table gives an empty one.  n-grams are compared by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._graph import components
from ._store import arrow_bytes, bits_for, bounded, drop, few, plan_bytes, ship, written
from ._words import U, Words, chunks, mix, release, text_buffers

SKETCH_BITS = 21, 23  # least and most counters of the frequency sketch: 2 bytes each in a task, 4 after merging
SLICES = 64
BUNCH = 256  # partition sketches that are merged at a time
BLOOM_BITS = 26, 29  # least and most
BLOOM_PLACES = 4  # of the filter for a document at least; texts are joined instead where the largest filter has fewer
BUCKET_DOCS = 32_768  # documents with n-grams in a bucket, about 1 KB each
BLOCK = 1 << 18  # n-grams of a block of sets that meets another when links are counted
VERIFY_BYTES = 16 << 20  # of the pairs of sets that a Python worker gets at a time


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    off, raw = text_buffers(batch.column(1))
    row = 0
    for at, end in chunks(off):
        for s in Words(off, raw, at, end, lower=True).shingle_sets(n):
            yield row, s
            row += 1


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _jaccard_need(a, b, num: int, den: int):
    """Least intersection of sets of a and b elements that reach num/den: ceil(num * (a + b) / (num + den))."""
    return -((-num * (a + b)) // (num + den))


def _suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """Upper bound of the intersection of two sorted arrays by halving them around a's middle element."""
    if not depth or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    i = len(a) // 2
    j = int(np.searchsorted(b, a[i]))
    return _suffix_bound(a[:i], b[:j], depth - 1) + _suffix_bound(a[i:], b[j:], depth - 1)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 3, den: int = 4, pivots: int = 1, hot: int = 50_000
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (long), component_id (smallest id reachable by links), verified_links.

    verified_links: all other documents (ids) whose set reaches num/den, those with an equal set among them.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch_bits = bits_for(plan_bytes(docs) // 512, *SKETCH_BITS)
    width = 1 << sketch_bits
    per_slice = width // SLICES
    place = lambda s: (s >> U(64 - sketch_bits)).astype(np.int64)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(width, np.uint32)
        for batch in batches:
            ids, sizes, digests, pending, held = batch.column(0), [], [], [], 0
            for _, s in _sets(batch, n):
                sizes.append(len(s))
                digests.append(_digest(s))
                pending.append(s)
                held += len(s)
                if held > 1_000_000:
                    np.add.at(sketch, place(np.concatenate(pending)), np.uint32(1))
                    pending, held = [], 0
            if held:
                np.add.at(sketch, place(np.concatenate(pending)), np.uint32(1))
            m = len(batch)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=["doc_id", "n", "digest", "slice", "bunch", "counts"],
            )
        parts = [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in np.split(sketch, SLICES) if x.any()]
        which = [i for i, x in enumerate(np.split(sketch, SLICES)) if x.any()]
        m = len(which)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(which, pa.int32()), pa.array([TaskContext.get().partitionId() // BUNCH] * m, pa.int32()), pa.array(parts, pa.binary())],
            names=["doc_id", "n", "digest", "slice", "bunch", "counts"],
        )
        del sketch
        release()

    surveyed = written(docs.mapInArrow(survey, "doc_id long, n long, digest binary, slice int, bunch int, counts binary"), "survey")

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(per_slice, np.uint32)
        for x in rows["counts"]:
            total += np.frombuffer(x, np.uint16 if len(x) == 2 * per_slice else np.uint32)
        return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    merged = surveyed.where("slice is not null").select("slice", "bunch", "counts").groupBy("slice", "bunch").applyInPandas(merge, "slice int, counts binary")
    merged = merged.groupBy("slice").applyInPandas(merge, "slice int, counts binary")
    order_by = np.zeros(width, np.uint32)
    for r in merged.collect():  # SLICES rows, 4 bytes a counter: 32 MB at most
        order_by[r["slice"] * per_slice : (r["slice"] + 1) * per_slice] = np.frombuffer(r["counts"], np.uint32)
    shared_order = spark.sparkContext.broadcast(order_by)
    meta = surveyed.where("slice is null").select("doc_id", "n", "digest")
    classes = written(
        meta.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes"
    )
    n_buckets = max(4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), meta.count() // BUCKET_DOCS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        est = shared_order.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = np.asarray(batch.column(0).is_valid())
            seen: dict[bytes, int] = {}
            toks, often, owner, sizes, held = [], [], [], [], 0
            for row, s in _sets(batch, n):
                if not len(s) or not known[row]:
                    continue
                if seen.setdefault(_digest(s), int(ids[row])) != int(ids[row]):
                    continue
                p = len(s) - (-(-len(s) * num // den)) + 1
                much = est[place(s)]
                first = np.argsort(much, kind="stable")[:p]
                toks.append(s[first])
                often.append(much[first] >= hot)
                owner.append(int(ids[row]))
                sizes.append(len(s))
                held += p
                if held > 500_000:
                    yield _prefix_batch(toks, often, owner, sizes, n_buckets)
                    toks, often, owner, sizes, held = [], [], [], [], 0
            if toks:
                yield _prefix_batch(toks, often, owner, sizes, n_buckets)
        release()

    def shared(key, rows: pd.DataFrame) -> pd.DataFrame:
        tok = np.frombuffer(b"".join(rows["tok"]), np.uint64)
        doc = np.frombuffer(b"".join(rows["doc"]), np.int64)
        size = np.frombuffer(b"".join(rows["size"]), np.int32)
        pos = np.frombuffer(b"".join(rows["pos"]), np.int32)
        order = np.argsort(tok, kind="stable")
        tok, doc, size, rest = tok[order], doc[order], size[order].astype(np.int64), (size[order] - pos[order]).astype(np.int64)
        for _ in range(2 if key[0] >= 0 else 0):
            # Documents that share too little, from this n-gram on, with even the smallest set of the list; then lists of one.
            new = np.append(True, tok[1:] != tok[:-1])[: len(tok)]
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            least = np.minimum.reduceat(size, start)[group] if len(tok) else size
            keep = rest * (num + den) >= num * (size + np.maximum(least, -(-size * num // den)))
            keep &= np.bincount(group[keep], minlength=len(start))[group] > 1
            tok, doc, size, rest = tok[keep], doc[keep], size[keep], rest[keep]
        release()
        return pd.DataFrame({"tok": tok.view(np.int64), "doc": doc, "size": size.astype(np.int32), "rest": rest.astype(np.int32)})

    packed = docs.mapInArrow(prefixes, "bucket long, tok binary, doc binary, size binary, pos binary")
    postings = packed.groupBy("bucket").applyInPandas(shared, "tok long, doc long, size int, rest int")
    # Equal sets stand as one: documents become the smallest document with the same set.
    rep_of = written(
        meta.where("digest is not null and doc_id is not null").join(classes, "digest").select(F.col("doc_id").alias("doc"), "rep").where("doc <> rep").distinct(), "reps"
    )
    postings = written(
        postings.join(bounded(rep_of), "doc", "left")
        .select("tok", F.coalesce("rep", "doc").alias("doc"), "size", "rest")
        .distinct(),
        "postings",
    )

    links: DataFrame | None = None
    done: DataFrame | None = None
    comp: DataFrame | None = None
    sets: DataFrame | None = None
    while True:
        live = postings
        if comp is None:
            live = live.withColumn("comp", F.col("doc")).withColumn("weight", F.lit(0))
        else:
            live = live.join(bounded(comp.select(F.col("node").alias("doc"), "component", "weight")), "doc", "left")
            live = live.select("tok", "doc", "size", "rest", F.coalesce("component", "doc").alias("comp"), F.coalesce("weight", F.lit(1)).alias("weight"))
        # Lists that are not connected yet, without documents that share too little with even the smallest set there.
        # Pivots of a list: first of the smallest components, and of them those with the fewest n-grams before this one.
        order = F.struct("weight", (F.col("size") - F.col("rest")).alias("ahead"), "doc", "size", "rest", "comp")
        lists = live.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least"), F.min(order).alias("p")).where("lo <> hi")
        enough = F.col("rest") * (num + den) >= num * (F.col("size") + F.greatest("least", F.ceil(F.col("size") * num / den)))
        live = written(live.join(lists.select("tok", "least", "p"), "tok").where(enough).drop("least"), "live")
        if live.isEmpty():
            break
        lead = None
        if pivots == 1:
            # One pivot has come with the list, so nothing is dealt out again.
            met = live.where("doc <> p.doc").select("tok", "doc", "size", "rest", "comp", *[F.col(f"p.{c}").alias("a_" + c) for c in ("doc", "size", "rest", "comp")])
            left = live.where("doc <> p.doc").select("tok", "doc", "size", "rest")
        else:
            # Spark keeps the first k of each list before the shuffle.
            live = few(live.drop("p"))
            first = W.partitionBy("tok").orderBy("weight", F.col("size") - F.col("rest"), "doc")
            lead = few(written(live.withColumn("k", F.row_number().over(first)).where(F.col("k") <= pivots), "lead"))
            a = lead.select("tok", *[F.col(c).alias("a_" + c) for c in ("doc", "size", "rest", "comp")])
            met = a.join(live, "tok")
            left = live.select("tok", "doc", "size", "rest").join(lead.select("tok", "doc"), ["tok", "doc"], "left_anti")
        need = F.ceil(F.lit(num) * (F.col("a_size") + F.col("size")) / F.lit(num + den))
        pairs = (
            met.where("a_comp <> comp")
            .where(F.least("a_size", "size") * den >= F.greatest("a_size", "size") * num)  # length
            # Position: at the first common n-gram, what is left of both sets must reach the intersection that is needed.
            .where(F.least("a_rest", "rest") >= need)
            .select(F.least("a_doc", "doc").alias("a"), F.greatest("a_doc", "doc").alias("b"))
            .distinct()
        )
        if done is not None:
            pairs = pairs.join(bounded(done), ["a", "b"], "left_anti")
        pairs = few(written(pairs, "pairs"))
        # Sets are made for the documents of the pairs only; a Bloom filter of fixed size keeps the other texts from being
        # dealt out (it only lets a few too many through).
        wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("doc").distinct(), "doc", "left_anti")
        wanted = few(written(wanted, "wanted"))
        if sets is None or not wanted.isEmpty():
            made = written(_sets_of(docs, wanted, n), "sets")
            sets = made if sets is None else sets.union(made)
        with arrow_bytes(spark, VERIFY_BYTES):
            found = written(_verified(pairs, sets, num, den), "links")
        links = found if links is None else links.union(found)
        before, done = (done, pairs) if done is None else (done, written(done.union(pairs), "done"))
        if before is not None:
            drop(before, pairs)
        used, postings = postings, written(left, "postings")  # a pivot has met its whole list
        drop(used, live, lead, wanted)
        if comp is None or not found.isEmpty():
            comp = few(written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "nodes"))
            comp = written(comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("weight")), "component"), "comp")
        pivots *= 8

    copies = written(rep_of.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")), "copies")
    by_class = classes.join(copies, "rep", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    if comp is None:
        by_class = by_class.select("digest", F.col("rep").alias("component_id"), F.col("copies").alias("verified_links"))
    else:
        counts = written(_link_counts(comp, meta.where("digest is not null and doc_id is not null"), copies, sets, num, den), "link-counts")
        by_class = (
            by_class.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .join(counts, "rep", "left")
            .select("digest", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") + F.coalesce("links", F.lit(0))).alias("verified_links"))
        )
    drop(postings, live, done, sets, links)
    linked = meta.where("digest is not null and doc_id is not null").join(by_class, "digest")
    alone = meta.where("digest is null or doc_id is null")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "verified_links").union(
        alone.select("doc_id", F.col("n"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long"))
    )


def _prefix_batch(toks: list, often: list, owner: list, sizes: list, n_buckets: int) -> pa.RecordBatch:
    """Packed by bucket of the n-gram; very frequent ones by one of the document, in buckets of negative number."""
    per = np.array([len(t) for t in toks])
    tok, doc, much = np.concatenate(toks), np.repeat(np.array(owner, np.int64), per), np.concatenate(often)
    pos = np.arange(len(tok), dtype=np.int64) - np.repeat(np.cumsum(per) - per, per)
    bucket = ((tok >> U(20)) % U(n_buckets)).astype(np.int64)
    bucket[much] = -1 - (mix(doc[much].view(U)) % U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    columns = [x[order] for x in (tok, doc, np.repeat(np.array(sizes, np.int32), per), pos.astype(np.int32))]
    packed = [pa.array([c[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(bucket)))], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), *packed], names=["bucket", "tok", "doc", "size", "pos"])


def _bloom_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [(mix(h + U(k)) >> U(64 - bits)).astype(np.int64) for k in range(2)]


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc, grams) of the wanted documents and a few others, once for each row; grams: packed sorted 64-bit hashes."""
    spark = docs.sparkSession
    n_wanted = wanted.count()
    bloom_bits = bits_for(2 * BLOOM_PLACES * n_wanted, *BLOOM_BITS)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for _, s in _sets(batch, n)], pa.binary())], names=["doc", "grams"])

    if BLOOM_PLACES * n_wanted > 1 << bloom_bits:
        return docs.join(wanted.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").mapInArrow(sets, "doc long, grams binary")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << bloom_bits) // 8, np.uint8)
        for batch in batches:
            for at in _bloom_places(batch.column(0).to_numpy(), bloom_bits):
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for i, part in enumerate(np.split(bits, SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "bits"])
        del bits
        release()

    def either(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(rows["bits"].iloc[0], np.uint8).copy()
        for x in rows["bits"]:
            out |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"slice": [key[0]], "bits": [out.tobytes()]})

    parts = wanted.coalesce(8).mapInArrow(fill, "slice int, bits binary").groupBy("slice").applyInPandas(either, "slice int, bits binary")
    bits = np.zeros((1 << bloom_bits) // 8, np.uint8)
    per = len(bits) // SLICES
    for r in parts.collect():  # 64 MB at most
        bits[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy()
            ok = np.ones(len(ids), bool)
            for at in _bloom_places(ids, bloom_bits):
                ok &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(ok))
            if len(batch):
                yield from sets(iter([batch]))
        release()

    return docs.mapInArrow(make, "doc long, grams binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach num/den, each pair verified once."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                need = _jaccard_need(len(x), len(y), num, den)
                if _suffix_bound(x, y) < need:
                    ok.append(False)
                else:
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    ok.append(int((both[1:] == both[:-1]).sum()) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    pairs = bounded(pairs)
    later = sets.join(pairs.select(F.col("b").alias("doc")).distinct(), "doc", "left_semi")
    return (
        pairs.join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("x")), "a")
        .join(later.select(F.col("doc").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(check, "a long, b long")
        .distinct()
    )


def _link_counts(comp: DataFrame, meta: DataFrame, copies: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, links): the documents of all other sets that reach num/den, for each set of a component.

    Small components are packed into blocks, each compared in whole.  A large one is cut into bands of sizes, so wide that
    sets two bands apart cannot link, and bands into blocks by hash; each two blocks of a band or of neighbouring bands meet once.
    """
    near = comp.select("component", F.col("node").alias("doc_id"))
    nodes = meta.join(bounded(near), "doc_id").groupBy("component", "doc_id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    nodes = nodes.join(bounded(copies.withColumnRenamed("rep", "doc_id")), "doc_id", "left").withColumn("docs", F.coalesce("copies", F.lit(0)) + 1).drop("copies")
    nodes = written(nodes, "link-nodes")
    # An id with texts of several sizes has no band.
    whole = nodes.groupBy("component").agg(F.sum("most").alias("total"), F.max(F.col("least") < F.col("most")).alias("mixed"))
    whole = written(whole.withColumn("small", F.col("total") <= BLOCK), "link-components")
    packs = max(1, -(-(whole.where("small").agg(F.sum("total")).first()[0] or 0) // BLOCK))
    width = math.log(1.001 * den / num)
    band = F.when(F.col("small") | F.col("mixed"), 0).otherwise(F.floor(F.log("most") / width).cast("int"))
    placed = nodes.join(bounded(whole), "component").withColumn("band", band)
    large = placed.where("not small")
    blocks = written(large.groupBy("component", "band").agg(F.ceil(F.sum("most") / BLOCK).cast("int").alias("k")), "link-blocks")
    for name, step in (("k", 0), ("k_next", 1), ("k_prev", -1)):
        large = large.join(bounded(blocks.select("component", (F.col("band") - step).alias("band"), F.col("k").alias(name))), ["component", "band"], "left")
    i, one = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"), F.lit(1)
    meet = lambda k, f: F.when(F.col(k).isNull(), F.array().cast("array<struct<kind: int, band: int, i: int, j: int, later: boolean>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col(k) - 1), f))
    at = lambda kind, b, x, y, later: F.struct(F.lit(kind).alias("kind"), b.alias("band"), x.alias("i"), y.alias("j"), later.alias("later"))
    meetings = F.concat(
        meet("k", lambda j: at(0, F.col("band"), F.least(i, j), F.greatest(i, j), i > j)),
        meet("k_next", lambda j: at(1, F.col("band"), i, j, F.lit(False))),
        meet("k_prev", lambda j: at(1, F.col("band") - one, j, i, F.lit(True))),
    )
    zero = F.lit(0)
    places = large.select("doc_id", "docs", F.col("component").alias("pack"), F.inline(meetings)).union(
        placed.where("small").select("doc_id", "docs", F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack"), F.lit(2), zero, zero, zero, F.lit(False))
    )
    places = written(places.withColumnRenamed("doc_id", "doc"), "link-places")

    def count(key, rows: pd.DataFrame) -> pd.DataFrame:
        alone = key[1] == 2 or (key[1] == 0 and key[3] == key[4])
        grams = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        size = np.array([len(x) for x in grams], np.int64)
        ids, doc = np.unique(rows["doc"].to_numpy(), return_inverse=True)
        weight = np.zeros(len(ids), np.int64)
        weight[doc] = rows["docs"].to_numpy()
        later = rows["later"].to_numpy().astype(bool)
        left, right = np.flatnonzero(~later), np.flatnonzero(~later if alone else later)
        pairs = []
        if len(left) and len(right):
            tok, own = np.concatenate([grams[x] for x in left]), np.repeat(np.arange(len(left)), size[left])
            order = np.argsort(tok, kind="stable")
            tok, own = tok[order], own[order]
            start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            held, lists = tok[start], np.diff(np.append(start, len(tok)))
            for r in right:
                to = np.minimum(np.searchsorted(held, grams[r]), len(held) - 1)
                to = to[held[to] == grams[r]]
                many = lists[to]
                each = np.repeat(start[to] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both = np.bincount(own[each], minlength=len(left))
                other = doc[left[both >= _jaccard_need(size[left], size[r], num, den)]]
                pairs.append(np.unique(np.minimum(other, doc[r]) * len(ids) + np.maximum(other, doc[r])))
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        a, b = pairs // len(ids), pairs % len(ids)
        a, b = a[a < b], b[a < b]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        release()
        return pd.DataFrame({"rep": ids[links > 0], "links": links[links > 0]})

    met = sets.where("length(grams) > 0").join(bounded(places), "doc")
    counted = met.groupBy("pack", "kind", "band", "i", "j").applyInPandas(count, "rep long, links long")
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))
