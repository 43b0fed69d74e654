"""Removal of long passages that an earlier document already has.

A window is ``window`` consecutive words of one document.  A word goes if a
window that covers it also starts in a document with a smaller id; all windows
are judged on the input.

1. *Count-min prefilter.*  Equal windows have equal anchors: the least hash of
   the word runs of ``gram`` words inside the window.  So the number of documents
   with a window's anchor is at least the number with the window, and a
   count-min sketch of anchors overestimates window counts while it gets only
   two keys for about ``window - gram`` windows.  Each partition counts its own
   sketch (two hash rows, counters that stop at 2); partition sketches travel in
   sparse form and are merged by adding, first those of ``BUNCH`` partitions, then these.
2. *Exact grouping* of the windows whose estimate is two or more, by 96 bits of
   hash.  Windows that a smaller document of the same ``HELD_WINDOWS`` has are decided
   there; the rest is dealt out packed by bucket of the anchor.  Of large inputs windows are decided among
   those of ``BUNCH`` partitions first, so that a passage that very many documents share comes to its bucket once for so many partitions.

The sketch grows with the input from 2**26 to 2**29 counters a row; when the input has far more anchors
than counters it lets more windows through and loses none.  Words are compared by 64 bits of hash, in which every
eight bytes are mixed on their own, and windows by 96.

Defined results: null text has no words; a text shorter than the window loses nothing; rows
with null id neither remove nor lose words; rows of equal id (repeated rows) do not remove from each
other; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bits_for, plan_bytes, ship, written
from ._words import U, Words, chunks, mix, release, runs, text_buffers

SLICES = 64
BUNCH = 256  # partitions whose sketches are merged, or whose windows are decided, together first
BUNCH_BYTES = 32 << 30  # of smaller inputs all partitions are one bunch
HELD_WINDOWS = 400_000  # windows that a worker decides among at a time, 40 bytes each


def _anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one document: its first word's place, its document and its anchor."""
    w = words.hash
    if len(w) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    doc = np.repeat(np.arange(words.n_docs), words.count)
    at = np.flatnonzero(doc[: len(w) - window + 1] == doc[window - 1 :])
    least = runs(w, gram)
    span, reach = window - gram + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = span - reach
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return at, doc[at], least[at]


def _rows_of(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (anchor >> U(64 - bits)).astype(np.int64), (mix(anchor) >> U(64 - bits)).astype(np.int64)


def repeated_anchors(docs: DataFrame, window: int, gram: int, bits: int, bunched: bool) -> tuple[np.ndarray, np.ndarray]:
    """Merged sketch of (doc_id, text): for both hash rows the packed bits of the counters that reached 2."""
    per = (1 << bits) // SLICES

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, raw = text_buffers(batch.column(1))
            kept = []
            for at, end in chunks(off):
                _, doc, a = _anchors(Words(off, raw, at, end, lower=False), window, gram)
                if len(a):
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                    a, doc = a[new], doc[new]
                    order = np.lexsort((doc, a))
                    a, doc = a[order], doc[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                    kept.append(a[new])
            release()
            if not kept:
                continue
            places = _rows_of(np.concatenate(kept), bits)
            out = []
            for row, at in enumerate(places):
                at.sort()
                twice = np.ones(len(at), bool)  # a counter that stops at 2
                twice[2:] = at[2:] != at[:-2]
                at = at[twice]
                cut = np.searchsorted(at, np.arange(SLICES + 1) * per)
                out += [(row * SLICES + i, (at[x:y] - i * per).astype(np.uint32).tobytes()) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if x < y]
            n, bunch = len(out), TaskContext.get().partitionId() // BUNCH
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([bunch] * n, pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["slice", "bunch", "places"]
            )

    def total(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros(per, np.uint8)
        for x in rows["places"]:
            at = np.frombuffer(x, np.uint32)
            one, many = np.unique(at, return_counts=True)
            out[one] = np.minimum(out[one] + many, 2).astype(np.uint8)
        return out

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = total(rows)
        places = np.concatenate([np.flatnonzero(out >= k) for k in (1, 2)]).astype(np.uint32)
        return pd.DataFrame({"slice": [key[0]], "places": [places.tobytes()]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(total(rows) >= 2).tobytes()]})

    found = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    parts = docs.mapInArrow(sketch, "slice int, bunch int, places binary")
    if bunched:
        parts = parts.groupBy("slice", "bunch").applyInPandas(add, "slice int, places binary")
    merged = parts.groupBy("slice").applyInPandas(merge, "slice int, bits binary")
    for r in merged.collect():  # 2 * 2**bits bits at any input size
        row, i = divmod(r["slice"], SLICES)
        found[row][i * per // 8 : (i + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    return found[0], found[1]


def _hit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _later(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, and in it whether a smaller document has the same window."""
    order = np.lexsort((doc, h2, h))
    h, h2, doc = h[order], h2[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else doc
    return order, doc > least


def _spans(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, window: int) -> pd.DataFrame:
    """Window starts to packed (first word, one past the last word) for each (doc, key)."""
    if not len(doc):
        return pd.DataFrame({"doc_id": doc, "key": key, "spans": np.zeros(0, object)})
    order = np.lexsort((pos, key, doc))
    doc, key, pos = doc[order], key[order], pos[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    new = other.copy()
    new[1:] |= pos[1:] - pos[:-1] > window
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    pairs = np.stack((pos[first], pos[last] + window), 1).astype(np.int32)
    owner = np.flatnonzero(other[first])
    ends = np.append(owner[1:], len(first))
    return pd.DataFrame({"doc_id": doc[first[owner]], "key": key[first[owner]], "spans": [pairs[i:j].tobytes() for i, j in zip(owner, ends)]})


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 10, bits: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (string: the kept words joined by one space).

    bits: of the sketch's places (9 at least), by default by the size of the input.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = plan_bytes(docs)
    # An anchor for about 20 words, and 16 counters for each anchor of a few GB.
    bits = bits or bits_for(size // 64, 26, 29)
    rows = spark.sparkContext.broadcast(repeated_anchors(docs.where("doc_id is not null"), window, gram, bits, size > BUNCH_BYTES))
    n_buckets = max(4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), min(size >> 24, 1 << 22))

    columns = ["h", "h2", "doc", "key", "pos"]
    kinds = [np.uint64, np.uint32, np.int64, np.int64, np.int32]

    def packed_rows(got: list[np.ndarray], bucket: np.ndarray) -> pd.DataFrame:
        """Decides windows that meet here; the open and the decided ones (of these no hashes are sent), packed by bucket."""
        order, later = _later(*got[:3])
        got, bucket = [x[order] for x in got], bucket[order]
        # Decided windows need no meeting: they go by document.
        bucket = np.where(later, (mix(got[2].view(U)) % U(n_buckets)).astype(np.int64), bucket)
        out = []
        for kind in (False, True):
            sel = np.flatnonzero(later == kind)
            sel = sel[np.argsort(bucket[sel], kind="stable")]
            b = bucket[sel]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
            for x, y in zip(cut, np.append(cut[1:], len(b))):
                packed = [c[sel[x:y]].tobytes() for c in got]
                out.append((int(b[x]), *(packed if not kind else [b"", b"", *packed[2:]])))
        return pd.DataFrame(out, columns=["bucket", *columns])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits0, bits1 = rows.value
        group = TaskContext.get().partitionId() // BUNCH
        schema = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in columns] + [("bunch", pa.int32())])

        def send(got: list[tuple]) -> pa.RecordBatch:
            *cols, a = (np.concatenate(x) for x in zip(*got))
            made = packed_rows(cols, (mix(a) % U(n_buckets)).astype(np.int64))
            return pa.RecordBatch.from_pandas(made.assign(bunch=group), schema=schema, preserve_index=False)

        got: list[tuple] = []
        held = 0
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            off, raw = text_buffers(batch.column(1))
            for at, end in chunks(off):
                words = Words(off, raw, at, end, lower=False)
                where, doc, a = _anchors(words, window, gram)
                if not len(a):
                    continue
                p0, p1 = _rows_of(a, bits)
                ok = _hit(bits0, p0) & _hit(bits1, p1)
                if ok.any():
                    where, doc, a = where[ok], doc[ok], a[ok]
                    h = runs(words.hash, window, 1)[where]
                    h2 = (runs(words.hash, window, 2)[where] >> U(32)).astype(np.uint32)
                    got.append((h, h2, ids[at + doc], keys[at + doc], (where - words.first[doc]).astype(np.int32), a))
                    held += len(a)
                if held > HELD_WINDOWS:
                    yield send(got)
                    got, held = [], 0
            release()
        if got:
            yield send(got)

    def unpacked(part: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(part[c]), k) for c, k in zip(columns, kinds)]

    def among(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """One bucket's open windows of a bunch of partitions, decided as far as they can be."""
        done = part["h"].str.len() == 0
        still = unpacked(part[~done])
        out = packed_rows(still, np.full(len(still[0]), key[0], np.int64))
        return pd.concat([out, part.loc[done, ["bucket", *columns]]], ignore_index=True)

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        done = part["h"].str.len() == 0
        still, known = unpacked(part[~done]), unpacked(part[done])
        order, later = _later(*still[:3])
        out = _spans(*(np.concatenate((x[order][later], y)) for x, y in zip(still[2:], known[2:])), window)
        release()
        return out

    keyed = docs.withColumn("key", F.xxhash64("text"))
    packing = "bucket long, h binary, h2 binary, doc binary, key binary, pos binary"
    met = keyed.where("doc_id is not null").mapInArrow(candidates, packing + ", bunch int")
    if size > BUNCH_BYTES:
        met = met.groupBy("bucket", "bunch").applyInPandas(among, packing)
    else:
        met = met.drop("bunch")
    spans = written(met.groupBy("bucket").applyInPandas(decide, "doc_id long, key long, spans binary"), "spans")
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if found.is_valid:
                    keep = np.ones(n, bool)
                    for x, y in np.frombuffer(b"".join(found.as_py()), np.int32).reshape(-1, 2):
                        keep[x:y] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                total.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return (
        keyed.join(spans, ["doc_id", "key"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
    )
