"""The llm operators against brute force on small tables with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

random.seed(5)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def corpus():
    base, passage = text(120), text(70)
    edited = base.split()
    edited[60] = "zzz"
    far = base.split()
    for i in range(0, 120, 9):
        far[i] = f"q{i}"
    rows = [(0, base), (1, base), (2, " ".join(edited)), (3, " ".join(far)), (4, None), (5, ""), (6, "one two"), (7, "One TWO"), (None, base)]
    rows += [(10, text(30) + " " + passage + " " + text(30)), (11, text(20) + "\t" + passage), (12, text(3000)), (1, base), (13, text(60))]
    return rows


DOCS = "doc_id long, text string, a int, digest string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", None if i == 4 else f"s{(i or 0) % 3}") for i, t in rows], DOCS)


def sets(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join(spark):
    from quern.llm.ngram_join import near_duplicates

    rows = corpus() + [(100 + k, " ".join((x := text(1), corpus()[0][1]))) for k in range(3)]
    got = {}
    for r in near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    ids = {i: sets(t) for i, t in rows if i is not None}
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                n = len(ids[a] & ids[b])
                if ids[a] and ids[b] and 100 * n >= 75 * len(ids[a] | ids[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: {(len(ids[i]), comp[i])} for i in ids} == {i: v for i, v in got.items() if i is not None}
    assert got[None] == {(116, None)}
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_passages(spark):
    from quern.llm.substring_dedup import dedup_passages

    rows = corpus()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup_passages(frame(spark, rows)).collect())
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                keep[s : s + 50] = [False] * 50
        kept = b" ".join(x for x, k in zip(w, keep) if k).decode()
        want[(i, len(w), keep.count(False), kept)] += 1
    assert got == want
    assert dedup_passages(frame(spark, rows).limit(0)).count() == 0


def test_chat_round_trip(spark):
    from quern.llm.chat import canonical_turns, format_turns, read_back

    texts = ["a", None, "", "\\### Assistant: </turn> ok\n", "\\b\\c\\h\\d", "</turn>\n### user: x", "é\\"]
    rows = [(1, k, r, t, "x") for k, (t, r) in enumerate((t, r) for t in texts for r in ("user", "assistant", "we: ird\\", None))] + [(None, None, None, None, None), (2, 0, "assistant", "z", "y"), (2, 0, "assistant", "z", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in read_back(format_turns(canonical_turns(df))).collect()}
    mine = [(r or "", t or "") for i, _, r, t, _ in rows if i == 1]
    assert [tuple(x) for x in got[1].turns] == mine
    assert got[1].loss_texts == [t for r, t in mine if r == "assistant"]
    assert len(got[2].turns) == 2 and len(got[None].turns) == 1
    assert format_turns(canonical_turns(df.limit(0))).count() == 0


def test_pii(spark):
    from quern.llm.pii import pseudonymise

    rows = [(i, f"mail a{i}@x.org and A{i}@X.ORG or +1 (443) 555-{1000 + i} or 443-555-{1000 + i} ip 10.0.0.{i}", None) for i in range(40)]
    rows += [(50, "nothing here", "k"), (51, None, None), (None, "", None), (0, rows[0][1], None), (60, "Mrs. Anna Smith met Mr. Bob Smith and Mrs. Anna Smith", "t")]
    out = pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, piece string"), keep=("piece",)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r.text for r in out}
    assert by[50] == "nothing here" and by[51] is None and by[None] == ""
    mails = set()
    for i in range(40):
        w = by[i].split()
        assert w[1].lower() == w[3].lower() and w[1] != f"a{i}@x.org" and w[3] == w[3].upper()
        assert w[7][-8:] == w[9][-8:] and w[5] == "+1"
        mails.add(w[1])
    assert len(mails) == 40 and len({by[i].split()[-1] for i in range(40)}) == 40
    names = by[60].split()
    assert names[0] == "Mrs." and names[1:3] == names[-2:] and "Smith" not in by[60]


def test_mixing(spark):
    from quern.llm.mixing import mix_sources, temperature_weights

    power, w = temperature_weights({"a": 900, "b": 100}, 1000, max_epochs=2.0)
    assert abs(w["b"] * 1000 / 100 - 2.0) < 1e-6 and 0 < power < 1
    rows = [(i, text(20), "big" if i % 10 else "small") for i in range(300)] + [(1000, None, None), (1000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, max_epochs=3.0, blocks=16).collect()
    n = Counter((r.doc_id, r.epoch) for r in out)
    assert max(v for k, v in n.items() if k[0] != 1000) == 1
    small = Counter(r.doc_id for r in out if r.source == "small")
    assert set(small) == {i for i in range(300) if i % 10 == 0} and max(small.values()) <= 3
    assert abs(sum(r.tokens for r in out) - 6302) < 200
    assert mix_sources(df.limit(0)).count() == 0


def test_toxicity_and_quality(spark):
    from quern.llm.quality import expected_quality
    from quern.llm.toxicity import toxicity

    rows = [(i, text(40) + (" moron idiot" if i % 3 == 0 else "")) for i in range(300)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(300)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    out = {r.doc_id: r for r in toxicity(frame(spark, rows), labels, keep=("text",)).collect()}
    assert len(out) == 303 and all(out[i].predicted == int(i % 3 == 0) for i in range(300)) and 0 <= out[900].score <= 1
    grade = F.col("quality")
    q = {r.doc_id: r for r in expected_quality(frame(spark, rows), labels, grade, 2).collect()}
    assert np.mean([q[i].keep == (i % 3 != 0) for i in range(300)]) > 0.9
    assert toxicity(frame(spark, rows).limit(0), labels.limit(0)).count() == 0


def test_warc(spark):
    from quern.llm.warc import read_archives, record_name, write_archives

    long, short = "é" * 200, "s" * 20
    rows = [(3, "http://a/ x\n", long), (1, None, long), (7, "u", long), (2, "u", short), (4, "u", short), (5, "u", None), (6, "u", ""), (1, None, long), (None, "u", "x" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = read_archives(write_archives(df)).collect()
    got = Counter((r.record_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in out)
    again = lambda i, t: t == long and i != 1
    want = Counter((record_name(i), u, len((t or "").encode()), "revisit" if again(i, t) else "response", record_name(1) if again(i, t) else None) for i, u, t in rows)
    assert got == want
    assert all(r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() for r in out if r.payload is not None)
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_top_k(spark):
    from quern.llm.topk import exact_top_k

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x[100] = x[101]
    rows = [(i, [float(v) for v in x[i]]) for i in range(500)] + [(600, None), (601, [None] * 16), (602, [float("nan")] * 16)]
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()}
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    for i in range(0, 500, 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(500), -s)) if j != i][:5]
        assert [out[i, k + 1] for k in range(5)] == [(j, s[j]) for j in best]
    assert len(out) == 50


def test_decontamination(spark):
    from quern.llm.decontaminate import contaminated

    item = text(30)
    edited = item.split()
    edited[0] = "changed"
    docs = [(1, text(50) + " " + item.upper() + "!! " + text(9)), (2, text(80)), (3, " ".join(edited)), (4, None), (5, ""), (6, text(20) + " " + " ".join(item.split()[:12])), (1, item), (7, "tiny item here")]
    items = spark.createDataFrame([(9, item), (8, None), (7, "Tiny item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(frame(spark, docs), items).collect()}
    assert set(got) == {(1, 9), (3, 9), (7, 7)} and got[1, 9] == 1.0 and 0.9 < got[3, 9] < 1
    assert contaminated(frame(spark, docs), items.limit(0)).count() == 0
