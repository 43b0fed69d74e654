"""Inputs that tempt an operator to be wrong: words of regular build, many buckets, large numbers, awkward entities, edited items."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import corpus, frame, sets  # noqa: I001

DOCS = "doc_id long, text string"


def regular(n=10):
    """Two different words of 2**n letters that have equal sums under every odd base modulo 2**64."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_of_regular_build_differ(spark):
    from quern.llm.ngram_join import near_duplicates
    from quern.llm.substring_dedup import dedup_passages

    a, b = regular()
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    head = " ".join(f"w{i}" for i in range(49))
    out = {r.doc_id: r.n_removed for r in dedup_passages(spark.createDataFrame([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")], DOCS)).collect()}
    assert out == {1: 0, 2: 0, 3: 50}
    # The same with the letters as words: runs of words are no sums either.
    x, y = (" ".join(w) for w in regular(7))
    out = {r.doc_id: r.n_removed for r in dedup_passages(spark.createDataFrame([(1, x), (2, y), (3, x)], DOCS), window=128, gram=64).collect()}
    assert out == {1: 0, 2: 0, 3: 128}


def test_passages_decided_in_bunches(spark, monkeypatch):
    from quern.llm import substring_dedup as m

    rows = corpus() * 3 + [(i, corpus()[0][1]) for i in range(20, 60)]
    rows = [(i, t) for i, t in rows if i is not None]
    df = frame(spark, rows).repartition(9)
    key = lambda d: sorted(map(str, d.collect()))
    want = key(m.dedup_passages(df))
    monkeypatch.setattr(m, "BUNCH_BYTES", -1)
    monkeypatch.setattr(m, "BUNCH", 2)
    assert key(m.dedup_passages(df, bits=12)) == want
    monkeypatch.setattr(m, "HELD_WINDOWS", 10)
    assert key(m.dedup_passages(df, bits=9)) == want


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_grams_and_joined_texts(spark, monkeypatch, hot):
    """Lists dealt out by document, two-level sketches, and texts that are joined as no filter is large enough: the same rows."""
    from quern.llm import ngram_join as m

    rows = [(i, t) for i, t in corpus() if i is not None] + [(100 + k, f"{'xyz'[k % 3]}{k} " + corpus()[0][1]) for k in range(12)]
    df = frame(spark, rows).repartition(7)
    key = lambda d: sorted(map(str, d.collect()))
    want = key(m.near_duplicates(df))
    monkeypatch.setattr(m, "BUNCH", 2)
    monkeypatch.setattr(m, "BLOOM_PLACES", 1 << 30)
    monkeypatch.setattr(m, "SKETCH_BITS", (8, 8))
    monkeypatch.setattr(m, "BUCKET_DOCS", 1)
    assert key(m.near_duplicates(df, hot=hot)) == want


def test_top_k_of_large_numbers_and_odd_rows(spark):
    from quern.llm.topk import exact_top_k

    rows = [(0, [1e18, 1.0]), (50, [0.0, 1.0]), (1, [0.0, 3.5]), (2, [0.5, -2.0]), (3, [1e-3]), (4, [0.0, 3.5]), (4, [0.0, 3.5]), (None, [1.0, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in exact_top_k(df.where("vec_id is null or vec_id <> 2"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 1, 896 * 256), (2, 4, 896 * 256), (3, 4, 896 * 256), (4, 50, 256 * 256), (5, 3, 0)]
    assert sorted(got[50]) == [(1, 1, 896 * 256), (2, 4, 896 * 256), (3, 4, 896 * 256), (4, 0, 256 * 256), (5, 3, 0)]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    # Moderately large components, beyond what doubles hold exactly, against Python's integers.
    rng = np.random.default_rng(1)
    x = [[float(v) for v in r] for r in rng.normal(size=(60, 4)) * 2e6]
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()}
    q = [[int(np.floor(256 * v)) for v in r] for r in x]
    for i in range(0, 60, 20):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(60) if j != i)[:5]
        assert [out[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def test_entities_are_whole_distinct_and_of_their_type(spark):
    from quern.llm.pii import pseudonymise

    texts = [
        "Mrs. García-López met Mr. O'Neil and Dr. Ann Lee.", "call +1 (443) 555-1000 now", "call +44 (443) 555-1000 now", "call 443-555-1000 now", "call +49 151 23456789 now",
        "call 0151 23456789 now", "card 4111 1111 1111 1111 x", "card 1234 5678 1234 5678 x", "to DE89 3704 0044 0532 0130 00 x", "at 10.1.2.3 or 192.168.7.9 or 172.20.0.1 or 8.8.8.8 x",
        "at 2001:db8:0:1::ff or fe80::1:abcd x", "key sk_abcdefghijklmnopqrst x", "key sk_abcdefghijklmnopqrsT x", "card 378282246310005 x", "it is 10:30:45 on 2024-05-06, 3:4", "Madame Ña-Ñb. Profit Drab",
    ]
    out = {r.doc_id: r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert re.fullmatch(r"Mrs\. \w+ met Mr\. \w+ and Dr\. \w+ \w+\.", out[0]) and not re.search("Garc|Neil|Lee|L.pez", out[0])
    number = lambda i: re.sub("[^0-9]", "", out[i])
    assert number(1)[0] == "1" and number(1)[1:] == number(3) and number(2)[:2] == "44" and number(2)[2:] != number(3)
    assert re.fullmatch(r"call \+49 \d{3} \d{8} now", out[4]) and re.fullmatch(r"call 0\d{3} \d{8} now", out[5]) and len({number(i) for i in (1, 2, 4, 5)}) == 4
    assert re.fullmatch(r"card( \d{4}){4} x", out[6]) and luhn(number(6)) == 0 and number(6) != "4111111111111111"
    assert luhn(number(13)) == 0 and number(13) != "378282246310005" and number(7) != "1234567812345678"
    iban = out[8][3:-2].replace(" ", "")
    assert iban[:2] == "DE" and iban[4:] != "370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"at 10(\.\d+){3} or 192\.168(\.\d+){2} or 172\.20(\.\d+){2} or \d+(\.\d+){3} x", out[9]) and "8.8.8.8" not in out[9]
    assert re.fullmatch(r"at 20[0-9a-f]{2}:[0-9a-f]{3}:[0-9a-f]:[0-9a-f]::[0-9a-f]{2} or fe[0-9a-f]{2}::[0-9a-f]:[0-9a-f]{4} x", out[10]) and "db8" not in out[10]
    assert out[11] != out[12] and out[11].startswith("key sk_") and "abcdefgh" not in out[11] + out[12]
    assert out[14] == texts[14] and out[15].endswith(". Profit Drab") and "Ñ" not in out[15]
    assert pseudonymise(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_and_null_ids_keep_their_texts(spark):
    from quern.llm.pii import pseudonymise

    rows = [(None, "a@b.cd one", 1), (None, "a@b.cd two", 2), (None, "a@b.cd one", 3), (7, "x 10.0.0.1", 4), (7, "x 10.0.0.1", 4), (7, "y 10.0.0.1", 5)]
    out = pseudonymise(spark.createDataFrame(rows, DOCS + ", h int"), keep=("h",)).collect()
    assert sorted(r.h for r in out) == [1, 2, 3, 4, 4, 5]
    mail = {r.text.split()[0] for r in out if r.h < 4}
    assert len(mail) == 1 and [r.text.split()[1] for r in sorted(out, key=lambda r: r.h)][:3] == ["one", "two", "one"]
    assert len({r.text.split()[1] for r in out if r.h > 3}) == 1


def shingles(w, n=5):
    k = min(n, len(w))
    out = {}
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        out[g] = out.get(g, 0) + 1
    return out


def similar(a, b):
    a, b = shingles(a, min(5, len(b))) if len(a) >= min(5, len(b)) else {}, shingles(b)
    i = sum(min(c, b.get(g, 0)) for g, c in a.items())
    return i / (sum(a.values()) + sum(b.values()) - i) if a else 0


def test_edited_items_are_found(spark):
    """Items planted with edits in 400 documents, a long one and short ones among them, against all windows."""
    from quern.llm.decontaminate import contaminated, recall_report

    r = random.Random(11)
    vocab = [f"v{i}" for i in range(300)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    items = {i: prose(r.choice([14, 20, 33, 33, 50, 59])) for i in range(30)}
    items |= {30: prose(900), 31: prose(3), 32: prose(1), 33: ["rep"] * 12, 34: items[3]}
    docs = {}
    for d in range(400):
        if d % 2:
            w = list(items[d % 30])
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = "edit"
            if d % 6 == 1:
                w.insert(len(w) // 2, "more")
            docs[d] = prose(r.randrange(0, 60)) + w + prose(r.randrange(0, 60))
        else:
            docs[d] = prose(r.randrange(0, 90))
    long = list(items[30])
    for at in (100, 400, 700):
        long[at] = "edit"
    docs |= {400: prose(50) + long + prose(2000), 401: ["rep"] * 11, 402: items[31] + prose(4), 403: []}
    want = {}
    for d, w in docs.items():
        for i, t in items.items():
            best = max((similar(w[s : s + len(t)], t) for s in range(max(len(w) - len(t), 0) + 1)), default=0) if w else 0
            if best >= 0.75:
                want[d, i] = best
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()] + [(None, "x"), (3, " ".join(docs[3])), (3, "other text")], DOCS)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(None, "x"), (40, None)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in contaminated(df, it).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got if want[k] == 1)
    assert len(got) >= 0.99 * len(want) and len(want) > 150 and (400, 30) in got and (401, 33) in want
    assert all(k in got for k, v in want.items() if v > 0.85)
    report = recall_report(df, it).first()
    assert report.held == len(want) and report.found == len(got)


def test_blocks_hold_all_fingerprints_within_the_radius():
    from quern.llm.decontaminate import BLOCK_BITS, _near

    r = random.Random(2)
    near = [set(x) for x in _near(60)]
    for _ in range(300):
        bits = r.sample(range(256), 60)
        blocks = [sum(1 << (b % BLOCK_BITS) for b in bits if b // BLOCK_BITS == i) for i in range(16)]
        assert any(x in near[i] for i, x in enumerate(blocks))
    least = [max(bin(x).count("1") for x in m) for m in near]
    assert sum(k + 1 for k in least) == 61
