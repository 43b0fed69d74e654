"""The learned, sampled and keyed operators against plain recomputations."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

r = random.Random(4)
WORDS = [f"w{i}" for i in range(200)]


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# Ordinal regression


def loss(w, t, x, y, decay):
    """The negative mean log likelihood of the cumulative link, written out grade by grade."""
    out = 0.0
    for row, g in zip(x, y):
        z = float(row @ w)
        above = [1.0, *[1 / (1 + math.exp(-(z - c))) for c in t], 0.0]
        out -= math.log(max(above[g] - above[g + 1], 1e-300))
    return out / len(y) + decay / 2 * float(w @ w)


@pytest.mark.parametrize("grades", [2, 3, 5])
def test_cumulative_link_is_at_the_least_loss(grades):
    from quern.llm._fit import Sparse
    from quern.llm.quality import fit_cumulative_link

    rng = np.random.default_rng(grades)
    x = rng.normal(size=(250, 4))
    cuts = np.linspace(-1.5, 1.5, grades - 1) if grades > 2 else np.array([0.3])
    y = ((x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.logistic(size=250))[:, None] > cuts).sum(1)
    decay = 1e-2
    rows = [(np.arange(4, dtype=np.int32), row.astype(np.float32)) for row in x]
    w, t = fit_cumulative_link(Sparse(rows, 4), y, grades, steps=1500, rate=0.02, decay=decay)
    w = w.astype(float)
    assert len(t) == grades - 1 and all(a < b for a, b in zip(t, t[1:]))
    best = loss(w, t, x, y, decay)
    p = np.concatenate((w, t))
    for i in range(len(p)):
        e = np.zeros(len(p))
        e[i] = 1e-4
        slope = (loss((p + e)[:4], (p + e)[4:], x, y, decay) - loss((p - e)[:4], (p - e)[4:], x, y, decay)) / 2e-4
        assert abs(slope) < 2e-3
    for _ in range(50):
        q = p + rng.normal(size=len(p)) * 0.1
        if all(a < b for a, b in zip(q[4:], q[5:])):
            assert loss(q[:4], q[4:], x, y, decay) >= best - 1e-6


def test_quality_of_four_grades_and_odd_rows(spark):
    from quern.llm.quality import expected_quality

    marks = ["", " dull", " dull fine", " fine fine bright"]
    rows = [(i, prose(30) + marks[i % 4] * 4, 1, 2.0) for i in range(400)] + [(900, None, 1, None), (901, "", 1, None), (None, "dull", 1, None), (5, prose(30), 1, None), (902, "fine " * 60_000, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, tail double")
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)] + [(None, 2), (7, None), (8, 0)], "doc_id long, g int")
    out = expected_quality(docs, labels, F.col("g"), 4, select_grade=2).collect()
    assert len(out) == len(rows) and all(0 <= x.expected_grade <= 3 and 0 <= x.tail <= 1 and x.keep == (x.tail >= 0.5) for x in out)
    held = [x for x in out if x.held_out and x.doc_id < 400]
    assert {x.doc_id for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.corrcoef([x.expected_grade for x in held], [x.doc_id % 4 for x in held])[0, 1] > 0.8
    assert {x.held_out for x in out if x.doc_id is None} == {None}
    assert expected_quality(docs.limit(0), labels, F.col("g"), 4).count() == 0
    blind = expected_quality(docs, labels.limit(0), F.col("g"), 4).collect()
    assert all(x.tail == 0.5 for x in blind)


# Toxicity


def test_toxicity_equals_a_plain_fit(spark):
    """Features as strings in a dictionary, the same ratios, and the same steps of the same loss, all dense."""
    from quern.llm.toxicity import SCALE, toxicity

    rows = [(i, f"{prose(12)} {'vile scum' if i % 3 == 0 and i % 7 else 'kind word'} {prose(5)}") for i in range(240)] + [(700, None), (701, "")]
    labels = {i: int(i % 3 == 0) for i in range(240) if i % 11}
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, predicted int, label string")
    out = {x.doc_id: x for x in toxicity(df, spark.createDataFrame([*labels.items(), (None, 1), (1, None)], "doc_id long, toxic int")).collect()}
    grams = {}
    for i, t in rows:
        b = b" " + (t or "").lower().encode() + b" "
        b = bytes(48 if 48 <= c < 58 else c for c in b)
        grams[i] = {b[k : k + n] for n in (5, 6) for k in range(len(b) - n + 1)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    train = sorted(i for i in labels if fold(i) != 2)
    y = np.array([labels[i] for i in train], float)
    count = {c: Counter(g for i in train if labels[i] == c for g in grams[i]) for c in (0, 1)}
    ratio = {}
    for g in set(count[0]) | set(count[1]):
        x = math.log((count[1][g] + 1) / (y.sum() + 2)) - math.log((count[0][g] + 1) / (len(y) - y.sum() + 2))
        if count[0][g] + count[1][g] >= 8 and abs(x) >= 1:
            ratio[g] = x
    used = sorted(ratio)
    dense = np.array([[SCALE * ratio[g] if g in grams[i] else 0.0 for g in used] for i, _ in rows])
    at = {i: k for k, (i, _) in enumerate(rows)}
    x = np.hstack((dense, np.ones((len(rows), 1))))
    xt = x[[at[i] for i in train]]
    w, m, v = (np.zeros(len(used) + 1) for _ in range(3))
    for k in range(1, 121):
        g = xt.T @ (1 / (1 + np.exp(-xt @ w)) - y) / len(y) + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    want = 1 / (1 + np.exp(-x @ w))
    assert used and max(abs(out[i].score - want[at[i]]) for i, _ in rows) < 1e-3
    assert all(out[i].held_out == (fold(i) == 2) and out[i].predicted == int(out[i].score >= 0.3) for i, _ in rows)


# Mixing


def place(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("most", [100_000, 2])
@pytest.mark.parametrize("options", [{"max_epochs": 3.0}, {"target_entropy": 1.0, "max_epochs": None}, {"max_epochs": 2.0, "budget": 900}, {"max_epochs": None, "budget": 20_000}])
def test_mixture_equals_a_recomputation(spark, monkeypatch, options, most):
    """With sources' totals in the driver, and with more sources than it takes."""
    from quern.llm import mixing
    from quern.llm.mixing import mix_sources, temperature_weights

    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    monkeypatch.setattr(mixing, "STEPS", 40)
    rows = [(i, prose(r.randrange(0, 30)), "a" if i % 9 else ("b" if i % 2 else None)) for i in range(260)] + [(260, None, "c"), (3, "same row", "a"), (3, "same row", "a"), (None, "x y", "c"), (None, "z", "c")]
    out = mix_sources(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, epoch int"), blocks=8, **options).collect()
    tokens = lambda t: len((t or "").split()) + 1
    totals = Counter()
    for _, t, s in rows:
        totals[s] += tokens(t)
    budget = options.get("budget") or sum(totals.values())
    power, weight = temperature_weights(totals, budget, options.get("target_entropy"), options.get("max_epochs"))
    shares = {s: (n / sum(totals.values())) ** power for s, n in totals.items()}
    assert all(math.isclose(weight[s], shares[s] / sum(shares.values())) for s in totals) and 0 <= power <= 1
    if options.get("target_entropy"):
        assert abs(-sum(w * math.log(w) for w in weight.values()) - 1.0) < 1e-6
    want = Counter()
    for s in totals:
        full, rest = divmod(round(weight[s] * budget), totals[s])
        blocks = defaultdict(list)
        for i, t, source in rows:
            if source == s:
                at = place("7", f"null:{t or ''}" if i is None else str(i))
                blocks[at % 8].append((at, i, tokens(t)))
        for epoch in range(full + 1):
            left = rest
            for rank, b in enumerate(sorted(blocks, key=lambda b: (place("7", s or "", str(epoch), str(b)), b)), 1):
                size = sum(x[2] for x in blocks[b])
                if epoch < full or size <= left:
                    take = blocks[b]
                elif left > 0:
                    take, upto = [], 0
                    for at in sorted({x[0] for x in blocks[b]}):
                        same = [x for x in blocks[b] if x[0] == at]
                        upto += sum(x[2] for x in same)
                        if upto > left:
                            break
                        take += same
                else:
                    take = []
                left -= size if epoch == full else 0
                for _, i, n in take:
                    want[i, s, epoch, rank, n] += 1
    assert Counter((x.doc_id, x.source, x.epoch, x.block_rank, x.tokens) for x in out) == want


# Surrogates


def test_names_equal_a_recomputation_with_collisions(spark):
    """Far more names than the lists hold: losers are drawn anew, and the smallest entity keeps its surrogate."""
    from quern.llm.pii import FIRST, pseudonymise

    names = sorted({"Mr. " + "".join(r.choice("abcdefgh") for _ in range(4)).capitalize() for _ in range(90)} | {"Mr. Adam", "Mr. Karl"})
    norms = {n: "m:" + n[4:].lower() for n in names}

    def surrogate(norm, attempt):
        h = hashlib.sha256(f"quern|name|{norm}|{attempt}".encode()).hexdigest()
        letters = (h + hashlib.sha256((h + "+").encode()).hexdigest()).translate(str.maketrans("0123456789", "ghijklmnop"))
        first = FIRST["latin_m"][int(h[:8], 16) % 20]
        return first + (" " + "".join(c for c in letters if c in "ghijklmnop")[:attempt].upper() if attempt else "")

    attempt = dict.fromkeys(norms.values(), 0)
    real = {n[2:] for n in attempt}
    while True:
        now = {n: surrogate(n, a) for n, a in attempt.items()}
        by = defaultdict(list)
        for n, s in now.items():
            by[s.lower()].append(n)
        lost = [n for s, ns in by.items() for n in ns if s in real or (len(ns) > 1 and n != min(ns))]
        if not lost:
            break
        for n in lost:
            attempt[n] += 1
    df = spark.createDataFrame([(i, f"x {n} y {n}.") for i, n in enumerate(names)], "doc_id long, text string")
    out = {x.doc_id: x.text for x in pseudonymise(df).collect()}
    assert max(attempt.values()) > 1 and len(set(now.values())) == len(names)
    assert all(out[i] == f"x Mr. {now[norms[n]]} y Mr. {now[norms[n]]}." for i, n in enumerate(names))


def test_very_long_texts(spark):
    """Texts of megabytes, with an entity at the end, through the operators that read whole texts."""
    from quern.llm.decontaminate import contaminated
    from quern.llm.pii import pseudonymise
    from quern.llm.toxicity import toxicity
    from quern.llm.warc import read_archives, write_archives

    item = prose(25)
    long = prose(60_000)
    rows = [(1, f"{long} {item} write to ann@mail.org", 1), (2, "x" * 2_000_000, 1), (3, None, 1), (None, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = {x.doc_id: x.text for x in pseudonymise(df).collect()}
    assert "ann@mail.org" not in out[1] and out[1].startswith(long) and out[2] == rows[1][1] and out[None] == long
    found = contaminated(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.start_word, x.similarity) for x in found] == [(1, 60_000, 1.0)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    scored = toxicity(df, labels).collect()
    assert len(scored) == 4 and all(0 <= x.score <= 1 for x in scored) and [x.held_out for x in scored if x.doc_id is None] == [None]
    back = read_archives(write_archives(df.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u")))).collect()
    assert sorted(x.payload_bytes for x in back) == sorted(len((t or "").encode()) for _, t, _ in rows)


def test_entities_of_very_many_parts(spark):
    """Names, addresses and numbers of as many parts as a long text has: no overflow, and what is around them stays."""
    from quern.llm.pii import pseudonymise

    n = 40_000
    odd = ["Dr. Ann" + "-Bo" * n, "a@" + "bc." * n + "com", "a." * n + "b@mail.org", "DE44" + " 1234" * n, "1" + "-234" * n, "1:" * n, "Mr. O" + "'a" * n + " Bo" + "-c" * n]
    df = spark.createDataFrame([(i, f"so {t} on") for i, t in enumerate(odd)], "doc_id long, text string")
    out = {x.doc_id: x.text for x in pseudonymise(df).collect()}
    assert len(out) == len(odd) and all(t.startswith("so ") and t.endswith(" on") for t in out.values())
    assert "Bo-Bo" not in out[0] and "b@mail" not in out[2] and "-c-c" not in out[6]
