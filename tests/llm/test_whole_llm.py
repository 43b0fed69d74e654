"""The llm operators do the whole job: all links, all entities."""

import random

import pytest
from pyspark.sql import functions as F


def _grams(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("block", [1 << 18, 400])
def test_all_links(spark, monkeypatch, block):
    """Edited copies of a text, of many sizes, with copies of some of them: every link counts, in one block and in many."""
    from quern.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(3)
    rows = []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(90)]
        for k in range(14):
            w = words[: 90 - 5 * (k % 7)]
            w[r.randrange(len(w))] = f"x{k}"
            rows.append((100 * base + k, " ".join(w)))
    rows += [(50, rows[1][1]), (51, rows[1][1].upper()), (52, rows[20][1]), (50, rows[1][1]), (60, "alone " * 3), (61, None)]
    texts = dict(rows)
    sets = {i: _grams(t) for i, t in texts.items() if t and _grams(t)}
    want = {i: sum(4 * len(a & b) >= 3 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()} | {60: 0, 61: 0}
    got = {x.doc_id: x.verified_links for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and max(want.values()) > 3


def test_hint_loses_no_entity(spark):
    """Each kind of entity, secrets of letters only among them, passes the prefilter and is replaced."""
    from quern.llm.pii import ANY, HINT, pseudonymise

    titles = "Mr Mrs Ms Miss Herr Frau Señor Señora Monsieur Madame Господин Госпожа".split()
    secrets = [p + s + "ABCDEFGHIJKLMNOP" for p in ("sk", "pk", "ghp", "AKIA") for s in ("", "_", "-")] + ["abcdefABCDEF" * 3]
    found = [f"{t} Анна" for t in titles] + secrets + ["a@b.cd", "1234 5678 1234 5678", "555-123-4567", "123-45-6789", "10.0.0.1"]
    rows = [(i, f"token {x} here") for i, x in enumerate(found)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where(F.col("text").rlike(ANY)).count() == len(rows)
    assert df.where(F.col("text").rlike(ANY) & ~F.col("text").rlike(HINT)).count() == 0
    out = {r.doc_id: r for r in pseudonymise(df).collect()}
    assert all(out[i].n_entities == 1 and found[i] not in out[i].text for i, _ in rows)
