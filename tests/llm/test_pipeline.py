"""The stages of the corpus pipeline against what brute force keeps, each judged on its own input."""

import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
rng = random.Random(8)
WORDS = [f"w{i}" for i in range(500)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    item, base = prose(40), prose(150)
    near = base.split()
    near[75] = "other"
    out = [(i, prose(60) + (" moron idiot scum" if i % 4 == 1 else "")) for i in range(320)]
    out += [(400, base), (401, base), (402, " ".join(near)), (403, prose(50) + " " + item + " " + prose(30)), (404, None), (405, ""), (406, f"write to ann{7}@mail.org now " + prose(30)), (407, f"again ann{7}@mail.org " + prose(30))]
    return item, [(i, t, "en", "big" if i % 3 else "small", None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    item, docs = rows()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(320)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}


def test_stages(spark, folder):
    import corpus_pipeline as p

    sf_dir, docs = folder
    stage = dict(p.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    df = spark.createDataFrame(docs, DOCS)
    ids = {r[0] for r in docs}

    kept = stage["toxicity"](spark, df, sf_dir)
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if i >= 320 or i % 4 != 1)

    later = set()
    sets = {i: shingles(t) for i, t, *_ in docs}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                later.add(b)
    out = stage["near_duplicates"](spark, df, sf_dir)
    assert later == {401, 402} and out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(ids - later)

    out = stage["decontamination"](spark, df, sf_dir)
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(ids - {403})

    got = {r.doc_id: r for r in stage["pii"](spark, df, sf_dir).collect()}
    old = {r[0]: r for r in docs}
    assert set(got) == ids and all(tuple(got[i])[2:4] == old[i][2:4] for i in ids)
    assert all(got[i].text == old[i][1] for i in ids - {406, 407})
    mails = [re.search(r"\S+@\S+", got[i].text).group() for i in (406, 407)]
    assert mails[0] == mails[1] != "ann7@mail.org" and got[406].n_chars == len(got[406].text)


def test_whole_run(spark, folder):
    import corpus_pipeline as p

    sf_dir, docs = folder
    out = p.run(spark, sf_dir).collect()
    found = {r.doc_id for r in out}
    assert found and not found & ({i for i in range(320) if i % 4 == 1} | {401, 402, 403})
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out) and all(0 <= r.epoch < 4 for r in out)
    assert not any("ann7@mail.org" in (r.text or "") for r in out)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_clashing_names(spark):
    """Columns named like an operator's own, beside those it reads, change nothing."""
    from pyspark.sql import functions as F

    from quern.llm.chat import canonical_turns, format_turns, read_back
    from quern.llm.decontaminate import contaminated
    from quern.llm.mixing import mix_sources
    from quern.llm.ngram_join import near_duplicates
    from quern.llm.pii import pseudonymise
    from quern.llm.substring_dedup import dedup_passages
    from quern.llm.topk import exact_top_k
    from quern.llm.warc import read_archives, write_archives

    item, docs = rows()
    df = spark.createDataFrame(docs[-30:], DOCS)
    names = ["w", "words", "h", "id", "k", "n", "value", "block", "key", "kind", "norm", "surrogate", "tokens", "epoch", "component_id", "n_shingles", "score", "rank", "kept", "n_words", "text_", "part", "pos", "item_id", "hash", "conv", "payload"]
    wide = df.select("*", *[F.lit(1).alias(c) for c in names])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = lambda f: sorted(map(str, f(df).collect())) == sorted(map(str, f(wide).collect()))
    for f in (near_duplicates, dedup_passages, pseudonymise, lambda x: contaminated(x, items), lambda x: mix_sources(x, max_epochs=2.0)):
        assert same(f)
    turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    more = turns.select("*", *[F.lit("x").alias(c) for c in ("turns", "formatted", "content", "fingerprint", "mapping")])
    chat = lambda x: sorted(map(str, read_back(format_turns(canonical_turns(x))).collect()))
    assert chat(turns) == chat(more)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    web = lambda x: sorted(str((r.record_id, r.payload_digest, r.refers_to)) for r in read_archives(write_archives(x)).collect())
    assert web(pages) == web(pages.select("*", *[F.lit("x").alias(c) for c in names]))
    vectors = df.select(F.col("doc_id").alias("vec_id"), F.array(*[(F.hash("doc_id", F.lit(i)) % 100 / 100).cast("float") for i in range(8)]).alias("embedding"))
    top = lambda x: sorted(map(str, exact_top_k(x, F.col("vec_id") % 10 == 0).collect()))
    assert top(vectors) == top(vectors.select("*", *[F.lit(1).alias(c) for c in names if c != "vec_id"]))


def test_near_duplicate_stage_judges_each_text(spark):
    """Ids of several texts, null ids, repeated rows that differ in language, and null texts."""
    import corpus_pipeline as p

    base, other, third = prose(120), prose(120), prose(90)
    near = base.split()
    near[60] = "edited"
    rows = [
        (1, base, "en", "a", 1), (5, " ".join(near), "en", "a", 2), (5, other, "de", "a", 3), (7, base.upper(), "en", "b", 4), (8, third, "fr", "b", 5), (8, third, "de", "c", 6), (8, third, None, "c", 6),
        (9, None, "en", "a", None), (9, None, "en", "a", None), (10, "", "en", "a", 0), (None, base, "en", "a", 7), (None, base, "en", "a", 7), (None, None, "x", None, None),
    ]
    got = sorted(map(str, (tuple(r) for r in p.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect())))
    want = [rows[0], rows[2], rows[6], rows[7], rows[9], rows[10], rows[11], rows[12]]
    assert got == sorted(map(str, want))
    once = [r for r in rows if r[0] not in (None, 5, 8, 9)]
    got = sorted(map(str, (tuple(r) for r in p.drop_near_duplicates(spark, spark.createDataFrame(once, DOCS), "").collect())))
    assert got == sorted(map(str, [rows[0], rows[9]]))


def test_stages_carry_odd_rows(spark, tmp_path):
    """Null ids, null and repeated rows and clashing columns through all stages."""
    from pyspark.sql import functions as F

    import corpus_pipeline as p

    item, docs = rows()
    docs = docs[300:] + [(None, None, None, None, None), (None, prose(30), "en", "big", 9), (None, prose(30), "en", "big", 9), docs[310], docs[310]]
    df = spark.createDataFrame(docs, DOCS).select("*", *[F.lit(1).alias(c) for c in ("score", "predicted", "component_id", "number", "h", "k", "found", "tokens", "epoch")])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(300, 320)] + [(None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == COLUMNS, name
    out = kept.collect()
    assert sum(r.doc_id is None for r in out) == 3 and len([r for r in out if r.doc_id == 310]) == 1
    mixed = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in out} and any(r.doc_id is None for r in mixed)
