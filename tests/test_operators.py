"""Operators that have no SQL counterpart, against brute force; sources, sinks and streams by round trips."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F


def test_decompose(spark):
    from quern.operators.rules import SHARES, decompose

    names, shares = list(SHARES), list(SHARES.values())
    rows = spark.range(0, 140).select("id", decompose(F.col("id"), F.lit(True)).alias("s"), decompose(F.col("id"), F.lit(False)).alias("z")).collect()
    for r in rows:
        n, want = r.id, [r.id * s // 100 for s in shares]
        for i in sorted(range(5), key=lambda i: (-(n * shares[i] % 100), i))[: n - sum(want)]:
            want[i] += 1
        for t in (3, 2, 4):
            if want[t] == 0 and n >= 3:
                donor = max((i for i in range(5) if i != t and want[i] > (i >= 2)), key=lambda i: (want[i], -i))
                want[donor], want[t] = want[donor] - 1, 1
        if n < 3:
            want = [0, 0, 0, int(n >= 1), int(n >= 2)]
        assert r.s == want and r.z == [0, n, 0, 0, 0], names


def test_pack_and_hard_split(spark):
    from quern.functions.texts import hard_split, pack

    rng = random.Random(1)
    texts = ["", "one", " ".join("w" * rng.randint(1, 30) for _ in range(300)), "x" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hard_split(F.col("t"), 100).alias("p"))
    for r in df.select("i", "p", pack(F.col("p"), 250, 60).alias("w")).collect():
        assert " ".join(r.p) == texts[r.i] and all(len(x) <= 100 or " " not in x for x in r.p)
        assert all(len(a) + 1 + len(b.split(" ")[0]) > 100 for a, b in zip(r.p, r.p[1:]))
        want = []
        for x in r.p:
            if want and sum(len(y) + 1 for y in want[-1]) + len(x) + 1 <= 250:
                want[-1].append(x)
            else:
                want.append([x])
        total = lambda w: sum(len(y) + 1 for y in w)
        if len(want) > 1 and total(want[-1]) < 60 and total(want[-1]) + total(want[-2]) <= 310:
            want[-2:] = [want[-2] + want[-1]]
        assert r.w == [" ".join(w) for w in want]


def test_components(spark):
    from quern.operators.graph import components

    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(comp) and {r.id: r.component for r in got} == comp
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked_precision(spark):
    from quern.operators.evaluation import best_boxes, ranked_precision

    rng = random.Random(3)
    box = lambda: (x := rng.randint(0, 6), y := rng.randint(0, 6), x + rng.randint(2, 9), y + rng.randint(2, 9))
    gold = [(c, u, i, *box()) for i, (c, u) in enumerate((rng.choice("ab"), rng.randint(0, 9)) for _ in range(60))]
    pred = [(c, u, i, rng.randint(0, 20) / 20, *box()) for i, (c, u) in enumerate((rng.choice("abz"), rng.randint(0, 11)) for _ in range(150))]
    g = spark.createDataFrame(gold, "label string, unit long, gold_id long, x1 int, y1 int, x2 int, y2 int")
    p = spark.createDataFrame(pred, "label string, unit long, pred_id long, score double, x1 int, y1 int, x2 int, y2 int")

    def iou(a, b):
        i = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    hits = {}
    for r in sorted(pred, key=lambda r: (-r[3], r[2])):
        hits[r[2]] = None
        free = [t for t in gold if t[:2] == r[:2] and t[2] not in hits.values() and iou(r[4:], t[3:]) >= 0.5]
        if free:
            hits[r[2]] = max(free, key=lambda t: (iou(r[4:], t[3:]), t[2]))[2]
    found = best_boxes(g, p, ["label", "unit"], ["x1", "y1", "x2", "y2"])
    assert {r.pred_id: r.hit for r in found.collect()} == {k: v is not None for k, v in hits.items()}
    got = {r.label: r.ap for r in ranked_precision(found, g, "label").collect()}
    for label in "ab":
        rows = sorted((r for r in pred if r[0] == label), key=lambda r: (-r[3], r[1], r[2]))
        n, tp, points = sum(t[0] == label for t in gold), 0, []
        for k, r in enumerate(rows, 1):
            tp += hits[r[2]] is not None
            points.append((tp, tp / k))
        want = [max((v for t, v in points if t * 100 >= i * n), default=0.0) for i in range(101)]
        assert got[label] == pytest.approx(sum(want) / 101)


def test_snapshot(spark, tmp_path):
    from quern.sources.snapshot import faults, write_jsonl, write_snapshot

    df = spark.createDataFrame([(i, None if i % 3 else f"v,{i}", i / 3, i % 2 == 0) for i in range(50)], "id long, s string, x double, b boolean")
    one = write_snapshot(spark, {"t": (df, "id"), "u": (df.select("id"), "id")}, str(tmp_path / "a"), 3)
    two = write_snapshot(spark, {"t": (df.repartition(7), "id"), "u": (df.select("id"), "id")}, str(tmp_path / "b"), 3)
    assert one == two and faults(spark, str(tmp_path / "a")).count() == 0
    part = sorted(Path(tmp_path / "a" / "t").glob("part-*"))[0]
    assert part.read_text().splitlines()[:3] == ["id,s,x,b", '0,"v,0",0.00,True', "1,,0.33,False"]
    part.write_text(part.read_text() + "99,,0.00,True\n")
    crc = part.with_name(f".{part.name}.crc")
    crc.unlink(missing_ok=True)
    assert [tuple(r) for r in faults(spark, str(tmp_path / "a")).select("member", "state").collect()] == [("t", "changed")]
    write_jsonl(df.limit(1), "id", str(tmp_path / "j"), 1)
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"b":true,"id":0,"s":"v,0","x":0.0}'


def test_stream_equals_batch(spark, tmp_path):
    from quern.streaming.ledger import by_hour

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    q = by_hour(spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*"), None)
    run = q.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    run.awaitTermination(100)
    key = lambda df: Counter((r.event_type, r.hour, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("hours")) == key(by_hour(events, None)) and spark.table("hours").count() > 0


def test_ledger_rows(spark):
    from quern.streaming.ledger import foreign_rows, log_rows

    m = spark.createDataFrame([("r", 1, {"loss": 0.5, "f1": None})], "run_id string, seed int, metrics map<string,double>")
    assert [tuple(r) for r in log_rows(m, ["run_id", "seed"]).collect()] == [("r", 1, "loss", 0.5)]
    rows = spark.createDataFrame([("r", 1, "c", "h"), ("r", None, "c", "h"), ("q", 1, "c", "h")], "run_id string, seed int, cell string, split_hash string")
    assert foreign_rows(rows, "r", 1, "c", "h").count() == 2


def test_runs_across_bins(spark):
    from quern.operators.ordered import run_starts

    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), x) for x in rng.sample(range(-200, 400), 300)] + [("b", 5)] * 3
    want, last = Counter(), {}
    for k, x in sorted(rows, key=lambda r: r[1]):
        start, before = last.get(k, (x, x))
        last[k] = (x if x - before > 3 else start, x)
        want[k, x, last[k][0]] += 1
    got = run_starts(spark.createDataFrame(rows, "k string, x long"), ["k"], "x", 3, 16).collect()
    assert Counter((r.k, r.x, r.run_start) for r in got) == want


def test_running_sums_with_null_keys(spark):
    from quern.operators.ordered import hash_place, quantile_cuts

    df = spark.createDataFrame([(i, None if i % 2 else "k") for i in range(101)], "i long, k string")
    for k in (None, "k"):
        got = sorted(r.place for r in hash_place(df, ["k"], "i", "s").collect() if r.k == k)
        assert got == list(range(1, len(got) + 1)) and len(got) == (51 if k else 50)
    assert quantile_cuts(df, "i", 4).first()["cuts"] == [25.0, 50.0, 75.0]
    assert quantile_cuts(df.limit(0), "i", 4).first()["cuts"] == []


def test_texts_with_nulls(spark):
    from quern.functions import texts as T

    t = F.lit(None).cast("string")
    r = spark.range(1).select(T.clean_reason(t).alias("a"), T.facets(t, {"n": "[0-9]"}).alias("b"), T.page_ranges(F.array(F.lit(9), F.lit(1), F.lit(3), F.lit(9)).cast("array<bigint>")).alias("c"), T.anchored_verdict(t, [("x", "OK")]).alias("d"), T.last_digits(F.lit("a12b7c")).alias("e")).first()
    assert tuple(r) == ("", [], ["1-3", "9-9"], None, "7")


def test_clean_reason_keeps_digits_at_ends(spark):
    from quern.functions import texts as T

    texts = ["0 first 0", " \n1<b> 1 \nx", "2\n2", "", "<br>\n \n2 third 2"]
    got = [r[0] for r in spark.createDataFrame(enumerate(texts), "i int, t string").orderBy("i").select(T.clean_reason(F.col("t"))).collect()]
    assert got == ["0 first 0", "1 1", "2", "", "2 third 2"]


def test_readers(spark, tmp_path):
    from quern.sources.tables import policy_view, read_chunks, read_commented_csv, read_side

    c = tmp_path / "c.csv"
    c.write_text("# made by hand\n# twice\na,b\n1,x\n2,\n")
    assert [tuple(r) for r in read_commented_csv(spark, str(c), "a int, b string").collect()] == [(1, "x"), (2, None)]
    j = tmp_path / "j.jsonl"
    j.write_text('{"_meta": {"v": 1}}\n{"id": "a", "t": "x"}\n{"id": "b", "t": null}\n')
    assert sorted(tuple(r) for r in read_chunks(spark, str(j), "id string, t string", "id").collect()) == [("a", "x"), ("b", None)]
    j.write_text('{"id": "a"}\n{"id": "a"}\n')
    with pytest.raises(ValueError, match="repeated"):
        read_chunks(spark, str(j), "id string", "id")
    j.write_text('{"_meta": 1}\n{"_meta": 2}\n')
    with pytest.raises(ValueError, match="header"):
        read_chunks(spark, str(j), "id string", "id")
    s = tmp_path / "s.csv"
    s.write_text("image_id,stratum,G_h,n_h\ni1,a,3,2\ni2,a,3,2\ni3,b,1,1\n")
    assert read_side(spark, str(s)).count() == 3
    for bad in ("i1,a,3,4\n", "i1,a,3,2\ni2,a,3,1\n", "i1,a,3,2\ni1,a,3,2\n"):
        s.write_text("image_id,stratum,G_h,n_h\n" + bad)
        spark.catalog.clearCache()
        with pytest.raises(ValueError):
            read_side(spark, str(s))
    df = spark.createDataFrame([("i", "eval", 1), ("j", "train", 2)], "id string, split string, n int")
    assert [tuple(r) for r in policy_view(df, ["id", "n"], ["train"], "eval", ["id"]).collect()] == [("j", 2)]
    with pytest.raises(ValueError, match="not shown"):
        policy_view(df, ["id", "n"], ["train", "eval"], "eval", ["id"])
