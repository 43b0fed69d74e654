"""Kernels and queries without SQL, against plain loops; archives and published tables by round trips."""

import hashlib
import itertools
import json
import math
import random
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern import catalog

DIR = "/root/testdata/sf0.001"


def columns(table, *names):
    t = pq.read_table(f"{DIR}/{table}.parquet", columns=list(names))
    return list(zip(*[t[n].to_pylist() for n in names]))


def most(pairs, value=None):
    """The best total over all sets of pairs in which nothing occurs twice."""
    if not pairs:
        return 0
    (g, p, *v), rest = pairs[0], pairs[1:]
    return max(most(rest, value), (v[0] if v else 1) + most([x for x in rest if x[0] != g and x[1] != p], value))


def test_matchings_are_largest():
    from quern.operators.matching import augmenting, best_total

    r = random.Random(4)
    for _ in range(150):
        pairs = r.sample(list(itertools.product(range(5), "abcde")), r.randint(0, 11))
        held = augmenting(pairs)
        assert len(held) == most(pairs) and set(held) <= set(pairs)
        assert len({g for g, _ in held}) == len({p for _, p in held}) == len(held)
        valued = [(g, p, r.choice([0.25, 0.5, 0.75, r.random()])) for g, p in pairs]
        best = best_total(valued)
        assert sum(v for _, _, v in best) == pytest.approx(most(valued)) and set(best) <= set(valued)
        assert len({g for g, _, _ in best}) == len({p for _, p, _ in best}) == len(best)


def test_boxes_of_a_unit_are_matched_at_once(spark):
    """A greedy pass takes the pair that two others need; the largest matching does not."""
    from quern.operators.matching import assignments, max_matching

    box = lambda x, w: (float(x), 0.0, float(x + w), 10.0)
    gold = [("u", "k", 1, *box(0, 10)), ("u", "k", 2, *box(3, 10)), ("v", "k", 3, *box(0, 10))]
    pred = [("u", "k", 1, *box(2, 10)), ("u", "k", 2, *box(5, 10)), ("v", "j", 3, *box(0, 10))]
    g = spark.createDataFrame(gold, "unit string, label string, gold_id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(pred, "unit string, label string, pred_id long, x1 double, y1 double, x2 double, y2 double")
    assert [(r.unit, r.label, r.matched) for r in max_matching(g, p, ["unit", "label"]).collect() if r.matched] == [("u", "k", 2)]
    assert sorted((r.gold_id, r.pred_id) for r in assignments(g, p, ["unit", "label"]).collect()) == [(1, 1), (2, 2)]


def test_quantiles_equal_printed_tables():
    from quern.operators.resampling import c4, chi2_quantile

    for p, df, want in ((0.95, 10, 18.307038), (0.025, 4, 0.484419), (0.975, 4, 11.143287), (0.5, 1, 0.454936), (0.99, 100, 135.806723)):
        assert chi2_quantile(p, df) == pytest.approx(want, abs=2e-6)
    assert c4(2) == pytest.approx(0.797885, abs=1e-6) and c4(10) == pytest.approx(0.972659, abs=1e-6)


def correlation(a, b, least):
    h, w = a.shape
    best = None
    for dy, dx in itertools.product(range(1 - h, h), range(1 - w, w)):
        cells = [(y, x) for y in range(h) for x in range(w) if 0 <= y - dy < h and 0 <= x - dx < w]
        p, q = np.array([a[c] for c in cells]), np.array([b[y - dy, x - dx] for y, x in cells])
        if len(cells) < least * h * w or p.std() * q.std() * len(cells) <= 1e-9:
            continue
        r = float(((p - p.mean()) * (q - q.mean())).sum() / (p.std() * q.std() * len(cells)))
        if best is None or r > best[0] + 1e-12 or (abs(r - best[0]) <= 1e-12 and (abs(dy) + abs(dx), dy, dx) < best[1]):
            best = r, (abs(dy) + abs(dx), dy, dx)
    return (None, 0, 0) if best is None else (best[0], best[1][2], best[1][1])


def test_correlation_peaks(spark):
    vectors = {i: np.array(v, float).reshape(4, -1) for i, v in columns("embeddings", "vec_id", "embedding") if v is not None}
    got = {r.vec_id: r for r in catalog.QUERIES["correlation_peaks"](spark, DIR).collect()}
    assert set(got) == {i for i in vectors if i + 1 in vectors}
    for i in sorted(got)[:25]:
        peak, dx, dy = correlation(vectors[i], vectors[i + 1], 0.25)
        assert (got[i].dx, got[i].dy) == (dx, dy) and got[i].peak == pytest.approx(peak, abs=1e-8)


def test_source_splits(spark):
    """No more than the share, no document above its cap, and no lineage left out that would still fit before the giving back."""
    counts = defaultdict(Counter)
    for c, p in columns("orders", "o_custkey", "o_orderpriority"):
        counts[c % 97][p] += 1
    split = {r.lineage: r.split for r in catalog.QUERIES["source_splits"](spark, DIR).collect()}
    rank = {g: hashlib.sha256(f"s|{g}".encode()).hexdigest() for g in counts}
    target = math.floor(0.2 * sum(sum(c.values()) for c in counts.values()) + 0.5)
    val: list = []
    total = lambda gs: sum((counts[g] for g in gs), Counter())
    for g in sorted(counts, key=lambda g: (rank[g], g)):
        now = total([*val, g])
        if sum(now.values()) <= target and max(now.values()) <= 0.25 * target:
            val.append(g)
    while val and max(total(val).values()) > 0.25 * sum(total(val).values()):
        top = max(total(val).items(), key=lambda x: (x[1], x[0]))[0]
        val.remove([g for g in val if counts[g][top]][-1])
    assert set(split) == set(counts) and {g for g, s in split.items() if s == "val"} == set(val)


def test_greedy_component_split(spark):
    people = columns("customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = len(people)
    nation = {c: g for c, g, _ in people}
    edges = {(c, (c * 7 + 13) % n) for c, in columns("orders", "o_custkey")}
    between = Counter(tuple(sorted((nation[a], nation[b]))) for a, b in edges if a in nation and b in nation and nation[a] != nation[b])
    root = {g: g for g in nation.values()}
    for _ in root:
        for (a, b), k in between.items():
            if k >= 2:
                root[a] = root[b] = min(root[a], root[b])
    held = defaultdict(Counter)
    for _, g, s in people:
        held[root[g]][s] += 1
    want = {s: 0.2 * sum(c[s] for c in held.values()) for s in {s for _, _, s in people}}
    got, taken = Counter(), []
    for c in sorted(held, key=lambda c: (-sum(held[c].values()), str(c))):
        cost = [sum((x[s] - w) ** 2 for s, w in want.items()) for x in (got, got + held[c])]
        if cost[1] < cost[0]:
            taken.append(c)
            got += held[c]
    assert sorted(r[0] for r in catalog.QUERIES["greedy_component_split"](spark, DIR).collect()) == sorted(taken)


def largest_face(ring, h=0.25):
    """Area of the largest set of sample points inside an odd number of times that are linked without meeting an edge."""
    xs, ys = np.arange(h / 2, 80, h), np.arange(h / 2, 40, h)
    px, py = np.meshgrid(xs, ys)
    inside, right, down = np.zeros(px.shape, bool), np.ones(px.shape, bool), np.ones(px.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
        if ay != by:
            at = ax + (py - ay) * (bx - ax) / (by - ay)
            rows = (ay > py) != (by > py)
            inside ^= rows & (px < at)
            right &= ~(rows & (px < at) & (px + h >= at))
        if ax != bx:
            at = ay + (px - ax) * (by - ay) / (bx - ax)
            down &= ~(((ax > px) != (bx > px)) & (py < at) & (py + h >= at))
    seen, best = ~inside, 0
    for start in zip(*np.nonzero(inside)):
        if seen[start]:
            continue
        seen[start], todo, n = True, [start], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for (v, u), open_ in (((y, x + 1), right[y, x]), ((y, x - 1), x > 0 and right[y, x - 1]), ((y + 1, x), down[y, x]), ((y - 1, x), y > 0 and down[y - 1, x])):
                if open_ and 0 <= v < len(ys) and 0 <= u < len(xs) and not seen[v, u]:
                    seen[v, u] = True
                    todo.append((v, u))
        best = max(best, n)
    return best * h * h


def test_polygon_shapes(spark):
    """Areas against sample points, boxes around them, and the circle of the same area."""
    points = defaultdict(list)
    for o, n, p, s, t, d in columns("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_discount"):
        points[o].append((n, p % 97 - 5 + float(t), s % 53 - 3 + float(d)))
    got = {r.id: r for r in catalog.QUERIES["polygon_shapes"](spark, DIR).collect()}
    assert set(got) == set(points)
    for o, r in got.items():
        assert r.valid or r.area is None
        assert (len(points[o]) < 3) == (r.flags == "too_few_points")
    valid = sorted(o for o, r in got.items() if r.valid)
    crossing = [o for o in valid if "self_intersect" in got[o].flags]
    assert crossing and len(valid) > len(crossing)
    for o in valid[:25] + crossing[:25]:
        r = got[o]
        ring = np.clip(np.array([q[1:] for q in sorted(points[o])], float), 0, [80, 40])
        length = np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum()
        assert abs(largest_face(ring) - r.area) <= 0.08 * length + 1, o
        assert r.equivalent == pytest.approx(math.sqrt(4 * r.area / math.pi)) and r.area <= r.major * r.minor + 1e-6
        assert (r.x2 - r.x1) * (r.y2 - r.y1) >= r.area - 1e-6 and 0 <= r.x1 < r.x2 <= 80 and 0 <= r.y1 < r.y2 <= 40
        if o not in crossing:
            x1, y1, x2, y2 = *np.floor(ring.min(0)), *np.ceil(ring.max(0))
            assert (r.x1, r.y1) == (min(x1, 79), min(y1, 39)) and r.x2 >= x2 and r.y2 >= y2


def test_published_once_and_by_content(spark, tmp_path):
    from quern.sources.snapshot import content_digest, publish

    a = spark.createDataFrame([(1, "x", True), (2, "", None), (3, None, False), (3, None, False)], "k long, t string, b boolean")
    d = content_digest(a)
    assert d == content_digest(a.repartition(7)) != content_digest(a.distinct())
    path = str(tmp_path / "t")
    assert publish(a, "k", path) == d
    with pytest.raises(Exception):
        publish(a.limit(1), "k", path)
    lines = [line for p in sorted((tmp_path / "t").glob("part-*")) for line in p.read_text().splitlines()[1:]]
    assert sorted(line.split(",")[0] for line in lines) == ["1", "2", "3", "3"]


def test_members_of_archives(spark, tmp_path):
    from quern.sources.records import zip_records

    with pytest.raises(Exception):
        zip_records(spark, str(tmp_path), "a int").collect()
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for name, content in {"a.json": b'{"a": 1}', "d/b.JSON": b"\xef\xbb\xbf{}", "c.json": b"[1]", "d.json": b'{"a": "\xff"}', "e.txt": b"{}", "f.json": b"{"}.items():
            z.writestr(name, content)
    got = {r.member: (r.archive, r.fault, r.text) for r in zip_records(spark, str(tmp_path), "a int").collect()}
    one = lambda fault, text=None: ("one.zip", fault, text)
    assert got == {"a.json": one(None, '{"a": 1}'), "d/b.JSON": one(None, "{}"), "c.json": one("no object"), "d.json": one("unreadable"), "f.json": one("unreadable")}


def test_strict_lines(spark, tmp_path):
    from quern.sources.records import strict_jsonl

    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": null}\n')
    assert [r.a for r in strict_jsonl(spark, str(p), "a int").collect()] == [1, None]
    for line in ("", '{"a": 1, "a": 2}', '{"a": NaN}', "[1]", "{"):
        p.write_text(f'{{"a": 1}}\n{line}\n{{"a": 2}}\n')
        with pytest.raises(Exception):
            strict_jsonl(spark, str(p), "a int", blank_ok=False).collect()


def test_one_version_only(spark):
    from quern.sources.records import one_version

    good = {"schema_version": "1.3", "image_id": "i", "cell": "c", "seed": 1, "parse_ok": True}
    lines = lambda *rows: spark.createDataFrame(list(enumerate(json.dumps(r) for r in rows)), "k long, t string")
    assert one_version(lines(good, good), "k", "t") == "1.3"
    newer = good | {"schema_version": "1.4", "gen_stop": "eos", "n_new_tokens": 1, "coord_space": "x"}
    for rows in ((good, newer), (good, {"schema_version": "1.3"}), ([],)):
        with pytest.raises(ValueError):
            one_version(lines(*rows), "k", "t")


def test_census_of_odd_texts(spark):
    from quern.sources.records import census

    df = spark.createDataFrame([(None,), ("",), ("3",), ("[]",), ('[{"a": []}, {"a": [[1]]}]',), ("[" * 100_000,)], "j string")
    got = {(r.what, r.path, r.kind): (r.n, r.least, r.most, r.samples) for r in census(df, "j").collect()}
    assert got == {
        ("broken", None, None): (3, None, None, None), ("leaf", "", "int"): (1, None, None, ["3"]), ("list", "[]", None): (2, 0, 2, None), ("key", "[].a", None): (2, None, None, None),
        ("list", "[].a[]", None): (2, 0, 1, None), ("list", "[].a[][]", None): (1, 1, 1, None), ("leaf", "[].a[][]", "int"): (1, None, None, ["1"]),
    }
    assert census(df.limit(0), "j").count() == 0


def test_shares():
    from quern.functions.scalars import fraction

    assert fraction(1) == 1.0 and fraction(0.25) == 0.25
    for f in (0, -0.1, 1.1, True, "1", math.nan):
        with pytest.raises(ValueError):
            fraction(f)


def test_snapshot_views(spark):
    """What a receipt allows and what is refused; a changed, a new or a lost part refuses everything."""
    from pathlib import Path

    from quern.plans.snapshots import _snapshot
    from quern.sources import catalog as C

    path = _snapshot(spark, DIR)
    snap = C.load_snapshot(spark, path)
    images = snap.images.select("image_id", "split", "rel_path").collect()
    of = lambda s: spark.createDataFrame([(r.image_id,) for r in images if r.split == s], "image_id string")
    held = {r.image_id for r in images if r.split == "eval"}
    receipt, log = {"kind": "main", "snapshot_digest": snap.digest}, []
    want = sorted(r.ann_id for r in snap.defects.collect() if r.image_id in held)
    assert want and sorted(r.ann_id for r in C.eval_defects(spark, path, of("eval"), receipt, log).collect()) == want
    assert {r.image_id for r in C.eval_paths(spark, path, of("eval"), receipt, log).collect()} == held
    for call, ids, seal in (
        (C.eval_defects, of("eval"), receipt | {"kind": "pilot"}), (C.eval_defects, of("eval"), receipt | {"snapshot_digest": "0"}), (C.eval_defects, of("train"), receipt), (C.eval_defects, of("none"), receipt),
        (C.eval_paths, of("train"), receipt), (C.eval_paths, of("eval"), {}),
    ):
        with pytest.raises(PermissionError):
            call(spark, path, ids, seal, log)
    assert [x["allowed"] for x in log] == [True] * 2 + [False] * 6
    for ids in (of("eval"), of("train").union(of("eval").limit(1)), spark.createDataFrame([("nobody",)], "image_id string")):
        with pytest.raises(ValueError):
            C.defects_of(spark, path, ids)
    with pytest.raises(ValueError):
        C.image_columns(spark, path, ["image_id", "has_defect"], ["eval"])
    part = sorted(Path(path, "images").glob("part-*"))[0]
    kept = part.read_bytes()
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    for change in (lambda: part.write_bytes(kept + b"\n"), lambda: part.unlink(), lambda: Path(path, "images", "part-09999-x.csv").write_bytes(kept)):
        change()
        with pytest.raises(ValueError):
            C.load_snapshot(spark, path)
        part.write_bytes(kept)


def test_images_below_a_folder(spark, tmp_path):
    from quern.sources.catalog import found_images

    for name in ("a/x_1_2.png", "a/y.JPG", "b/c/z-03-4.bmp", "b/note.txt"):
        (tmp_path / "set" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / name).write_bytes(b"x")
    got = sorted(tuple(r) for r in found_images(spark, str(tmp_path / "set")).collect())
    assert got == [("set/a/x_1_2.png", "a", "x"), ("set/a/y.JPG", "a", None), ("set/b/c/z-03-4.bmp", "c", "z")]
    (tmp_path / "set" / "Train").mkdir()
    (tmp_path / "set" / "Train" / "q.png").write_bytes(b"x")
    with pytest.raises(Exception):
        found_images(spark, str(tmp_path / "set")).collect()


def test_what_metadata_predicts(spark):
    """A class that one feature gives away scores 1; one that no feature tells of scores about as a coin does."""
    from quern.operators.reports import metadata_probe

    r = random.Random(2)
    rows = [(float(i % 2), r.random(), float(r.random() > 0.3), float(i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "w double, n double, coin double, told double")
    train, test = df.limit(400), df.subtract(df.limit(400))
    got = lambda classes, gate: metadata_probe(train, test, "id", ["w", "n"], classes, gate).first()
    assert got({"t": "told"}, 0.5) == (1.0, False)
    coin, passed = got({"c": "coin"}, 0.99)
    assert 0.4 < coin < 0.95 and passed
    both, unjudged = got({"t": "told", "c": "coin"}, None)
    assert both == pytest.approx((1 + coin) / 2) and unjudged is None


def test_refused_reports(spark):
    from quern.operators.reports import differences, for_training, one_model

    recs = lambda *rows: spark.createDataFrame(list(rows), "unit string, cell string, seed int")
    assert one_model(recs(("a", "c", 1), ("b", "c", 1)), "unit", ["cell", "seed"]).count() == 2
    for bad in (recs(("a", "c", 1), ("b", "c", 2)), recs(("a", "c", 1), ("a", "c", 1))):
        with pytest.raises(ValueError):
            one_model(bad, "unit", ["cell", "seed"])
    images = spark.createDataFrame([("a", "train"), ("b", "eval"), ("c", "train"), ("c", "eval")], "unit string, split string")
    defects = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "unit string, box int, notes string")
    assert [tuple(r) for r in for_training(images, defects, "unit", "split", "eval", ["unit", "box"], ("notes",)).collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        for_training(images, defects, "unit", "split", "eval", ["unit", "notes"], ("notes",))
    with pytest.raises(ValueError):
        for_training(images, defects.union(spark.createDataFrame([("c", 3, "z")], defects.schema)), "unit", "split", "eval", ["unit"], ())
    with pytest.raises(ValueError):
        differences(images, defects)


def test_gaps_of_repeated_numbers(spark):
    from quern.operators.reports import gap_report

    r = random.Random(9)
    groups = {g: sorted(r.choices(range(0, 200_000, 7) if g == "wide" else range(40), k=n)) for g, n in (("wide", 300), ("few", 12), ("many", 90), ("one", 1), (None, 20))}
    df = spark.createDataFrame([(g, i) for g, ids in groups.items() for i in ids] + [("few", None)], "g string, id long")
    got = {x.g: x for x in gap_report(df, ["g"], "id").collect()}
    assert set(got) == set(groups)
    for g, ids in groups.items():
        steps = [b - a for a, b in zip(ids, ids[1:])]
        runs = [len(list(x)) for _, x in itertools.groupby(range(len(ids)), key=lambda i: sum(s != 1 for s in steps[:i]))]
        small = [s - 1 for s in steps if 1 < s <= 21]
        x = got[g]
        assert (x.n, x.dup_ids, x.gaps, x.gaps_over) == (len(ids), len(ids) - len(set(ids)), sum(s > 1 for s in steps), sum(s > 21 for s in steps))
        assert (x.runs, list(x.run_top)) == (len(runs), sorted(runs, reverse=True)[:5]) and x.p == pytest.approx(sum(small) / (len(ids) + sum(small)), abs=6e-5)
        assert x.shares == ([pytest.approx(small.count(k) / len(small), abs=6e-5) for k in (1, 2, 3)] if small else None)


def test_parts_of_skewed_numbers(spark):
    """Parts rise with the value and hold few rows however the values lie; infinities, NaN and nulls have their place."""
    from quern.operators.ordered import spread

    r = random.Random(7)
    values = [math.exp(r.gauss(0, 8)) * r.choice([-1, 1]) for _ in range(20_000)] + [1e300, -1e300, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, None] + [5.0] * 4_000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wide, part = spread(df, "v")
    got = [(x.v, x.p) for x in wide.select("v", part.alias("p")).collect()]
    assert wide.columns == ["v", "_spread"] and Counter(v for v, _ in got if v == v) == Counter(v for v in values if v == v)
    place = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    parts = [p for _, p in sorted(got, key=lambda x: place(x[0]))]
    assert parts == sorted(parts) and max(Counter(p for v, p in got if v != 5.0).values()) <= 2 * 24_000 / 256
    for odd in ([], [None], [math.nan, math.inf], [3.0], [2.0, 2.0, None]):
        wide, part = spread(spark.createDataFrame([(v,) for v in odd], "v double"), "v")
        rows = sorted(((place(x.v), x.p) for x in wide.select("v", part.alias("p")).collect()), key=lambda x: x[0])
        assert [p for _, p in rows] == sorted(p for _, p in rows) and len(rows) == len(odd)
    wide, part = spread(spark.createDataFrame([(2**62 + i,) for i in range(2000)], "v long"), "v")
    rows = [x.p for x in wide.orderBy("v").select(part.alias("p")).collect()]
    assert rows == sorted(rows)


def test_unit_vectors_of_many_components(spark):
    """A mean or length that is worked out again for each element takes minutes here."""
    import time

    from quern.operators.kernels import unit_vectors

    rows = [np.sin(np.arange(1, 1201) * (i + 1)).tolist() for i in range(4)] + [[2.0] * 1200]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v array<double>").coalesce(1)
    began = time.time()
    got = [r[0] for r in df.orderBy("i").select(unit_vectors(F.col("v"))).collect()]
    assert time.time() - began < 30
    for x, v in zip(rows, got):
        c = np.array(x) - np.mean(x)
        assert np.allclose(v, c / np.linalg.norm(c) if np.linalg.norm(c) >= 1e-3 else 0, atol=1e-12)


def _scores_checked(spark, monkeypatch, n):
    """Random vectors with ties and copies; sorts longer than what can be among the best are counted."""
    from quern.operators import kernels as K

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (n, 4)).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    monkeypatch.setattr(K, "PIECE", 64)
    monkeypatch.setattr(K, "BLOCK", 200)
    return df, v, np.round(v @ v.T, 12)


def test_nearest_keeps_the_best_of_all_pieces(spark, monkeypatch):
    from quern.operators import kernels as K

    df, v, s = _scores_checked(spark, monkeypatch, 700)
    got = defaultdict(dict)
    for r in K.nearest(df, "id", "v", 3).collect():
        got[r.a][r.rank] = (r.b, round(r.score, 9))
    for a in range(len(v)):
        want = sorted((-s[a, b], b) for b in range(len(v)) if b != a)[:3]
        assert got[a] == {i + 1: (b, round(-x, 9)) for i, (x, b) in enumerate(want)}
    few = K.nearest(df.where("id < 2"), "id", "v", 3).collect()
    assert sorted((r.a, r.rank, r.b) for r in few) == [(0, 1, 1), (1, 1, 0)]


def test_scans_read_their_rows_once(spark, monkeypatch):
    """Rows are worked out once, not again for each block."""
    from quern.operators import kernels as K

    df, _, _ = _scores_checked(spark, monkeypatch, 700)
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    counted = df.withColumn("id", F.udf(look, "long").asNondeterministic()("id"))
    assert K.nearest(counted, "id", "v", 3).count() == 2100 and seen.value <= 700


def test_best_owners_keep_the_best_of_all_pieces(spark, monkeypatch):
    """Owners of a few windows and one of very many, cut by pieces and batches; a partition hands on k owners a query."""
    from quern.operators import kernels as K

    _, v, s = _scores_checked(spark, monkeypatch, 700)
    owner = [0 if i % 3 == 0 else i // 5 for i in range(700)]
    df = spark.createDataFrame([(owner[i], i, x.tolist()) for i, x in enumerate(v)], "owner long, window long, v array<double>").repartition(2)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 700, 20)], "query long, v array<double>")
    made, against = [], K._against
    monkeypatch.setattr(K, "_against", lambda *a: made.append(against(*a)) or made[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = {(r["query"], r["rank"]): (r["owner"], r["window"], round(r["score"], 9)) for r in K.best_owners(q, df, 4).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a in range(0, 700, 20):
        best = {}
        for b in range(700):
            best[owner[b]] = min(best.get(owner[b], (9, 0)), (-s[a, b], b))
        want = sorted((x, o, w) for o, (x, w) in best.items())[:4]
        assert [got[a, i + 1] for i in range(4)] == [(o, w, round(-x, 9)) for x, o, w in want]
    assert len(got) == 35 * 4 and made[0].groupBy("query").count().agg(F.max("count")).first()[0] <= 2 * 4


def test_hash_scan_compares_classes(spark, monkeypatch):
    """Counts and pairs are those of all rows, but only one row a hash meets the others."""
    from quern.operators import kernels as K

    rng = random.Random(5)
    kinds = [("0" * 62) + f"{i:02x}" for i in (0, 1, 3, 7, 255)] + [hashlib.sha256(b"x").hexdigest()]
    rows = [(i, rng.choice([*kinds, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, h string").repartition(3)
    sizes, against = [], K._against
    monkeypatch.setattr(K, "_against", lambda *a: sizes.append((a[0].count(), a[1].count())) or against(*a))
    dist = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    kept = [r for r in rows if r[1]]
    for same, mine, others in ((True, kept, kept), (False, kept[:40], kept[40:])):
        part = (lambda ids: df.where(F.col("id").isin(ids))) if not same else (lambda ids: df)
        hist, pairs = K.hash_scan(part([i for i, _ in mine]), part([i for i, _ in others]), "id", "h", 2, same)
        want = [(a, b, dist(x, y)) for a, x in mine for b, y in others if not same or a < b]
        assert {r.distance: r.pairs for r in hist.collect() if r.pairs} == Counter(d for _, _, d in want)
        assert hist.count() == 257 and sorted(map(tuple, pairs.collect())) == sorted(w for w in want if w[2] <= 2)
    assert sizes == [(6, 6), (6, 6)]


def test_hash_pairs_are_dealt_evenly(spark, monkeypatch):
    """Pairs of two large classes are many tasks of about one size, and a null or repeated id keeps its pairs."""
    from quern.operators import kernels as K

    monkeypatch.setattr(K, "LIST", 16, raising=False)
    monkeypatch.setattr(K, "TASK", 2000, raising=False)
    near = [hashlib.sha256(b"y").hexdigest()[:63] + d for d in "0137"]
    mine = [(i, near[0]) for i in range(100)] + [(None, near[1])] * 3 + [(7, near[0]), (8, None)]
    others = [(i, near[2 + i % 2]) for i in range(1000, 1200)] + [(None, near[2])] * 40
    df = lambda rows: spark.createDataFrame(rows, "id long, h string").repartition(3)
    _, pairs = K.hash_scan(df(mine), df(others), "id", "h", 2)
    dist = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    want = Counter((a, b, dist(x, y)) for a, x in mine for b, y in others if x and dist(x, y) <= 2)
    assert Counter(map(tuple, pairs.collect())) == want
    sizes = pairs.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == want.total() and sizes.max() < want.total() / 4


def test_char_windows_of_long_texts(spark):
    """One pass, whatever the length; characters beyond the basic plane count as one."""
    import time

    from quern.functions.locks import char_windows

    texts = ["a b\ncd", "😀x😀yz", "abc", "", None, "".join(chr(97 + i * i % 23) for i in range(60_000))]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).orderBy("i").select(char_windows(F.col("t"), 4)).collect()]
    assert time.time() - began < 20
    plain = ["".join((t or "").split()) for t in texts]
    assert got == [[t[i:i + 4] for i in range(len(t) - 3)] for t in plain]


def test_assignments_of_many_keys(spark):
    """Most keys need no search; no key costs a call of its own."""
    from quern.operators import matching as M

    rng = random.Random(11)
    box = lambda: (x := rng.randrange(12), y := rng.randrange(3), x + rng.randrange(1, 7), y + rng.randrange(1, 4))
    sides = [[(f"u{k}", i, *box()) for k in range(400) for i in range(rng.randrange(5))] for _ in range(2)]
    g, p = (spark.createDataFrame(rows, f"unit string, {c} long, x1 long, y1 long, x2 long, y2 long") for rows, c in zip(sides, ("gold_id", "pred_id")))
    found = M.assignments(g, p, ["unit"])
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = defaultdict(list)
    for r in found.collect():
        got[r.unit].append((r.gold_id, r.pred_id, r.iou))
    for k in range(400):
        one, two = ({r[1]: r[2:] for r in rows if r[0] == f"u{k}"} for rows in sides)
        pairs = []
        for i, a in one.items():
            for j, b in two.items():
                n = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                if n:
                    pairs.append((i, j, n / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - n)))
        mine, values = got[f"u{k}"], {(i, j): v for i, j, v in pairs}
        assert len({x for x, _, _ in mine}) == len({x for _, x, _ in mine}) == len(mine) and all(abs(values[i, j] - v) < 1e-12 for i, j, v in mine)
        assert abs(sum(v for _, _, v in mine) - most(pairs, True)) < 1e-9


def test_snapshot_parts_follow_the_bytes(spark, tmp_path, monkeypatch):
    """Behind joins the planner's estimate is no measure: a part is digested as one value and must stay small."""
    from quern.sources import snapshot as S

    monkeypatch.setattr(S, "PART_BYTES", 20_000)
    a = spark.range(3000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    df = a.join(a.groupBy("k").count(), "k").join(a.select("k", F.col("sha").alias("other")), "k", "left")
    S.write_snapshot(spark, {"t": (df, "k")}, str(tmp_path / "s"))
    files = sorted((tmp_path / "s" / "t").glob("part-*"))
    assert len(files) >= 20 and max(f.stat().st_size for f in files) < 60_000
    rows = [line.split(",") for f in files for line in f.read_text().splitlines()[1:]]
    assert [int(r[0]) for r in rows] == list(range(3000)) and all(r[1] == hashlib.sha256(r[0].encode()).hexdigest() == r[3] for r in rows)
    assert S.faults(spark, str(tmp_path / "s")).count() == 0


def test_scanned_columns_are_those_of_scan(spark):
    """The steps as columns say the same, and a plan of them has each pattern once or twice, not for each use."""
    from quern.functions import locks as K

    texts = ["Size 12.50 mm by KR-3.1 per ISO 6520-1 cross-section, AWS asks 3 % 합격.", "no number", "", "KR-9.T4 KR-9 불 합격 7 밀리", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    out, said = K.with_scan(df, "t")
    plain = {r.i: r for r in df.select("i", *[c.alias(k) for k, c in K.scan(F.col("t")).items()]).collect()}
    found = out.select("i", *[c.alias(k) for k, c in said.items()])
    assert {r.i: r for r in found.collect()} == plain and plain[0].clauses == ["KR-3.1"] and plain[0].standards == ["ISO 6520-1", "AWS"]
    used = out.select("i", *[K._stranger(said, K.numbers_of(F.lit("3"))).alias(f"u{k}") for k in range(5)])
    assert used._jdf.queryExecution().optimizedPlan().toString().count("퍼센트") <= 6


def test_one_clause_looks_up_what_is_asked_once(spark, monkeypatch):
    """Queries and rules that say the same are one each in the join; nulls find none."""
    from quern.operators import clauses as C

    rules = [(i, True, True, f"D{i % 2}", "ALL" if i % 3 else "ST", "RT", "S", "B", "T1", i % 5, None if i % 5 == 4 else i % 5 + 2, f"C{i % 2}{i % 5}") for i in range(600)]
    asked = [(i, None if i % 50 == 7 else f"D{i % 2}", "ST" if i % 4 else "AL", "RT", "S", "B", i % 9) for i in range(800)]
    r = spark.createDataFrame(rules, "rule_id long, active boolean, canonical boolean, code string, material string, method string, scheme string, level string, limit_type string, lo long, hi long, clause string")
    q = spark.createDataFrame(asked, "qid long, code string, material string, method string, scheme string, level string, t long")
    sizes, real = [], C.applicable
    monkeypatch.setattr(C, "applicable", lambda a, b, *x: sizes.append((a.count(), b.count())) or real(a, b, *x))
    got = {x.qid: (x.clause, x.state) for x in C.one_clause(q, r).collect()}
    for i, code, material, _, _, _, t in asked:
        found = {x[11] for x in rules if x[3] == code and x[4] in (material, "ALL") and t >= x[9] and (x[10] is None or t < x[10])}
        assert got[i] == (min(found) if len(found) == 1 else None, "ok" if len(found) == 1 else "multiple" if found else "none")
    assert len(got) == 800 and sizes[0][0] <= 2 * 2 * 9 * 2 and sizes[0][1] <= 30
