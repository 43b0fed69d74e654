"""Queries that read all rows of their table, against brute force over the whole table."""

import pyarrow.parquet as pq

from quern import catalog

DIR = "/root/testdata/sf0.001"


def test_token_symmetry(spark):
    t = pq.read_table(f"{DIR}/lineitem.parquet", columns=["l_suppkey", "l_partkey"])
    pairs = set(zip(t["l_suppkey"].to_pylist(), t["l_partkey"].to_pylist()))
    got = [tuple(r) for r in catalog.QUERIES["token_symmetry"](spark, DIR).select("a", "b").collect()]
    assert sorted(got) == sorted((a, b) for a, b in pairs if (b, a) not in pairs)


def test_interval_faults(spark):
    t = pq.read_table(f"{DIR}/lineitem.parquet", columns=["l_suppkey", "l_partkey"])
    want, before = [], {}
    for s, lo in sorted(set(zip(t["l_suppkey"].to_pylist(), t["l_partkey"].to_pylist()))):
        if s in before and lo != before[s]:
            want.append((s, lo, lo + 40, "gap" if lo > before[s] else "overlap"))
        before[s] = lo + 40
    got = [tuple(r) for r in catalog.QUERIES["interval_faults"](spark, DIR).select("s", "lo", "hi", "fault").collect()]
    assert sorted(got) == want
