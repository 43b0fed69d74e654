"""The registered queries of the llm operators against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"


def names():
    from quern.llm.oracles import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    from quern.llm.oracles import ORACLES
    from quern.llm.queries import QUERIES

    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    want = sorted((tuple(r[at.index(c)] for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=str) == want and want
