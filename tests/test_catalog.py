"""Every query of the library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quern import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(str(v) for v in r) for r in df.select(cols).collect())
    cur = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_strict_csv(spark, tmp_path):
    from quern.sources.tables import read_csv

    p = tmp_path / "a.csv"
    types = {"a": "bigint", "b": "string", "c": "boolean"}
    p.write_text('a,b,c\n1,,true\n,"x, ""y""",False\n')
    assert [tuple(r) for r in read_csv(spark, str(p), types).collect()] == [(1, "", True), (None, 'x, "y"', False)]
    assert [r.b for r in read_csv(spark, str(p), types, nullable=("b",)).collect()] == [None, 'x, "y"']
    with pytest.raises(ValueError):
        read_csv(spark, str(p), {"b": "string", "a": "bigint", "c": "boolean"})
    # A blank or unknown boolean, a word for a number, a short and a long row.
    for row in ("1,x,", "1,x,yes", "one,x,True", "1,x", "1,x,True,2"):
        p.write_text(f"a,b,c\n{row}\n")
        with pytest.raises(Exception):
            read_csv(spark, str(p), types).collect()


def test_sentences_glue_short_pieces(spark):
    from pyspark.sql import functions as F

    from quern.functions.scalars import sentences

    r = spark.range(1).select(sentences(F.lit("1. First part here. Second one.")).alias("s")).first()
    assert r["s"] == ["1. First part here.", "Second one."]


def test_ledger_missing_cells(spark):
    from quern.streaming.ledger import missing_cells

    rows = spark.createDataFrame([(1, "A"), (2, "B")], "round long, client_id string")
    assert sorted(map(tuple, missing_cells(rows, ["A", "B"], 2).collect())) == [(1, "B"), (2, "A")]
