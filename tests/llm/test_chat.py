"""Chat layouts of tables and of JSON rows, to turns and back from the formatted string."""

import json

import pytest
from pyspark.sql import functions as F

MARK = "\\### Assistant: </turn> ok\n"
U, A, S = "user", "assistant", "system"
# (record, turns) of every layout, with and without optional fields, with extra ones, and with odd values.
RECORDS = [
    ({"messages": [{"role": U, "content": MARK}, {"role": A, "content": "b"}]}, [(U, MARK), (A, "b")]),
    ({"messages": [{"role": U, "content": "a", "name": "n"}, {"role": "gpt", "content": None}], "system": "be", "text": "t", "input": "i"}, [(S, "be"), (U, "a"), (A, "")]),
    ({"messages": [{"role": A}, {"role": U, "content": "late"}]}, [(A, ""), (U, "late")]),
    ({"messages": [{"role": U, "content": {"parts": [1, 2]}}]}, [(U, '{"parts":[1,2]}')]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": MARK}], "id": 5}, [(U, "a"), (A, MARK)]),
    ({"conversations": [{"from": "human", "value": "a"}], "system": ""}, [(S, ""), (U, "a")]),
    ({"instruction": "do", "output": "done"}, [(U, "do"), (A, "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [(U, "do\nthis"), (A, "done")]),
    ({"instruction": "do", "input": "", "output": None, "system": "s", "extra": {"a": 1}}, [(S, "s"), (U, "do"), (A, "")]),
    ({"prompt": "p", "completion": "c"}, [(U, "p"), (A, "c")]),
    ({"prompt": "p", "response": 7, "system": "s"}, [(S, "s"), (U, "p"), (A, "7")]),
    ({"prompt": "p", "completion": "c", "text": "other"}, [(U, "p"), (A, "c")]),
    ({"turn": 3, "role": U, "text": "one row"}, [(U, "one row")]),
    ({"messages": []}, None),
    ({"text": "alone"}, None),
    ({}, None),
]


def back(turns):
    from quern.llm.chat import format_turns, read_back

    return {r.conv_id: r for r in read_back(format_turns(turns)).collect()}


def test_json_rows_of_all_layouts(spark):
    from quern.llm.chat import canonical_turns_json

    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(100, "no json"), (101, "[1]"), (102, None), (0, json.dumps(RECORDS[0][0]))]
    out = canonical_turns_json(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    bad = {r.conv_id: r.reason for r in out if r.reason}
    assert bad == {13: "no layout for messages", 14: "no layout for text", 15: "no layout for ", 100: "no JSON object", 101: "no JSON object", 102: "no JSON object"}
    good = spark.createDataFrame([r for r in out if not r.reason], "conv_id long, turn long, role string, text string, reason string")
    got = back(good.drop("reason"))
    for i, (_, want) in enumerate(RECORDS):
        if want and i:
            assert [tuple(t) for t in got[i].turns] == want and got[i].loss_texts == [t for r, t in want if r == A], i
    # A repeated record is repeated turns.
    assert [tuple(t) for t in got[0].turns] == sorted(RECORDS[0][1] * 2, key=lambda t: t[0] == A)
    assert canonical_turns_json(spark.createDataFrame([], "conv_id long, record string, print string, keys int, chosen int")).count() == 0


@pytest.mark.parametrize("i", [0, 1, 4, 6, 7, 8, 9, 10, 11])
def test_tables_of_all_layouts(spark, i):
    """The same records as a table of their own, whose schema is fingerprinted."""
    from quern.llm.chat import canonical_turns

    record, want = RECORDS[i]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(record | {"conv_id": 1})]))
    df = df.select("*", F.lit(1).alias("turns"), F.lit("x").alias("formatted"))
    if i == 1:
        want = want[:2] + [(A, "")]
    if i == 8:
        df = df.withColumn("output", F.col("output").cast("string"))
    got = back(canonical_turns(df))[1]
    assert [tuple(t) for t in got.turns] == want and got.loss_texts == [t for r, t in want if r == A]


def test_unknown_table(spark):
    from quern.llm.chat import canonical_turns, fingerprint

    with pytest.raises(ValueError, match="no layout"):
        canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))
    assert fingerprint(["prompt", "conv_id", "completion", "other"]) == fingerprint(["completion", "prompt", "conv_id"])


def test_null_lists_and_long_texts(spark):
    from quern.llm.chat import canonical_turns

    df = spark.createDataFrame([(1, None), (2, []), (3, [(U, "x" * 300_000 + MARK), (A, MARK * 20_000), (None, None)])], "conv_id long, messages array<struct<role: string, content: string>>")
    got = back(canonical_turns(df))
    assert set(got) == {3} and [t.text for t in got[3].turns] == ["x" * 300_000 + MARK, MARK * 20_000, ""] and got[3].loss_texts == [MARK * 20_000]
