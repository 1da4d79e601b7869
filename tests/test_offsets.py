"""Offsets are summed inside the row: no shuffle, whatever the number of hits."""

from pyspark.sql import functions as F

from pseudoflow.functions.hof import sums_before
from pseudoflow.functions.rules import rule_by_id
from pseudoflow.operators.detect import detect


def test_sums_before(spark):
    rows = [(0, []), (1, [5]), (2, [1, 2, 3, 4, 5, 6, 7]), (3, list(range(1300))), (4, [1] * 1024), (5, None)]
    df = spark.createDataFrame(rows, "k int, v array<bigint>")
    for block in (1, 3, 512):
        got = {r.k: r.s for r in df.select("k", sums_before(F.col("v"), block).alias("s")).collect()}
        for k, v in rows:
            assert got[k] == (None if v is None else [sum(v[:i]) for i in range(len(v))])


def test_offsets_of_many_hits(spark):
    text = "".join(f"é{'x' * (i % 7)} a{i}@b.org " for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no hit"), (1, "z@y.com")], "doc_id long, text string")
    spans = detect(df, [rule_by_id("global.email")], with_offsets=True)
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
    got = spans.collect()
    assert len(got) == 3001
    for r in got:
        source = text if r.value != "z@y.com" else "z@y.com"
        assert source[r.start:r.end] == r.value
