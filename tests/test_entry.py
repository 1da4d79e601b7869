"""Driver contract: entry runs; every query has a callable; oracle keys are a subset."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "masked_text"]
    assert df.count() > 0


def test_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40
