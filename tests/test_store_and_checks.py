"""Mapping store and run commits, session-wide leak check, reports that add up, restore in append mode."""

import uuid

import pytest
from pyspark.sql import functions as F

from pseudoflow.operators import mask as M
from pseudoflow.operators import report as R
from pseudoflow.operators import unmask as U
from pseudoflow.options import MaskOptions
from pseudoflow.plans.jobs import mask_job, restore_job
from pseudoflow.session import ensure_checkpoint_dir
from pseudoflow.sources import clear_run, committed_run, read_mapping, write_outputs
from pseudoflow.sources.store import MappingStore, State, session_registry
from pseudoflow.streaming import restore_stream

REGEX = MaskOptions(engines="regex")
ROWS = [(k, f"s{k % 5}", k, f"m{k % 11}@x.com and n{k % 7}@x.com") for k in range(60)] + [(99, "quiet", 1, "nothing")]
SCHEMA = "doc_id int, session_id string, seq int, text string"


def base_of(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def batch(spark, store, number, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    existing = None if store.state(before=number) == State(None, []) else store.mapping(before=number)
    res = M.mask_sessions(df, order_col="seq", options=REGEX, existing_mapping=existing)
    store.write(number, res.added, session_registry(res.masked, number))
    return res


def content(store, **kw):
    return sorted((r.session_id, r.n, r.value) for r in store.mapping(**kw).collect())


def test_store_commits_compacts_prunes_and_clears(spark):
    store = MappingStore(spark, f"{base_of(spark, 'store')}/mapping", buckets=8)
    batch(spark, store, 0, ROWS[:20])
    assert content(store) == []  # not committed yet
    store.commit(0)
    before = content(store)
    batch(spark, store, 1, ROWS[20:40])
    assert content(store) == before  # a batch that stopped half-way is not seen
    batch(spark, store, 1, ROWS[20:40])
    store.commit(1)
    store.commit(1)  # a replay
    assert store.compact() == 1 and store.compact() is None
    batch(spark, store, 2, ROWS[40:])
    store.commit(2)
    whole = M.mask_sessions(spark.createDataFrame(ROWS, SCHEMA), order_col="seq", options=REGEX)
    assert content(store) == sorted((r.session_id, r.n, r.value) for r in whole.mapping.collect())
    assert content(store, before=2) == content(MappingStore(spark, store.path, buckets=3), before=2)  # the number of buckets is the store's
    seen = {r.session_id: (r.n_rows, r.last_seen) for r in store.sessions().collect()}
    assert seen["quiet"] == (1, 2) and seen["s1"] == (12, 2)
    one = store.mapping_for_session("s3")
    assert {r.session_id for r in one.collect()} == {"s3"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(session_bucket") == 2  # base and delta, one bucket of each
    store.vacuum()
    assert content(store) == sorted((r.session_id, r.n, r.value) for r in whole.mapping.collect())
    store.clear(spark.createDataFrame([("s3",), ("quiet",)], "session_id string"))
    assert {r[0] for r in content(store)} == {"s0", "s1", "s2", "s4"} and "quiet" not in {r.session_id for r in store.sessions().collect()}


def test_a_run_that_stops_between_its_writes_changes_nothing(spark):
    base = base_of(spark, "run")
    spark.createDataFrame(ROWS[:10], SCHEMA).write.parquet(f"{base}/in1")
    spark.createDataFrame(ROWS[10:20], SCHEMA).write.parquet(f"{base}/in2")
    kw = dict(session_col="session_id", order_col="seq", options=REGEX)
    mask_job(spark, f"{base}/in1", f"{base}/masked", f"{base}/mapping", run_id="one", **kw)
    first = sorted(map(tuple, read_mapping(spark, f"{base}/mapping").collect()))
    res = M.mask_sessions(spark.read.parquet(f"{base}/in2"), order_col="seq", options=REGEX)
    write_outputs(res.masked, res.mapping, f"{base}/masked/run_id=two", f"{base}/mapping/run_id=two")  # and no manifest row
    assert committed_run(spark, f"{base}/mapping")["run_id"] == "one"
    assert sorted(map(tuple, read_mapping(spark, f"{base}/mapping").collect())) == first
    restore_job(spark, f"{base}/masked", f"{base}/mapping", f"{base}/back")
    assert {r.doc_id: r.text for r in spark.read.parquet(f"{base}/back").collect()} == {r[0]: r[3] for r in ROWS[:10]}
    clear_run(spark, f"{base}/mapping", spark.createDataFrame([("s1",)], "session_id string"), "three")
    restore_job(spark, f"{base}/masked", f"{base}/mapping", f"{base}/back2")
    assert {r.doc_id for r in spark.read.parquet(f"{base}/back2").where("is_error").collect()} == {1, 6}


def test_leaks_in_other_rows_of_the_session(spark):
    masked = spark.createDataFrame([(1, "a", "see x@a.com"), (2, "a", "[EMAIL:1]"), (3, "b", "x@a.com"), (4, "b", "y@b.com, y@b.com!"), (4, None, "y@b.com"), (5, "a", None)],
                                   "doc_id int, session_id string, masked_text string")
    mapping = spark.createDataFrame([("a", "x@a.com"), ("b", "y@b.com"), ("b", ""), ("a", "EM")], "session_id string, value string")
    got = sorted(map(tuple, U.leak_check_sessions(masked, mapping).collect()))
    assert got == [(1, "a", "x@a.com"), (2, "a", "EM"), (4, "b", "y@b.com")]


def test_reports_have_no_expand_and_sketches_add_up(spark):
    n = 30_000
    spans = spark.range(n).select((F.col("id") % 997).alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 7).alias("day"),
                                  F.when(F.col("id") % 2 == 0, "EMAIL").otherwise("IP").alias("tag"), (F.col("id") % 9001).cast("string").alias("value"), (F.col("id") % 5 != 0).alias("valid"))
    for rollup in (False, True):
        got = R.pii_report(spans, None, ["source"], rollup=rollup)
        assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
        keys = ["source", "tag"]
        valid = lambda c: F.count_distinct(F.when(F.col("valid"), F.col(c)))
        plain = (spans.rollup(*keys) if rollup else spans.groupBy(*keys)).agg(
            F.count(F.when(F.col("valid"), 1)), valid("value"), F.count(F.when(~F.col("valid"), 1)), valid("doc_id"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    merged = {(r.source, r.tag): r for r in R.merge_sketches(R.pii_sketch(spans, None, ["day", "source"]), ["source"]).collect()}
    for r in R.pii_report(spans, None, ["source"]).collect():
        m = merged[r.source, r.tag]
        assert (m.hits, m.rejected) == (r.hits, r.rejected)
        assert abs(m.distinct_values - r.distinct_values) <= 0.03 * r.distinct_values and abs(m.documents - r.documents) <= 0.03 * r.documents
    assert R.pii_report(spans.limit(0), None, ["source"], rollup=True).collect() == [(None, None, 0, 0, 0, 0)]


def test_restore_in_append_mode_and_its_bound(spark):
    res = M.mask_sessions(spark.createDataFrame(ROWS, SCHEMA), order_col="seq", options=REGEX).checkpoint()
    rows = res.masked.unionByName(spark.createDataFrame([(7, "none", "[EMAIL:1]"), (8, None, "x"), (9, "s1", "[NO:1] [EMAIL:1][EMAIL:1]"), (10, "s1", None)], res.masked.schema))
    got = restore_stream(rows, res.mapping, session_registry(res.masked))
    want = U.unmask_checked(rows, res.mapping, "masked_text", "doc_id", known_sessions=session_registry(res.masked))
    cols = ["doc_id", "session_id", "text", "is_error"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)
    from pseudoflow.streaming import session_values
    with pytest.raises(Exception, match="more values"):
        session_values(res.mapping, most=3).collect()


def test_restore_stream_of_a_session_with_more_values_than_a_row_should_hold(spark):
    """Values meet rows by their tokens; the session's 100,001 values are never held by a row."""
    mapping = spark.range(1, 100_002).select(F.lit("s").alias("session_id"), F.concat(F.lit("[EMAIL:"), F.col("id").cast("string"), F.lit("]")).alias("token"),
                                             F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    rows = spark.createDataFrame([(1, "s", "[EMAIL:100001] and [EMAIL:1] [EMAIL:1]", {"a": 1}), (1, "s", "[EMAIL:100001] and [EMAIL:1] [EMAIL:1]", {"a": 1}),
                                  (None, "s", "", None), (2, "t", "[EMAIL:1]", None), (3, "s", "[EMAIL:100002] [EMAIL:\u0663]", None)], "doc_id int, session_id string, masked_text string, m map<string,int>")
    got = restore_stream(rows, mapping, spark.createDataFrame([("s",)], "session_id string"))
    assert got.columns == ["doc_id", "session_id", "masked_text", "m", "text", "is_error"]
    again = "v100001 and v1 v1"
    assert sorted(((r.doc_id or 0, r.text, r.is_error) for r in got.collect())) == [
        (0, "", False), (1, again, False), (1, again, False), (2, U.SESSION_NOT_FOUND.format(sid="t"), True), (3, "[EMAIL:100002] [EMAIL:\u0663]", False)]
