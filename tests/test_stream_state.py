"""Keyed state: equal to the batch job, continues a mapping, expires by event time, restarts from its checkpoint."""

import uuid

from pyspark.sql import functions as F

from pseudoflow.operators import mask as M
from pseudoflow.options import MaskOptions
from pseudoflow.session import ensure_checkpoint_dir
from pseudoflow.streaming.state import state_mapping, state_session

SCHEMA = "doc_id int, sid string, seq int, at timestamp, text string"
ROWS = [(1, "a", 1, "2024-01-01 00:00:00", "x@a.com y@a.com"), (2, "b", 1, "2024-01-01 00:00:01", "x@a.com"),
        (3, "a", 2, "2024-01-01 00:00:02", "z@a.com x@a.com"), (4, None, 2, "2024-01-01 00:00:02", "n@a.com"),
        (5, "a", 3, "2024-01-01 00:00:03", "w@a.com z@a.com"), (6, "b", 3, "2024-01-01 00:00:03", None)]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in rows], SCHEMA.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))


def run(spark, base, rows, **kw):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
    s = state_session(spark)
    initial = kw.pop("initial", None)
    if initial is not None:
        kw["initial"] = s.read.parquet(initial)
    out = state_mapping(s.readStream.schema(SCHEMA).parquet(f"{base}/in"), session_col="sid", order_col="seq", **kw)
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return sorted((r.session_id, r.generation, r.token, r.value) for r in spark.read.parquet(f"{base}/out").collect())


def test_three_batches_with_restarts_equal_the_batch_job(spark):
    base = f"{ensure_checkpoint_dir(spark)}/tws-{uuid.uuid4().hex}"
    for k in (0, 2, 4):
        got = run(spark, base, ROWS[k : k + 2])
    batch = M.mask_sessions(frame(spark, [r for r in ROWS if r[1]]), session_col="sid", order_col="seq", options=MaskOptions(engines="regex"))
    assert got == sorted((r.session_id, 1, r.token, r.value) for r in batch.mapping.collect())


def test_initial_state_and_expiry_by_event_time(spark):
    base = f"{ensure_checkpoint_dir(spark)}/tws-{uuid.uuid4().hex}"
    M.mask_sessions(frame(spark, ROWS[:2]), session_col="sid", order_col="seq", options=MaskOptions(engines="regex")).mapping.write.parquet(f"{base}/old")
    kw = dict(initial=f"{base}/old", event_col="at", expire_ms=60_000)
    assert run(spark, base, ROWS[2:3], **kw) == [("a", 1, "[EMAIL:3]", "z@a.com")]
    late = [(7, "b", 9, "2024-01-01 01:00:00", "q@a.com"), (8, "c", 9, "2024-01-01 01:00:00", "c@a.com")]
    run(spark, base, late, **kw)  # the watermark passes a's expiry
    got = run(spark, base, [(9, "a", 10, "2024-01-01 01:00:01", "x@a.com")], **kw)
    assert ("a", 2, "[EMAIL:1]", "x@a.com") in got and ("b", 1, "[EMAIL:2]", "q@a.com") in got
