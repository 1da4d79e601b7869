"""Streaming: numbering continues across micro-batches and equals the batch result."""

import uuid

from pyspark.sql import functions as F

from pseudoflow.operators import mask as M
from pseudoflow.options import MaskOptions
from pseudoflow.session import ensure_checkpoint_dir
from pseudoflow.streaming import SessionMaskSink, SessionUnmaskSink, mask_stream, read_batches, run_available


def test_stream_sessions_equal_batch(spark):
    base = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    rows1 = [(1, "s1", 1, "a@x.com b@x.com"), (2, "s2", 1, "c@x.com")]
    rows2 = [(3, "s1", 2, "b@x.com d@x.com"), (4, "s2", 2, "a@x.com c@x.com")]
    schema = "doc_id int, sid string, seq int, text string"
    spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(f"{base}/in/b1")
    spark.createDataFrame(rows2, schema).coalesce(1).write.parquet(f"{base}/in/b2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    run_available(stream, SessionMaskSink(f"{base}/map", f"{base}/out", session_col="sid", order_col="seq"), f"{base}/ck")
    got = {r.doc_id: r.masked_text for r in read_batches(spark, f"{base}/out").collect()}
    batch = M.mask_sessions(spark.createDataFrame(rows1 + rows2, schema), session_col="sid", order_col="seq",
                            options=MaskOptions(engines="regex"))
    assert got == {r.doc_id: r.masked_text for r in batch.masked.collect()}
    assert got[3] == "[EMAIL:2] [EMAIL:3]"

    # ST3: restore the masked stream output
    masked = read_batches(spark, f"{base}/out").drop("batch_id").withColumnRenamed("sid", "session_id")
    masked.write.parquet(f"{base}/masked_in")
    s2 = spark.readStream.schema(masked.schema).parquet(f"{base}/masked_in")
    run_available(s2, SessionUnmaskSink(f"{base}/map", f"{base}/restored"), f"{base}/ck2")
    back = {r.doc_id: r.text for r in read_batches(spark, f"{base}/restored").collect()}
    assert back == {r[0]: r[3] for r in rows1 + rows2}


def test_mask_stream_row_local(spark):
    base = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    schema = "doc_id int, text string"
    spark.createDataFrame([(1, "SSN 123-45-6789")], schema).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    q = mask_stream(stream, options=MaskOptions(lang="en", engines="regex")).writeStream.format("memory") \
        .queryName("ms_" + uuid.uuid4().hex[:8]).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql(f"SELECT masked_text FROM {q.name}").first()[0] == "SSN [SSN:1]"


def test_detect_stream(spark):
    from pseudoflow.functions.rules import rules_for_language
    from pseudoflow.streaming import detect_stream

    base = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    schema = "doc_id int, text string"
    spark.createDataFrame([(1, "SSN 123-45-6789 and 900-12-3456, mail a@b.com")], schema).write.parquet(f"{base}/in")
    q = detect_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), rules_for_language("en")) \
        .writeStream.format("memory").queryName("ds_" + uuid.uuid4().hex[:8]).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.tag, r.value, r.valid) for r in spark.sql(f"SELECT * FROM {q.name}").collect()}
    assert got == {("SSN", "123-45-6789", True), ("SSN", "900-12-3456", False), ("EMAIL", "a@b.com", True)}
