"""I1 readers, ST4 session expiry, N6 degradation when the extractor fails."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from pseudoflow.operators import entities as N
from pseudoflow.operators import mask as M
from pseudoflow.options import MaskOptions
from pseudoflow.session import ensure_checkpoint_dir
from pseudoflow.sources import read_documents
from pseudoflow.streaming import SessionMaskSink, SessionUnmaskSink, read_batches, run_available


def test_read_documents_formats(spark):
    base = f"{ensure_checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "mail a@b.com")], "doc_id int, text string")
    df.write.json(f"{base}/j")
    df.write.option("header", True).csv(f"{base}/c")
    df.select("text").write.text(f"{base}/t")
    for fmt, opts in (("json", {}), ("csv", {"header": "true"}), ("text", {})):
        got = read_documents(spark, f"{base}/{fmt[0]}", fmt, **opts)
        assert "text" in got.columns
        assert M.mask_rows(got.withColumn("doc_id", F.lit(1)), options=MaskOptions(engines="regex")).masked.first().masked_text == "mail [EMAIL:1]"


def test_session_expiry_restarts_numbering(spark):
    base = f"{ensure_checkpoint_dir(spark)}/ttl-{uuid.uuid4().hex}"
    schema = "doc_id int, sid string, seq int, text string"
    sink = SessionMaskSink(f"{base}/map", f"{base}/out", session_col="sid", order_col="seq", ttl_batches=1)
    sink(spark.createDataFrame([(1, "a", 1, "x@y.com")], schema), 0)
    sink(spark.createDataFrame([(2, "b", 1, "q@y.com")], schema), 1)
    sink(spark.createDataFrame([(3, "b", 2, "r@y.com")], schema), 2)
    sink(spark.createDataFrame([(4, "a", 2, "z@y.com")], schema), 3)  # 'a' idle for 2 batches: expired
    got = {r.doc_id: r.masked_text for r in read_batches(spark, f"{base}/out").collect()}
    assert got == {1: "[EMAIL:1]", 2: "[EMAIL:1]", 3: "[EMAIL:2]", 4: "[EMAIL:1]"}


def test_restore_after_expiry_and_last_seen(spark):
    """Old and new texts get their own values; a session that repeats its values stays alive; a replay changes nothing."""
    base = f"{ensure_checkpoint_dir(spark)}/ttl-{uuid.uuid4().hex}"
    schema = "doc_id int, sid string, seq int, text string"
    sink = SessionMaskSink(f"{base}/map", f"{base}/out", session_col="sid", order_col="seq", ttl_batches=1)
    rows = [(1, "a", 1, "x@y.com"), (2, "a", 2, "x@y.com"), (3, "a", 3, "x@y.com w@y.com"), (4, "b", 1, "q@y.com"), (5, "b", 2, "none"), (6, "a", 4, "z@y.com and w@y.com")]
    for n, row in enumerate(rows):
        sink(spark.createDataFrame([row], schema), n)
    sink(spark.createDataFrame([rows[-1]], schema), len(rows) - 1)
    out = read_batches(spark, f"{base}/out")
    assert {r.doc_id: r.masked_text for r in out.collect()} == {
        1: "[EMAIL:1]", 2: "[EMAIL:1]", 3: "[EMAIL:1] [EMAIL:2]", 4: "[EMAIL:1]", 5: "none", 6: "[EMAIL:1] and [EMAIL:2]"}
    SessionUnmaskSink(f"{base}/map", f"{base}/back")(out.drop("batch_id"), 0)
    assert {r.doc_id: r.text for r in read_batches(spark, f"{base}/back").collect()} == {r[0]: r[3] for r in rows}


def test_new_checkpoint_is_refused(spark):
    base = f"{ensure_checkpoint_dir(spark)}/own-{uuid.uuid4().hex}"
    schema = "doc_id int, sid string, text string"
    sink = SessionMaskSink(f"{base}/map", f"{base}/out", session_col="sid")
    read = lambda n: spark.readStream.schema(schema).parquet(f"{base}/in{n}")
    spark.createDataFrame([(1, "s", "x@y.com")], schema).write.parquet(f"{base}/in1")
    run_available(read(1), sink, f"{base}/ck")
    spark.createDataFrame([(2, "s", "v@y.com")], schema).write.mode("append").parquet(f"{base}/in1")
    run_available(read(1), sink, f"{base}/ck")  # the same checkpoint goes on
    spark.createDataFrame([(3, "s", "z@y.com")], schema).write.parquet(f"{base}/in2")
    with pytest.raises(Exception, match="belongs to stream"):
        run_available(read(2), sink, f"{base}/ck2")
    got = {(r.token, r.value) for r in read_batches(spark, f"{base}/map").collect()}
    assert got == {("[EMAIL:1]", "x@y.com"), ("[EMAIL:2]", "v@y.com")}


def test_extractor_failure_keeps_rule_output(spark):
    def broken(chunk, known):
        raise ConnectionError("refused")

    df = spark.createDataFrame([(1, "Anna Nowak, SSN 123-45-6789.")], "doc_id int, text string")
    res = N.extract_entities(df, broken).cache()
    status = N.ner_status(res)
    out = M.pseudonymize(df, MaskOptions(lang="en", engines="hybrid"), entities=N.entities_of(res),
                         ner_status=status.withColumn("doc_id", F.col("doc_id").cast("int")))
    row = out.masked.first()
    assert row.masked_text == "Anna Nowak, SSN [SSN:1]." and row.ner_status == "disabled"


def test_mask_and_restore_jobs(spark):
    from pseudoflow.plans.jobs import mask_job, restore_job

    base = f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    src = spark.createDataFrame([(1, "c1", 1, "SSN 123-45-6789, mail a@b.com"), (2, "c1", 2, "again a@b.com"),
                                 (3, "c2", 1, "none")], "doc_id int, conv string, turn int, text string")
    src.write.parquet(f"{base}/in")
    mask_job(spark, f"{base}/in", f"{base}/masked", f"{base}/mapping", session_col="conv", order_col="turn",
             options=MaskOptions(lang="en", engines="regex"))
    masked = {r.doc_id: r.masked_text for r in spark.read.parquet(f"{base}/masked").collect()}
    assert masked == {1: "SSN [SSN:1], mail [EMAIL:1]", 2: "again [EMAIL:1]", 3: "none"}
    restore_job(spark, f"{base}/masked", f"{base}/mapping", f"{base}/restored")
    back = {r.doc_id: (r.text, r.is_error) for r in spark.read.parquet(f"{base}/restored").collect()}
    assert back[1] == ("SSN 123-45-6789, mail a@b.com", False) and back[2] == ("again a@b.com", False)
    # c2 had no hits but was masked, so it is a known session
    assert back[3] == ("none", False)
    answers = spark.createDataFrame([(10, "c1", "Reply to [EMAIL:1]"), (11, "zz", "[SSN:1]")],
                                    "doc_id int, session_id string, masked_text string")
    answers.write.parquet(f"{base}/answers")
    restore_job(spark, f"{base}/masked", f"{base}/mapping", f"{base}/restored2", texts_path=f"{base}/answers")
    back2 = {r.doc_id: (r.text, r.is_error) for r in spark.read.parquet(f"{base}/restored2").collect()}
    assert back2[10] == ("Reply to a@b.com", False) and back2[11][1] is True
