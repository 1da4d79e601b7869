"""Token store semantics: numbering, idempotence, extension, clearing; the numbering paths agree."""

from pyspark.sql import functions as F

from pseudoflow.operators import mask as M
from pseudoflow.operators import tokens as T
from pseudoflow.options import MaskOptions


def hits(spark, rows):
    return spark.createDataFrame(rows, "_key int, session_id string, call_seq long, pass_no int, idx int, tag string, value string")


def as_dict(mapping):
    return {(r.session_id, r.token): r.value for r in mapping.collect()}


def test_numbering_and_idempotence(spark):
    h = hits(spark, [(1, "s", 1, 0, 0, "PERSON", "Alice"), (1, "s", 1, 0, 2, "PERSON", "Bob"),
                     (1, "s", 1, 1, 4, "ORG", "Acme"), (2, "s", 2, 0, 0, "PERSON", "Alice")])
    for strategy in ("range", "window"):
        m = as_dict(T.assign_tokens(h, strategy))
        assert m == {("s", "[PERSON:1]"): "Alice", ("s", "[PERSON:2]"): "Bob", ("s", "[ORG:1]"): "Acme"}


def test_extend_and_clear(spark):
    first = T.assign_tokens(hits(spark, [(1, "s", 1, 0, 0, "PERSON", "Alice")]))
    more = hits(spark, [(2, "s", 2, 0, 0, "PERSON", "Bob"), (2, "s", 2, 0, 1, "PERSON", "Alice")])
    ext = as_dict(T.extend_mapping(first, more))
    assert ext == {("s", "[PERSON:1]"): "Alice", ("s", "[PERSON:2]"): "Bob"}
    cleared = T.clear_sessions(T.extend_mapping(first, more), spark.createDataFrame([("s",)], "session_id string"))
    assert cleared.count() == 0
    again = as_dict(T.extend_mapping(cleared, hits(spark, [(3, "s", 3, 0, 0, "PERSON", "Bob")])))
    assert again == {("s", "[PERSON:1]"): "Bob"}


def test_session_masking_continues_numbers(spark):
    df = spark.createDataFrame([(1, "a", 1, "mail x@a.com"), (2, "a", 2, "mail y@a.com and x@a.com"),
                                (3, "b", 1, "mail y@a.com")], "doc_id int, sid string, seq int, text string")
    for strategy in ("range", "window"):
        res = M.mask_sessions(df, session_col="sid", order_col="seq", options=MaskOptions(engines="regex"),
                              strategy=strategy)
        got = {r.doc_id: r.masked_text for r in res.masked.collect()}
        assert got == {1: "mail [EMAIL:1]", 2: "mail [EMAIL:2] and [EMAIL:1]", 3: "mail [EMAIL:1]"}


def test_row_local_equals_session_per_row(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"),
                                F.concat(F.lit("a"), (F.col("id") % 3).cast("string"), F.lit("@x.com b"),
                                         (F.col("id") % 2).cast("string"), F.lit("@x.com a0@x.com")).alias("text"))
    local = M.mask_rows(df, options=MaskOptions(engines="regex"))
    sess = M.mask_sessions(df.withColumn("sid", F.col("doc_id").cast("string")), session_col="sid",
                           options=MaskOptions(engines="regex"))
    a = {r.doc_id: r.masked_text for r in local.masked.collect()}
    b = {r.doc_id: r.masked_text for r in sess.masked.collect()}
    assert a == b


def test_many_hits_in_one_row(spark):
    """Row-local numbering and restore stay exact (and near-linear) with thousands of hits in a row."""
    from pseudoflow.operators import unmask as U

    text = " ".join(f"u{i % 2000}@x.com 10.{i % 7}.{i % 250}.1" for i in range(4000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    from pseudoflow.functions.rules import rule_by_id
    res = M.mask_rows(df, options=MaskOptions(engines="regex"), rules=[rule_by_id("global.ipv4"), rule_by_id("global.email")],
                      persist=True)
    masked = res.masked.first().masked_text
    assert masked.startswith("[IP:1]") is False and masked.startswith("[EMAIL:1] [IP:1]")
    counts = {r.tag: (r.c, r.mx) for r in res.mapping.groupBy("tag").agg(F.count("*").alias("c"), F.max("n").alias("mx")).collect()}
    assert counts["EMAIL"] == (2000, 2000) and counts["IP"][0] == counts["IP"][1]
    assert U.unmask(res.masked, res.mapping).first().restored_text == text
