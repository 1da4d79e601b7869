"""Skew: a giant session numbered by the range path equals the window path; sinks and custom rules."""

import re
import uuid

from pyspark.sql import functions as F

from pseudoflow.functions.rules import Rule
from pseudoflow.functions.validators import python_validator
from pseudoflow.operators import mask as M
from pseudoflow.operators import tokens as T
from pseudoflow.operators.detect import detect
from pseudoflow.options import MaskOptions
from pseudoflow.session import ensure_checkpoint_dir
from pseudoflow.sources import read_mapping, write_outputs


def test_giant_session_range_equals_window(spark):
    n = 3000
    hits = spark.range(n).select(
        F.col("id").alias("_key"),
        F.when(F.col("id") % 10 < 7, F.lit("giant")).otherwise(F.concat(F.lit("s"), (F.col("id") % 13).cast("string"))).alias("session_id"),
        F.col("id").alias("call_seq"), F.lit(0).alias("pass_no"), F.lit(0).alias("idx"),
        F.when(F.col("id") % 2 == 0, "EMAIL").otherwise("PHONE").alias("tag"),
        (F.col("id") % 997).cast("string").alias("value"))
    a = T.assign_tokens(hits, "range")
    b = T.assign_tokens(hits, "window")
    diff = a.exceptAll(b).count() + b.exceptAll(a).count()
    assert diff == 0
    # dense: numbers of each (session, tag) are 1..count
    dense = a.groupBy("session_id", "tag").agg(F.max("n").alias("mx"), F.count("*").alias("c")).filter("mx <> c").count()
    assert dense == 0


def test_write_and_prune_mapping(spark):
    base = f"{ensure_checkpoint_dir(spark)}/w-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "a", "x@y.com"), (2, "b", "z@y.com")], "doc_id int, sid string, text string")
    res = M.mask_sessions(df, session_col="sid", options=MaskOptions(engines="regex"))
    write_outputs(res.masked, res.mapping, f"{base}/masked", f"{base}/mapping", session_buckets=8)
    one = read_mapping(spark, f"{base}/mapping", session_id="b")
    assert [(r.token, r.value) for r in one.collect()] == [("[EMAIL:1]", "z@y.com")]
    assert re.search(r"PartitionFilters: \[[^\]]*session_bucket", one._jdf.queryExecution().executedPlan().toString())


def test_custom_rule_with_python_validator(spark):
    even = Rule("x.order", "ORDER", r"\bORD-\d{4}\b", None, ("balanced",), "order number",
                custom_validator=python_validator(lambda v: int(v[-1]) % 2 == 0))
    df = spark.createDataFrame([(1, "ORD-1234 and ORD-1235")], "doc_id int, text string")
    got = [(r.value, r.valid) for r in detect(df, [even]).orderBy("hit_no").collect()]
    assert got == [("ORD-1234", True), ("ORD-1235", False)]
    # pattern-only custom rules work inside the masking fold
    plain = Rule("x.order", "ORDER", r"\bORD-\d{4}\b", None, ("balanced",), "order number")
    res = M.mask_rows(df, options=MaskOptions(engines="regex"), rules=[plain])
    assert res.masked.first().masked_text == "[ORDER:1] and [ORDER:2]"


def test_custom_rule_whose_id_looks_built_in(spark):
    """No hint is guessed from a rule's name."""
    title = Rule("en.title", "TITLE", r"\bDr\b", None, ("balanced",), "title")
    df = spark.createDataFrame([(1, "Dr Who lives here")], "doc_id int, text string")
    assert [r.value for r in detect(df, [title]).collect()] == ["Dr"]
    assert M.mask_rows(df, rules=[title]).masked.first()["masked_text"] == "[TITLE:1] Who lives here"


def test_rows_never_share_a_session(spark):
    """Also if the input has session ids or repeated keys; every (session, token) has one value."""
    df = spark.createDataFrame([(1, "s", "a@x.com"), (1, "s", "b@x.com"), (2, "s", "c@x.com")], "doc_id int, session_id string, text string")
    mapping = M.mask_rows(df).mapping
    assert mapping.count() == mapping.select("session_id", "token").distinct().count() == 3
    other = M.mask_rows(df, run_id="another").mapping
    assert mapping.join(other, "session_id").count() == 0


def test_null_session_and_fractions_of_seconds(spark):
    rows = [(1, None, "2024-01-01 00:00:00.9", "late@x.com"), (2, "s", "2024-01-01 00:00:00.9", "late@x.com"), (3, "s", "2024-01-01 00:00:00.1", "early@x.com")]
    df = spark.createDataFrame(rows, "doc_id int, sid string, at string, text string").withColumn("at", F.col("at").cast("timestamp"))
    res = M.mask_sessions(df, session_col="sid", order_col="at", options=MaskOptions(engines="regex"))
    assert {r.doc_id: r.masked_text for r in res.masked.collect()} == {1: "[EMAIL:1]", 2: "[EMAIL:2]", 3: "[EMAIL:1]"}


def test_dictionary_order(spark):
    from pseudoflow.operators.entities import dictionary_entities

    names = spark.createDataFrame([("PERSON", "Ann"), ("PERSON", "Bob"), ("ORG", "Acme"), ("PERSON", "Acme"), ("ORG", "Bob Ltd"),
                                   ("ORG", " "), ("PLACE", "Ann"), ("ORG", None), ("PERSON", "ann")], "type string, value string")
    df = spark.createDataFrame([(1, "Acme hired Bob Ltd and Ann"), (1, "Ann"), (2, None), (3, "nobody")], "doc_id int, text string")
    want = [(0, "ORG", "Acme"), (0, "PERSON", "Ann"), (1, "PERSON", "Acme"), (2, "ORG", "Bob Ltd"), (3, "PERSON", "Bob"), (4, "PERSON", "Ann")]
    got = dictionary_entities(df, names).collect()
    assert sorted((r.entity_no, r.type, r.value) for r in got) == sorted(want) and {r.doc_id for r in got} == {1}
