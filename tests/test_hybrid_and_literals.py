"""Extraction on masked text, keys that repeat or are null, tables of literals."""

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pseudoflow.operators import literals as L
from pseudoflow.operators import mask as M
from pseudoflow.operators import unmask as U
from pseudoflow.options import MaskOptions
from pseudoflow.session import ensure_checkpoint_dir

HYBRID = MaskOptions(lang="en", engines="hybrid")


def _extractor():
    """Fails on any text that a rule would have masked; finds names, some inside others, some twice."""

    def guarded(chunk, known):
        if re.search(r"@|\d{3}-\d{2}-\d{4}|secret", chunk):
            raise AssertionError("a masked value reached the extractor")
        names = [("ORG", "Ann Lee Ltd"), ("PERSON", "Ann Lee"), ("PERSON", "Ann"), ("ORG", "Ann"), ("PERSON", "EMAIL"), ("PERSON", " Bob "), ("ORG", "  "), ("PLACE", "Rome")]
        return [{"type": t, "value": v} for t, v in names if v in chunk or v == "EMAIL" or v.strip() in chunk]

    return guarded  # not importable by name, so it travels by value


guarded = _extractor()


ROWS = [(1, "s", 1, "Ann Lee Ltd wrote a@x.com and Ann Lee. Bob said Ann."), (1, "t", 1, "b@x.com for Ann Lee Ltd, Anna"),
        (None, "s", 2, "Bob again, a@x.com, my Secret"), (2, None, 1, "SSN 123-45-6789 of Ann"), (2, None, 1, "SSN 123-45-6788 of Bob"), (3, "s", 3, None), (4, "s", 4, "")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id int, sid string, seq int, text string").repartition(3)


def test_no_rule_or_literal_hit_reaches_the_extractor(spark, rows):
    opts = MaskOptions(lang="en", engines="hybrid", custom_literals=("secret",))
    for kw in ({}, {"session_col": "sid", "order_col": "seq"}):
        res = M.mask_with_extractor(rows, guarded, options=opts, keep_cols=["text"], **kw).checkpoint()
        got = res.masked.collect()
        assert len(got) == len(ROWS)
        # a text without chunks was never asked about
        assert all(r.ner_status == ("disabled" if r.text is None else "ready") for r in got)
        back = U.unmask(res.masked, res.mapping, "masked_text", "doc_id").collect()
        assert all(r.restored_text == r.text for r in back)
        values = [(r.session_id, r.tag, r.value) for r in res.mapping.collect()]
        assert len(values) == len(set(values)) and not any(v == "EMAIL" for _, _, v in values)


def test_overlaps_and_ties_go_to_the_longest_then_the_first(spark, rows):
    res = M.mask_with_extractor(rows, guarded, options=HYBRID, session_col="sid", order_col="seq", keep_cols=["text"])
    got = {r.text: r.masked_text for r in res.masked.collect()}
    assert got[ROWS[0][3]] == "[ORG:1] wrote [EMAIL:1] and [PERSON:1]. [PERSON:2] said [PERSON:3]."
    assert got[ROWS[2][3]] == "[PERSON:2] again, [EMAIL:1], my Secret"
    assert got[ROWS[1][3]] == "[EMAIL:1] for [ORG:1], [PERSON:1]a" and got[""] == ""


def test_sessions_continue_a_mapping(spark, rows):
    first = M.mask_with_extractor(rows.where("seq = 1"), guarded, options=HYBRID, session_col="sid", order_col="seq").checkpoint()
    more = M.mask_with_extractor(rows.where("seq > 1"), guarded, options=HYBRID, session_col="sid", order_col="seq", existing_mapping=first.mapping)
    got = {r.masked_text for r in more.masked.collect()}
    assert "[PERSON:2] again, [EMAIL:1], my Secret" in got
    assert more.added.count() == 0


def test_repeated_and_null_keys_keep_their_texts(spark, rows):
    res = M.mask_sessions(rows, session_col="sid", order_col="seq", options=MaskOptions(engines="regex"), keep_cols=["text"]).checkpoint()
    back = U.unmask(res.masked, res.mapping, "masked_text", "doc_id").collect()
    assert len(back) == len(ROWS) and all(r.restored_text == r.text for r in back)
    own = res.masked.where("doc_id = 2").select("session_id").distinct().count()
    assert own == 2  # two calls without a session
    other = M.mask_sessions(rows, session_col="sid", order_col="seq", run_id="another", options=MaskOptions(engines="regex"))
    named = {r.session_id for r in res.masked.collect()} & {r.session_id for r in other.masked.collect()}
    assert named == {"s", "t"}


def test_columns_of_rows_with_one_key(spark):
    df = spark.createDataFrame([(1, "x@a.com", "y@a.com x@a.com"), (1, "z@a.com", None), (None, None, "x@a.com"), (None, "", "")], "k int, a string, b string")
    res = M.mask_columns(df, ["a", "b"], "k")
    got = sorted(((r.a, r.b) for r in res.masked.collect()), key=str)
    assert got == sorted([("[EMAIL:1]", "[EMAIL:2] [EMAIL:1]"), ("[EMAIL:1]", None), (None, "[EMAIL:1]"), ("", "")], key=str)
    assert res.masked.columns == ["k", "session_id", "a", "b"]
    shared = M.mask_columns(df.withColumn("s", F.lit("s")), ["a", "b"], "k", session_col="s")
    values = {r.value: r.n for r in shared.mapping.collect()}
    assert values["x@a.com"] == 1 and sorted(values.values()) == [1, 2, 3]  # the null key's row comes first


def test_job_with_extractor_literals_and_runs(spark, rows):
    from pseudoflow.plans.jobs import mask_job
    from pseudoflow.sources import read_mapping

    base = f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    rows.withColumn("lits", F.array(F.lit("SECRET"))).write.parquet(f"{base}/in")
    runs = [mask_job(spark, f"{base}/in", f"{base}/m{k}", f"{base}/v{k}", options=HYBRID, extractor=guarded, literals_col="lits") for k in (0, 1)]
    ids = [{r.session_id for r in spark.read.parquet(f"{base}/m{k}").collect()} for k in (0, 1)]
    assert runs[0] != runs[1] and not ids[0] & ids[1]
    masked = spark.read.parquet(f"{base}/m0")
    assert masked.where("ner_status = 'ready'").count() == 6 and masked.where("masked_text like '%my [CUSTOM:1]'").count() == 1
    back = U.unmask(masked, read_mapping(spark, f"{base}/v0"), "masked_text", "doc_id")
    assert {r.restored_text for r in back.collect()} == {r[3] for r in ROWS}


# ---------------------------------------------------------------- tables of literals


def test_literal_table_equals_literals_in_the_plan(spark):
    rng = np.random.default_rng(2)
    letters = list("abcAB éÉßẞſKkσςΣıİi.*(1")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(80)] + ["x" * 3000 + "abcab", ""]
    lits = list({"".join(rng.choice(letters, int(rng.integers(1, 8)))) for _ in range(40)}) + ["straße", "I"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(500, None)], "doc_id int, text string").repartition(4)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(lits)] + [(90, None), (91, "")] , "no int, value string").repartition(3)
    opts = MaskOptions(engines="llm")
    want = M.mask_rows(df, options=MaskOptions(engines="llm", custom_literals=tuple(lits)))
    found = L.with_row_literals(df, table, order_col="no")
    got = M.mask_rows(found, options=opts, literals_col="_literals")
    a, b = ({r.doc_id: r.masked_text for r in x.masked.collect()} for x in (want, got))
    assert a == b and len(a) == 83 and sum("[CUSTOM:1]" in (t or "") for t in a.values()) > 40


def test_many_literals_cost_no_plan(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("Order No-"), F.col("id") * 7, F.lit(" is here")).alias("text"))
    table = spark.range(20_000).select(F.concat(F.lit("no-"), F.col("id").cast("string"), F.lit(" ")).alias("value"))
    res = M.mask_rows(L.with_row_literals(df, table), options=MaskOptions(engines="llm"), literals_col="_literals")
    assert {r.masked_text for r in res.masked.collect()} == {"Order [CUSTOM:1]is here"}
    assert len(res.masked._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_long_literals_meet_their_own_rows_only(spark):
    """Names that share every short gram: the anchor of a long value is long, and texts are noted once."""
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 37).cast("string"), 9, "0"))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Client "), name, F.lit(" owes 00011100")).alias("text"))
    found = L.with_row_literals(df, spark.range(3000).select(F.upper(name).alias("value")))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.c for r in found.select(F.size("_literals").alias("c")).collect()} == {1}
    short = L.with_row_literals(df, spark.createDataFrame([("t",), ("customer",), ("CLIENT CUSTOMER#00",), ("nt c",)], "value string"))
    assert {r.c for r in short.select(F.size("_literals").alias("c")).collect()} == {4}


def test_many_entities_of_a_long_text_are_replaced_in_time(spark):
    """A text of 6,000 names: passes longest first, none inside a hit, digits and brackets are plain characters."""
    import time

    from pseudoflow.operators import segments as S

    names = [f"Name{i}" for i in range(6000)]
    text, ents = " ".join(names), [("PERSON", n) for n in names] + [("ORG", "Name1 Name2"), ("ORG", "[x](1)")]
    rows = spark.createDataFrame([(text, ents), ("b Name1 Name2 [x](1) Name13", ents), ("", ents), (None, ents), ("Name1", None), ("Name1", [])],
                                 "text string, ents array<struct<type: string, value: string>>")
    passed = S.with_entity_passes(rows.withColumn("segs", S.initial_segments(F.col("text"))), "segs", F.col("ents"), 100)
    began = time.time()
    got = [r[0] for r in passed.select("segs").collect()]
    assert time.time() - began < 20
    plain = [[s["txt"] if s["tag"] is None else (s["tag"], s["txt"]) for s in r] if r is not None else None for r in got]
    assert "".join(s["txt"] for s in got[0]) == text
    assert plain[0][:4] == [("PERSON", "Name0"), " ", ("ORG", "Name1 Name2"), " "] and plain[0][4::2] == [("PERSON", n) for n in names[3:]]
    assert plain[1:] == [["b ", ("ORG", "Name1 Name2"), " ", ("ORG", "[x](1)"), " ", ("PERSON", "Name13")], [""], None, None, ["Name1"]]
