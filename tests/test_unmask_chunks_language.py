"""Restore edge cases, response rows, chunking, replies, status, language."""

import pytest
from pyspark.sql import functions as F

from pseudoflow.operators import chunks as C
from pseudoflow.operators import entities as N
from pseudoflow.operators import language as L
from pseudoflow.operators import unmask as U


def test_unknown_tokens_and_sessions(spark):
    mapping = spark.createDataFrame([("s", "EMAIL", 1, "[EMAIL:1]", "a@b.com")], "session_id string, tag string, n long, token string, value string")
    df = spark.createDataFrame([(1, "s", "to [EMAIL:1] and [EMAIL:2]"), (2, "s", "no tokens"), (3, "zz", "[EMAIL:1]")],
                               "doc_id int, session_id string, masked_text string")
    got = {r.doc_id: (r.text, r.is_error) for r in U.unmask_checked(df, mapping).collect()}
    assert got[1] == ("to a@b.com and [EMAIL:2]", False)
    assert got[2] == ("no tokens", False)
    assert got[3][1] is True and 'session "zz" not found' in got[3][0]


MAPPING = "session_id string, tag string, n long, token string, value string"


def test_answers_that_share_a_key_are_not_mixed(spark):
    """Several answers of a document, null keys and sessions, equal answers, an empty session."""
    mapping = spark.createDataFrame([("s", "EMAIL", 1, "[EMAIL:1]", "a@s.com"), ("s", "EMAIL", 2, "[EMAIL:2]", "b@s.com"),
                                     ("t", "EMAIL", 1, "[EMAIL:1]", "c@t.com")], MAPPING)
    rows = [(1, "s", "[EMAIL:1]"), (1, "s", "[EMAIL:2] [EMAIL:1]"), (1, "t", "[EMAIL:1]"), (None, "t", "x [EMAIL:1]"), (1, None, "[EMAIL:1]"),
            (1, "s", "[EMAIL:1]"), (2, "u", "nothing"), (3, "s", None)]
    df = spark.createDataFrame(rows, "doc_id int, session_id string, masked_text string")
    got = sorted(((r.doc_id, r.session_id, r.masked_text, r.restored_text) for r in U.unmask(df, mapping).collect()), key=str)
    texts = ["a@s.com", "b@s.com a@s.com", "c@t.com", "x c@t.com", "[EMAIL:1]", "a@s.com", "nothing", None]
    assert got == sorted([(*r, x) for r, x in zip(rows, texts)], key=str)
    known = spark.createDataFrame([("s",), ("t",), ("u",)], "session_id string")
    flags = {(r.session_id, r.is_error) for r in U.unmask_checked(df, mapping, known_sessions=known).collect()}
    assert flags == {("s", False), ("t", False), ("u", False), (None, True)}


def test_mapping_with_two_values_is_refused(spark):
    mapping = spark.createDataFrame([("s", "EMAIL", 1, "[EMAIL:1]", "a@s.com"), ("s", "EMAIL", 1, "[EMAIL:1]", "b@s.com")], MAPPING)
    df = spark.createDataFrame([(1, "s", "[EMAIL:1]")], "doc_id int, session_id string, masked_text string")
    with pytest.raises(Exception, match="two values"):
        U.unmask(df, mapping).collect()


def test_text_of_an_unknown_session_is_kept(spark):
    mapping = spark.createDataFrame([], MAPPING)
    df = spark.createDataFrame([(1, "s", "[EMAIL:1]")], "doc_id int, session_id string, text string")
    row = U.unmask_checked(df, mapping, "text").first()
    assert row.is_error and row.masked_text == "[EMAIL:1]" and row.text.startswith("Error: session")


def test_mask_response_warning(spark):
    df = spark.createDataFrame([("s", "x", "warming_up"), ("t", "y", "ready")], "session_id string, masked_text string, ner_status string")
    rows = {r.session_id: r for r in U.mask_response(df).collect()}
    assert rows["s"].ner_warning.startswith("NER unavailable") and rows["t"].ner_warning is None
    assert "ner_warning" not in rows["t"].response_json


def chunk(spark, text, n=800):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [r.chunk for r in C.chunk_documents(df, max_len=n).orderBy("chunk_no").collect()]


def test_chunking(spark):
    short = "Jan Kowalski złożył pozew przeciwko BNP Paribas."
    assert chunk(spark, short) == [short]
    assert chunk(spark, "") == [""]
    assert chunk(spark, "no punctuation at all here and more words", 30) == ["no punctuation at all here and more words"]
    long = "This is sentence number one. " * 50
    parts = chunk(spark, long)
    assert all(len(p) <= 800 for p in parts) and len(parts) >= 2
    four = "First sentence here. Second sentence here. Third sentence here. Fourth sentence here."
    parts = chunk(spark, four, 50)
    for a, b in zip(parts, parts[1:]):
        last = C_last_sentence(a)
        assert b.startswith(last)


def C_last_sentence(text):
    import re
    return re.findall(r".*?[.!?]\s+|.+$", text)[-1]


def test_replies_and_status(spark):
    df = spark.createDataFrame([
        (1, 'ok [{"type":"PERSON","value":"Ann"},{"type":"LOC","value":"x"},{"type":"ORG","value":5},{"type":"ORG","value":" "}] bye'),
        (2, "no json here"), (3, '[{"type":"PERSON","value":"Bob"}')], "doc_id int, reply string")
    got = [(r.doc_id, r.type, r.value) for r in N.parse_model_replies(df).collect()]
    assert got == [(1, "PERSON", "Ann")]
    res = spark.createDataFrame([(1, 0, False, True), (1, 1, True, False), (2, 0, False, True), (3, 0, False, False)],
                                "doc_id int, chunk_no int, ok boolean, timeout boolean")
    st = {r.doc_id: r.ner_status for r in N.ner_status(res).collect()}
    assert st == {1: "ready", 2: "warming_up", 3: "disabled"}


def test_extractor_with_failing_chunk(spark):
    text = "Alpha Person works. " * 30 + "Beta Corp signs. " * 30

    def extractor(chunk, known):
        if "Alpha" in chunk and not known:
            raise TimeoutError("slow")
        out = []
        if "Alpha Person" in chunk:
            out.append({"type": "PERSON", "value": "Alpha Person"})
        if "Beta Corp" in chunk:
            out.append({"type": "ORG", "value": "Beta Corp"})
        return out

    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    res = N.extract_entities(df, extractor).cache()
    status = N.ner_status(res).first().ner_status
    ents = {(r.type, r.value) for r in N.merge_entities(N.entities_of(res)).collect()}
    assert status == "ready" and ("ORG", "Beta Corp") in ents


def test_language_ladder(spark):
    train = spark.createDataFrame([
        ("en", "The quick brown fox jumps over the lazy dog while the weather is nice and the children play outside."),
        ("en", "This is an English sentence with many common words that we use every day in the office and at home."),
        ("pl", "To jest polskie zdanie z wieloma typowymi słowami które używamy codziennie w pracy i w domu."),
        ("pl", "Szybki brązowy lis przeskakuje nad leniwym psem podczas gdy dzieci bawią się na podwórku."),
        ("de", "Der schnelle braune Fuchs springt über den faulen Hund während die Kinder draußen spielen."),
    ], "lang string, text string")
    prof = L.train_language_profiles(train)
    docs = spark.createDataFrame([(1, "Hello"), (2, "   "), (3, "We use these common words every day at home and in the office."),
                                  (4, "Dzieci bawią się codziennie na podwórku i w domu z psem."),
                                  (5, "Die Kinder spielen draußen mit dem faulen Hund.")], "doc_id int, text string")
    got = {r.doc_id: (r.detected, r.source, r.raw) for r in L.detect_language(docs, prof).collect()}
    assert got[1] == ("unknown", "fallback", None) and got[2] == ("unknown", "fallback", None)
    assert got[3] == ("en", "text", "eng") and got[4] == ("pl", "text", "pol")
    assert got[5][0] == "unknown" and got[5][2] is not None


def test_leak_check_and_token_shaped_inputs(spark):
    from pseudoflow.operators import mask as M
    from pseudoflow.operators.tokens import hits_table
    from pseudoflow.options import MaskOptions

    df = spark.createDataFrame([(1, "mail a@b.com"), (2, "x4111111111111111 and 4111111111111111"), (3, "see [EMAIL:7]")],
                               "doc_id int, text string")
    res = M.mask_rows(df, options=MaskOptions(lang="en", engines="regex"))
    seg = M.segment(df, options=MaskOptions(lang="en", engines="regex")).withColumn("session_id", F.lit("s"))
    h = hits_table(seg, "doc_id").withColumnRenamed("_key", "doc_id")
    leaks = {(r.doc_id, r.leaked_value) for r in U.leak_check(res.masked, h).collect()}
    assert leaks == {(2, "4111111111111111")}  # the copy glued to a word is not a hit
    assert [r.doc_id for r in U.token_shaped_inputs(df).collect()] == [3]


def test_a_task_works_on_small_pieces_of_a_batch(spark):
    """Of any Arrow batch only some rows are Python objects at a time; the rows and their order stay."""
    import pyarrow as pa

    from pseudoflow.functions.arrow import ROWS, in_pieces

    sizes = []

    def run(batch):
        sizes.append(batch.num_rows)
        return batch

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["a"]) for n in (1000, 0, 1)]
    out = list(in_pieces(run)(iter(batches)))
    assert max(sizes) <= ROWS and [x for b in out for x in b.column(0).to_pylist()] == [*range(1000), 0]
