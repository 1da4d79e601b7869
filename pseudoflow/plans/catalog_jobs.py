"""Registered queries of whole jobs: keys that repeat, extraction on masked text, literal tables, stores, checks.

They join the registry of ``catalog``; sources and oracle SQL follow its conventions.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudoflow.functions.hof import let
from pseudoflow.functions.rules import Rule, rules_for_locale
from pseudoflow.operators import detect as D
from pseudoflow.operators import mask as M
from pseudoflow.operators import unmask as U
from pseudoflow.options import MaskOptions
from pseudoflow.plans import oracle as O
from pseudoflow.plans.catalog import NOTES_SQL, ORACLE, PACKS, _chunks_sql, _source_sql, _status_sql, moody_extractor, register
from pseudoflow.session import ensure_checkpoint_dir
from pseudoflow.sources import pii_notes, read_table
from pseudoflow.sources.store import MappingStore, session_registry
from pseudoflow.streaming import SessionMaskSink, read_batches, restore_stream, run_available

# ---------------------------------------------------------------- M4/T7: keys that repeat, keys and sessions that are null

_REPEATED_SQL = f"""
SELECT *, coalesce(sid0, sha256('run' || chr(0) || coalesce(CAST(k2 AS VARCHAR), chr(1)) || chr(0) || sha256(text))) AS sid FROM (
  SELECT doc_id * 10 + no AS uid, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS k2,
         CASE WHEN no = 1 OR doc_id % 7 <> 0 THEN 's' || no || '-' || session_id END AS sid0, call_seq, lang, text
  FROM (SELECT *, unnest([1, 2]) AS no FROM ({NOTES_SQL}) n0) n1) n2"""
_REPEATED_CTE = O.session_cte_sql(_REPEATED_SQL, "uid", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang", "sid", "call_seq")


def _repeated(spark: SparkSession, sf_dir: str) -> M.MaskResult:
    notes = pii_notes(spark, sf_dir).withColumn("no", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = notes.select(F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("k2"), "call_seq", "lang", "text",
                        F.when((F.col("no") == 1) | (F.col("doc_id") % 7 != 0), F.concat(F.lit("s"), F.col("no").cast("string"), F.lit("-"), "session_id")).alias("sid"))
    return M.mask_sessions(rows, key_col="k2", session_col="sid", order_col="call_seq", options=MaskOptions(engines="regex"), lang_col="lang")


@register("mask_sessions_repeated_keys", _REPEATED_CTE + f"""
SELECT r.k2, r.sid AS session_id, m.masked_text, r.text AS restored_text FROM masked m JOIN ({_REPEATED_SQL}) r ON m.k = r.uid""")
def mask_sessions_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note under its key in two sessions, some keys and some sessions null; masked and restored."""
    res = _repeated(spark, sf_dir).checkpoint()
    return U.unmask(res.masked, res.mapping, "masked_text", "k2").select("k2", "session_id", "masked_text", "restored_text")


@register("token_mapping_repeated_keys", _REPEATED_CTE + """
SELECT sid AS session_id, tag, CAST(n AS BIGINT) AS n, '[' || tag || ':' || CAST(n AS VARCHAR) || ']' AS token, core AS value FROM snum""")
def token_mapping_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of the same rows."""
    return _repeated(spark, sf_dir).mapping


_COLUMNS_SRC = ("SELECT page_id * 10 AS k2, 's' || (page_id % 40) AS sid, page_id * 2 AS cs, url AS text FROM pages "
                "UNION ALL SELECT page_id * 10 + 1, 's' || (page_id % 40), page_id * 2 + 1, html FROM pages")


@register("mask_columns_sessions", O.session_cte_sql(_COLUMNS_SRC, "k2", "text", {"en": PACKS["en"]}, "'en'", "sid", "cs") + """
SELECT k // 10 AS page_id, 's' || (k // 10 % 40) AS session_id, max(CASE WHEN k % 10 = 0 THEN masked_text END) AS url,
       max(CASE WHEN k % 10 = 1 THEN masked_text END) AS html
FROM masked GROUP BY k // 10""")
def mask_columns_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 with shared sessions: url and html of forty groups of pages, numbered page by page, column by column."""
    pages = read_table(spark, sf_dir, "pages").withColumn("sid", F.concat(F.lit("s"), (F.col("page_id") % 40).cast("string")))
    return M.mask_columns(pages, ["url", "html"], "page_id", session_col="sid", order_col="page_id", options=MaskOptions(engines="regex")).masked


# ---------------------------------------------------------------- N1 + M4: extraction on masked text

# Fixed parameters of the stand-in extractor: names of one word (both types, so that they tie) and of two (so that they overlap).
ONE_NAME, TWO_NAMES = r"\b[A-Z][a-z]{7,}\b", r"\b[A-Z][a-z]{7,} [a-z]+\b"


def names_extractor(chunk: str, known: list) -> list:
    one, two = re.findall(ONE_NAME, chunk, re.ASCII), re.findall(TWO_NAMES, chunk, re.ASCII)
    return [{"type": "PERSON", "value": w} for w in one] + [{"type": "ORG", "value": w} for w in two + one]


def _hybrid_sql(masked_sql: str) -> str:
    """Entities of the masked chunks, replaced longest first; PERSON and ORG numbered per row by first replacement."""
    chunks = _chunks_sql().replace("FROM documents", f"FROM (SELECT doc_id, masked_text AS text FROM ({masked_sql}) mm)")

    def found(pattern: str, kind: str) -> str:
        return f"list_transform(regexp_extract_all(chunk, {O.q(pattern)}), lambda w: {{'t': '{kind}', 'v': w}})"

    step = " ".join(
        f"WHEN e.t = '{t}' AND contains(acc.x, e.v) THEN {{'x': replace(acc.x, e.v, '[{t}:' || (acc.{c} + 1) || ']'), 'p': acc.p + {int(c == 'p')}, 'o': acc.o + {int(c == 'o')}}}"
        for t, c in (("PERSON", "p"), ("ORG", "o")))
    return f"""
WITH hm AS ({masked_sql}),
hc AS ({chunks}),
he AS (SELECT doc_id, chunk_no, {found(ONE_NAME, 'PERSON')} || {found(TWO_NAMES, 'ORG')} || {found(ONE_NAME, 'ORG')} AS e FROM hc),
hf AS (SELECT doc_id, chunk_no, generate_subscripts(e, 1) AS i, unnest(e) AS e FROM he),
hd AS (SELECT doc_id, e.t AS t, e.v AS v, min(chunk_no * 10000000 + i) AS f FROM hf GROUP BY ALL),
hl AS (SELECT doc_id, list({{'t': t, 'v': v}} ORDER BY -length(v), f) AS l FROM hd GROUP BY doc_id),
hr AS (SELECT hm.doc_id, list_reduce(coalesce(l, []), lambda acc, e: CASE {step} ELSE acc END, {{'x': masked_text, 'p': 0, 'o': 0}}) AS r
       FROM hm LEFT JOIN hl ON hm.doc_id = hl.doc_id)
SELECT doc_id, r.x AS masked_text, 'ready' AS ner_status FROM hr"""


@register("hybrid_masking_documents", _hybrid_sql(O.mask_rows_sql(_source_sql("documents"), "doc_id", "text", {"en": PACKS["en"]})))
def hybrid_masking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 + M4: rules, then an extractor on the masked chunks whose entities overlap and tie, then the status."""
    res = M.mask_with_extractor(read_table(spark, sf_dir, "documents"), names_extractor, options=MaskOptions(lang="en", engines="hybrid"))
    return res.masked.select("doc_id", "masked_text", "ner_status")


@register("hybrid_restore_documents", "SELECT doc_id, text AS restored_text FROM documents")
def hybrid_restore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 on hybrid masking in shared sessions (one a source): every text comes back."""
    docs = read_table(spark, sf_dir, "documents")
    res = M.mask_with_extractor(docs, names_extractor, options=MaskOptions(lang="en", engines="hybrid"), session_col="source", order_col="doc_id").checkpoint()
    return U.unmask(res.masked, res.mapping, "masked_text", "doc_id").select("doc_id", "restored_text")


# ---------------------------------------------------------------- M2: a table of literals

@register("mask_literal_table", f"""
SELECT m.doc_id, replace(replace(replace(m.masked_text, c.c_name, '[CUSTOM:1]'), 'Client', '[CUSTOM:2]'), 'Klient', '[CUSTOM:2]') AS masked_text
FROM ({O.mask_rows_sql(NOTES_SQL, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang")}) m JOIN customer c ON m.doc_id = c.c_custkey""")
def mask_literal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the names of all customers, in capitals, and two short words are literals of every note."""
    from pseudoflow.operators.literals import with_row_literals
    names = read_table(spark, sf_dir, "customer").select(F.upper("c_name").alias("value"))
    literals = names.unionByName(names.select(F.explode(F.array(F.lit("client"), F.lit("KLIENT"), F.lit(""))).alias("value")))
    notes = with_row_literals(pii_notes(spark, sf_dir), literals)
    return M.mask_rows(notes, options=MaskOptions(engines="regex"), lang_col="lang", literals_col="_literals").masked.select("doc_id", "masked_text")


_BENCH_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM benchmark"


@register("custom_literals_documents", f"""
WITH w AS ({_BENCH_WORDS}),
p AS (SELECT d.doc_id, w.w, (length(d.text) - length(replace(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), w.w, ''))) // length(w.w) AS hits
      FROM documents d JOIN w ON contains(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), w.w))
SELECT doc_id, list_sort(list(w)) AS found FROM p GROUP BY doc_id""")
def custom_literals_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2's candidates: which long words of the benchmark occur in each document, as the anchors find them (exact check: containment)."""
    from pseudoflow.operators.literals import with_row_literals
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{9,}', 0)")).alias("value"))
    docs = with_row_literals(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words)
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # bound once: an expression read inside a lambda is evaluated again for every element
    inside = let({"t": folded, "l": F.col("_literals")}, lambda v: F.filter(v["l"], lambda w: F.contains(v["t"], w)))
    found = docs.select("doc_id", F.array_sort(inside).alias("found"))
    return found.where(F.size("found") > 0)


# ---------------------------------------------------------------- U7: responses with every status

_RESP_MASK = O.mask_rows_sql(_source_sql("documents"), "doc_id", "text", {"en": PACKS["en"]})
_RESP_CHUNKS = _chunks_sql().replace("FROM documents", f"FROM (SELECT doc_id, masked_text AS text FROM ({_RESP_MASK}) mm)")


@register("mask_response_statuses", f"""
WITH r AS (
  SELECT m.doc_id, sha256('run' || chr(0) || CAST(m.doc_id AS VARCHAR) || chr(0) || coalesce(sha256(d.text), '')) AS session_id,
         m.masked_text, s.ner_status
  FROM ({_RESP_MASK}) m JOIN documents d ON m.doc_id = d.doc_id JOIN ({_status_sql(_RESP_CHUNKS)}) s ON m.doc_id = s.doc_id)
SELECT doc_id, session_id, masked_text, true AS auto_unmask, ner_status,
       CASE WHEN ner_status = 'warming_up' THEN {O.q(U.NER_WARNING_WARMING_UP)} END AS ner_warning,
       length(masked_text) + length(ner_status) + CASE WHEN ner_status = 'warming_up' THEN {len(U.NER_WARNING_WARMING_UP)} ELSE 0 END AS body_chars
FROM r""")
def mask_response_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U7 on hybrid masking whose extractor answers, times out or is refused; the JSON body is read back."""
    res = M.mask_with_extractor(read_table(spark, sf_dir, "documents"), moody_extractor, options=MaskOptions(lang="en", engines="hybrid"))
    out = U.mask_response(res.masked, auto_unmask=True, key_cols=("doc_id",))
    body = F.from_json("response_json", "session_id string, masked_text string, auto_unmask boolean, ner_status string, ner_warning string")
    out = out.withColumn("b", body).where("b.session_id = session_id AND b.auto_unmask")
    chars = F.length("b.masked_text") + F.length("b.ner_status") + F.coalesce(F.length("b.ner_warning"), F.lit(0))
    return out.select("doc_id", "session_id", "masked_text", "auto_unmask", "ner_status", "ner_warning", chars.alias("body_chars"))


# ---------------------------------------------------------------- U4 / U5: checks

@register("round_trip_documents", "SELECT source, count(*) AS n_rows, count(*) AS ok_rows FROM documents GROUP BY source")
def round_trip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 by row, and its rate by source."""
    docs = read_table(spark, sf_dir, "documents")
    res = M.mask_rows(docs, options=MaskOptions(engines="regex"), persist=True)
    checked = U.round_trip_check(docs, U.unmask(res.masked, res.mapping, "masked_text", "doc_id"))
    return checked.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("round_trip_ok").cast("long")).alias("ok_rows"))


_LEAKY = """
leaky AS (SELECT m.k, n.session_id, m.masked_text || CASE WHEN m.k % 10 = 0 THEN ' and ' || e.core ELSE '' END AS t
          FROM masked m JOIN notes n ON m.k = n.doc_id LEFT JOIN snum e ON e.sid = n.session_id AND e.tag = 'EMAIL' AND e.n = 1)"""


@register("leak_check_sessions", O.session_cte_sql(NOTES_SQL, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang", "session_id", "call_seq") + f""",
notes AS ({NOTES_SQL}),{_LEAKY}
SELECT l.k AS doc_id, l.session_id, s.core AS leaked_value FROM leaky l JOIN (SELECT DISTINCT sid, core FROM snum) s ON s.sid = l.session_id AND contains(l.t, s.core)""")
def leak_check_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5 across sessions: every tenth masked note repeats an address that another note of its session holds."""
    res = M.mask_sessions(pii_notes(spark, sf_dir), order_col="call_seq", lang_col="lang").checkpoint()
    planted = res.mapping.where("tag = 'EMAIL' AND n = 1").select("session_id", F.col("value").alias("leak"))
    leak = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" and "), "leak")).otherwise(F.lit(""))
    leaky = res.masked.join(planted, "session_id").withColumn("masked_text", F.concat("masked_text", leak))
    return U.leak_check_sessions(leaky, res.mapping)


@register("token_shaped_documents", r"""
SELECT doc_id, len(regexp_extract_all(text, '\[[A-Z_]+:\d+\]')) AS token_like_count
FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' see [REF:' || doc_id || '] and [X_Y:2]' ELSE '' END AS text FROM documents) t
WHERE regexp_matches(text, '\[[A-Z_]+:\d+\]')""")
def token_shaped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold token-shaped text before any masking."""
    note = F.concat(F.lit(" see [REF:"), F.col("doc_id").cast("string"), F.lit("] and [X_Y:2]"))
    docs = read_table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, note).otherwise(F.lit(""))))
    return U.token_shaped_inputs(docs).select("doc_id", "token_like_count")


# ---------------------------------------------------------------- S4 / X1

def _by_locale_sql() -> str:
    parts = [f"SELECT '{loc}' AS locale, '{r.rule_id}' AS rule_id, count(*) FILTER (WHERE valid) AS hits FROM ({O.detect_sql(NOTES_SQL, 'doc_id', 'text', r)}) q{loc}{k}"
             for loc in ("en", "pl") for k, r in enumerate(rules_for_locale(loc))]
    return " UNION ALL ".join(parts)


@register("rules_by_locale", _by_locale_sql())
def rules_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted hits of every rule of a locale (and of the global ones) in the notes."""
    out = None
    for locale in ("en", "pl"):
        rules = rules_for_locale(locale)
        hits = D.detect(pii_notes(spark, sf_dir), rules).groupBy("rule_id").agg(F.count(F.when(F.col("valid"), 1)).alias("hits"))
        names = spark.createDataFrame([(r.rule_id,) for r in rules], "rule_id string")
        part = names.join(hits, "rule_id", "left").select(F.lit(locale).alias("locale"), "rule_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
        out = part if out is None else out.unionByName(part)
    return out


@register("custom_rule", """
SELECT doc_id, i - 1 AS hit_no, h[i] AS value, length(h[i]) % 2 = 0 AS valid FROM (
  SELECT doc_id, h, generate_subscripts(h, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\b[a-z]{14,}\\b') AS h FROM documents) a) b""")
def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the user's with a Column validator: long words, accepted if of even length."""
    rule = Rule("x.long", "LONG", r"\b[a-z]{14,}\b", None, ("paranoid",), "long words", custom_validator=lambda c: F.length(c) % 2 == 0)
    return D.detect(read_table(spark, sf_dir, "documents"), [rule]).select("doc_id", "hit_no", "value", "valid")


# ---------------------------------------------------------------- I1 / I2 / T5: jobs and stores

def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("mask_job_json", ORACLE["token_mapping"])
def mask_job_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + M4 + I2: notes written and read as JSON, masked by the job, the mapping read back from the committed run."""
    from pseudoflow.plans.jobs import mask_job
    from pseudoflow.sources import read_mapping as read_run
    base = _scratch(spark, "job")
    pii_notes(spark, sf_dir).write.json(f"{base}/in")
    mask_job(spark, f"{base}/in", f"{base}/masked", f"{base}/mapping", fmt="json", session_col="session_id", order_col="call_seq", lang_col="lang")
    return read_run(spark, f"{base}/mapping")


@register("mapping_for_session", f"SELECT * FROM ({ORACLE['token_mapping']}) t WHERE session_id = 's7'")
def mapping_for_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: one session from the store, of which a base and a delta are read, and of them one bucket."""
    store = MappingStore(spark, f"{_scratch(spark, 'store')}/mapping", buckets=16)
    notes = pii_notes(spark, sf_dir)
    half = notes.agg(F.max("call_seq")).first()[0] // 2
    kw = dict(order_col="call_seq", lang_col="lang")
    first = M.mask_sessions(notes.where(F.col("call_seq") <= half), **kw)
    store.write(0, first.mapping, session_registry(first.masked, 0))
    store.commit(0)
    store.compact()
    rest = M.mask_sessions(notes.where(F.col("call_seq") > half), existing_mapping=store.mapping(), **kw)
    store.write(1, rest.added, session_registry(rest.masked, 1))
    store.commit(1)
    return store.mapping_for_session("s7")


# ---------------------------------------------------------------- ST2 / ST3 / ST4

_EXPIRY_SRC = f"""
SELECT doc_id, doc_id % 4 AS slice, call_seq, lang, text,
       session_id || CASE WHEN CAST(substr(session_id, 2) AS INT) % 2 = 0 AND doc_id % 4 = 3 THEN chr(31) || '2' ELSE '' END AS sid
FROM ({NOTES_SQL}) n0 WHERE doc_id % 4 IN (0, 3) OR CAST(substr(session_id, 2) AS INT) % 2 = 1"""


@register("stream_expiry", O.session_cte_sql(_EXPIRY_SRC, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang", "sid", "call_seq", batch_expr="slice")
          + f"SELECT m.k AS doc_id, e.sid AS session_id, m.masked_text, e.text AS restored_text FROM masked m JOIN ({_EXPIRY_SRC}) e ON m.k = e.doc_id")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: sessions of even nations rest for two batches of four and start a new generation; all texts restore."""
    base = _scratch(spark, "expiry")
    notes = pii_notes(spark, sf_dir)
    rows = notes.where((F.col("doc_id") % 4).isin(0, 3) | (F.substring("session_id", 2, 9).cast("int") % 2 == 1))
    for n in range(4):
        rows.where(F.col("doc_id") % 4 == n).write.mode("append").parquet(f"{base}/in")
        sink = SessionMaskSink(f"{base}/mapping", f"{base}/masked", order_col="call_seq", lang_col="lang", ttl_batches=1, compact_every=2)
        run_available(spark.readStream.schema(notes.schema).parquet(f"{base}/in"), sink, f"{base}/ckpt")
    masked = read_batches(spark, f"{base}/masked")
    return U.unmask(masked, MappingStore(spark, f"{base}/mapping").mapping(), "masked_text", "doc_id").select("doc_id", "session_id", "masked_text", "restored_text")


@register("stream_state_sessions", ORACLE["token_mapping"])
def stream_state_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 in keyed state: the first third of the notes is numbered by the batch job and given as initial state, the others
    come in two runs of the stream from one checkpoint."""
    from pseudoflow.streaming.state import state_mapping, state_session
    base = _scratch(spark, "state")
    notes = pii_notes(spark, sf_dir)
    third = notes.agg(F.max("call_seq")).first()[0] // 3
    slice_of = F.least(F.floor(F.col("call_seq") / (third + 1)), F.lit(2))
    M.mask_sessions(notes.where(slice_of == 0), order_col="call_seq", lang_col="lang").mapping.write.parquet(f"{base}/first")
    own = state_session(spark)
    for n in (1, 2):
        notes.where(slice_of == n).write.mode("append").parquet(f"{base}/in")
        added = state_mapping(own.readStream.schema(notes.schema).parquet(f"{base}/in"), order_col="call_seq", lang_col="lang", initial=own.read.parquet(f"{base}/first"))
        q = added.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
    later = spark.read.parquet(f"{base}/out").drop("generation")
    return spark.read.parquet(f"{base}/first").unionByName(later)


@register("stream_restore_native", f"SELECT doc_id, text, false AS is_error FROM ({NOTES_SQL}) n")
def stream_restore_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3 without foreachBatch: notes masked in two slices; after each the restore stream runs on from its checkpoint
    with the mapping as it then is."""
    base = _scratch(spark, "native")
    notes = pii_notes(spark, sf_dir)
    half = notes.agg(F.max("call_seq")).first()[0] // 2
    for n, cond in enumerate((F.col("call_seq") <= half, F.col("call_seq") > half)):
        notes.where(cond).write.mode("append").parquet(f"{base}/in")
        sink = SessionMaskSink(f"{base}/mapping", f"{base}/masked", order_col="call_seq", lang_col="lang")
        run_available(spark.readStream.schema(notes.schema).parquet(f"{base}/in"), sink, f"{base}/ck1")
        store = MappingStore(spark, f"{base}/mapping")
        masked = spark.readStream.schema("doc_id long, session_id string, masked_text string").parquet(f"{base}/masked/batch_id=*")
        restored = restore_stream(masked, store.mapping(), store.sessions()).select("doc_id", "text", "is_error")
        q = restored.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck2").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
