"""Registered queries over the shipped tables and their DuckDB oracle SQL.

Every query reads whole tables (or data Spark derives from them) and returns flat, aliased
columns so that the Spark result and the oracle can be compared value by value.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudoflow.functions.rules import rule_by_id, rules_for_language
from pseudoflow.operators import chunks as C
from pseudoflow.operators import detect as D
from pseudoflow.operators import mask as M
from pseudoflow.operators import unmask as U
from pseudoflow.options import MaskOptions
from pseudoflow.plans import oracle as O
from pseudoflow.sources import PII_NOTES_SQL, PLACE_NOTES_SQL, pii_notes, place_notes, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOTES_SQL = PII_NOTES_SQL.format(customer="customer")
PLACES_SQL = PLACE_NOTES_SQL.format(customer="customer")
PACKS = {"en": rules_for_language("en"), "pl": rules_for_language("pl")}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- D1: one detector per rule

DETECT_SOURCES = {
    # rule id -> (query name, table)
    "global.email": ("detect_email", "documents"),
    "en.credit-card": ("detect_credit_card", "documents"),
    "en.phone": ("detect_us_phone", "documents"),
    "global.ipv4": ("detect_ipv4", "documents"),
    "global.phone": ("detect_global_phone", "documents"),
    "global.ipv6": ("detect_ipv6", "places"),
    "global.url": ("detect_url", "places"),
    "en.ssn": ("detect_ssn", "notes"),
    "pl.pesel": ("detect_pesel", "notes"),
    "pl.iban": ("detect_pl_iban", "notes"),
    "pl.phone": ("detect_pl_phone", "notes"),
    "pl.nip": ("detect_nip", "notes"),
    "pl.postal-code": ("detect_postal_code", "places"),
    "en.zip-code": ("detect_zip_code", "places"),
    "global.iban": ("detect_global_iban", "notes"),
}


def _source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    if table == "notes":
        return pii_notes(spark, sf_dir)
    if table == "places":
        return place_notes(spark, sf_dir)
    if table == "pages":
        return read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return read_table(spark, sf_dir, table).select("doc_id", "text")


def _source_sql(table: str) -> str:
    if table == "notes":
        return NOTES_SQL
    if table == "places":
        return PLACES_SQL
    if table == "pages":
        return "SELECT page_id AS doc_id, html AS text FROM pages"
    return f"SELECT doc_id, text FROM {table}"


def _make_detect(rule_id: str, table: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = D.detect(_source(spark, sf_dir, table), [rule_by_id(rule_id)])
        return spans.select("doc_id", "hit_no", "value", "valid")
    return q


for _rid, (_name, _table) in DETECT_SOURCES.items():
    register(_name, O.detect_sql(_source_sql(_table), "doc_id", "text", rule_by_id(_rid)))(_make_detect(_rid, _table))


@register("detect_page_urls", O.detect_sql("SELECT page_id AS doc_id, url AS text FROM pages", "doc_id", "text", rule_by_id("global.url")))
def detect_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 on the addresses of the pages, where every row has a hit."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    return D.detect(pages, [rule_by_id("global.url")]).select("doc_id", "hit_no", "value", "valid")


# ---------------------------------------------------------------- M1/M4/T8: row-local masking

@register("mask_documents_en", O.mask_rows_sql(_source_sql("documents"), "doc_id", "text", {"en": PACKS["en"]}))
def mask_documents_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    res = M.mask_rows(docs, options=MaskOptions(lang="en", engines="regex"))
    return res.masked.select("doc_id", "masked_text")


@register("mask_pages_en", O.mask_rows_sql(_source_sql("pages"), "doc_id", "text", {"en": PACKS["en"]}))
def mask_pages_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = M.mask_rows(_source(spark, sf_dir, "pages"), options=MaskOptions(lang="en", engines="regex"))
    return res.masked.select("doc_id", "masked_text")


@register("mask_notes_by_lang", O.mask_rows_sql(NOTES_SQL, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang"))
def mask_notes_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = M.mask_rows(pii_notes(spark, sf_dir), options=MaskOptions(engines="regex"), lang_col="lang")
    return res.masked.select("doc_id", "masked_text")


@register("mask_notes_lenient",
          O.mask_rows_sql(NOTES_SQL, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang", strict=False))
def mask_notes_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: validators off — invalid SSN / card / NIP values are masked too."""
    res = M.mask_rows(pii_notes(spark, sf_dir), options=MaskOptions(engines="regex", strict_validation=False),
                      lang_col="lang")
    return res.masked.select("doc_id", "masked_text")


# ---------------------------------------------------------------- T1/T2: sessions

_SESSION_CTE = O.session_cte_sql(NOTES_SQL, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang",
                                 "session_id", "call_seq")


def _notes_sessions(spark: SparkSession, sf_dir: str, strategy: str = "range") -> M.MaskResult:
    return M.mask_sessions(pii_notes(spark, sf_dir), session_col="session_id", order_col="call_seq",
                           options=MaskOptions(engines="regex"), lang_col="lang", strategy=strategy)


@register("session_masking", _SESSION_CTE + "\nSELECT k AS doc_id, masked_text FROM masked")
def session_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes_sessions(spark, sf_dir).masked.select("doc_id", "masked_text")


_MAPPING_SQL = _SESSION_CTE + """
SELECT sid AS session_id, tag, CAST(n AS BIGINT) AS n, '[' || tag || ':' || CAST(n AS VARCHAR) || ']' AS token, core AS value
FROM snum"""


@register("token_mapping", _MAPPING_SQL)
def token_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes_sessions(spark, sf_dir).mapping


@register("token_mapping_window", _MAPPING_SQL)
def token_mapping_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same mapping through the per-(session, tag) window path."""
    return _notes_sessions(spark, sf_dir, "window").mapping


@register("unmask_roundtrip", f"SELECT doc_id, text AS restored_text FROM ({NOTES_SQL}) n")
def unmask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoring the session-masked notes gives the original text back."""
    res = _notes_sessions(spark, sf_dir).checkpoint()
    return U.unmask(res.masked, res.mapping, "masked_text", "doc_id").select("doc_id", "restored_text")


@register("unmask_documents", "SELECT doc_id, text AS restored_text FROM documents")
def unmask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1/U2 on row-local sessions: every document restores to its input."""
    res = M.mask_rows(read_table(spark, sf_dir, "documents"), options=MaskOptions(lang="en", engines="regex"),
                      persist=True)
    return U.unmask(res.masked, res.mapping, "masked_text", "doc_id").select("doc_id", "restored_text")


# ---------------------------------------------------------------- C1: sentences

_SENT_RE2 = r"(?s).*?[.!?][" + O.WS_BODY["re2"] + r"]+|.+"


@register("sentences", f"""
SELECT doc_id, sentence_no, sentence FROM (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS sentence_no, unnest(s) AS sentence FROM (
    SELECT doc_id, CASE WHEN len(x) = 0 THEN [text] ELSE x END AS s
    FROM (SELECT doc_id, text, regexp_extract_all(text, {O.q(_SENT_RE2)}) AS x FROM documents) a) b) c""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_sentences(read_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- D1 over a whole pack

@register("detect_all_en", "\nUNION ALL\n".join(
    f"SELECT doc_id, '{r.rule_id}' AS rule_id, hit_no, value, valid FROM ({O.detect_sql(_source_sql('documents'), 'doc_id', 'text', r)}) x{k}"
    for k, r in enumerate(PACKS["en"])))
def detect_all_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 with the English pack, all rules in one scan of the table."""
    return D.detect(read_table(spark, sf_dir, "documents"), PACKS["en"]).select("doc_id", "rule_id", "hit_no", "value", "valid")


# ---------------------------------------------------------------- D2: spans actually masked

def _seq_spans_sql() -> str:
    alt = "|".join(f"(?:{O.re2_of(r)})" for r in PACKS["en"])
    cls = O._classify(PACKS["en"], "hit")
    tag = O._case(PACKS["en"], "rk", lambda r: O.q(r.tag))
    ok = O._case(PACKS["en"], "rk", lambda r: O.valid_sql(r, "hit"))
    return f"""
WITH parts AS (SELECT doc_id, regexp_extract_all(text, {O.q(alt)}) AS h, regexp_split_to_array(text, {O.q(alt)}) AS p FROM documents),
hits AS (SELECT doc_id, h, p, generate_subscripts(h, 1) AS i, unnest(h) AS hit FROM parts),
cls AS (SELECT *, {cls} AS rk FROM hits)
SELECT doc_id, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
       + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start,
       {tag} AS tag, hit AS value
FROM cls WHERE coalesce({ok}, false)"""


@register("detect_sequential", _seq_spans_sql())
def detect_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    segd = M.segment(docs, options=MaskOptions(lang="en", engines="regex"))
    return D.detect_sequential(segd).select("doc_id", "start", "tag", "value")


# ---------------------------------------------------------------- D3 / S2 / S3

_REPORT_RULES = [*PACKS["en"], rule_by_id("global.ipv4")]


@register("pii_report_by_source", f"""
WITH spans AS ({" UNION ALL ".join(
    f"SELECT doc_id, '{r.tag}' AS tag, value, valid FROM ({O.detect_sql(_source_sql('documents'), 'doc_id', 'text', r)}) y{k}"
    for k, r in enumerate(_REPORT_RULES))})
SELECT d.source, s.tag, count(*) FILTER (WHERE s.valid) AS hits,
       count(DISTINCT s.value) FILTER (WHERE s.valid) AS distinct_values,
       count(*) FILTER (WHERE NOT s.valid) AS rejected,
       count(DISTINCT s.doc_id) FILTER (WHERE s.valid) AS documents
FROM spans s JOIN documents d ON s.doc_id = d.doc_id GROUP BY d.source, s.tag""")
def pii_report_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pseudoflow.operators.report import pii_report
    docs = read_table(spark, sf_dir, "documents")
    spans = D.detect(docs, _REPORT_RULES, carry=["source"])
    return pii_report(spans, None, ["source"])


@register("pii_report_daily", f"""
WITH spans AS ({" UNION ALL ".join(
    f"SELECT doc_id, '{r.tag}' AS tag, value, valid FROM ({O.detect_sql(_source_sql('documents'), 'doc_id', 'text', r)}) y{k}"
    for k, r in enumerate(_REPORT_RULES))})
SELECT d.source, s.tag, count(*) FILTER (WHERE s.valid) AS hits, count(*) FILTER (WHERE NOT s.valid) AS rejected,
       true AS values_close, true AS documents_close
FROM spans s JOIN documents d ON s.doc_id = d.doc_id GROUP BY d.source, s.tag""")
def pii_report_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 from seven daily sketch tables that are merged; the estimates are held against the exact report (5 %)."""
    from pseudoflow.operators.report import merge_sketches, pii_report, pii_sketch
    from pseudoflow.session import materialize
    docs = read_table(spark, sf_dir, "documents").withColumn("day", F.col("doc_id") % 7)
    spans = D.detect(docs, _REPORT_RULES, carry=["source", "day"])
    daily = materialize(pii_sketch(spans, None, ["day", "source"]))
    merged = merge_sketches(daily, ["source"])
    exact = pii_report(spans, None, ["source"]).select("source", "tag", F.col("distinct_values").alias("v"), F.col("documents").alias("d"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.05 + 0.5
    both = merged.join(exact, merged["source"].eqNullSafe(exact["source"]) & (merged["tag"] == exact["tag"]))
    return both.select(merged["source"], merged["tag"], "hits", "rejected", close("distinct_values", "v").alias("values_close"),
                       close("documents", "d").alias("documents_close"))


def _rules_by_level_sql() -> str:
    from pseudoflow.functions.rules import RULES
    vals = ", ".join(f"('{lv}', '{r.rule_id}', '{r.tag}')" for r in RULES for lv in r.levels)
    counts = " UNION ALL ".join(
        f"SELECT '{r.rule_id}' AS rule_id, count(*) FILTER (WHERE valid) AS hits FROM ({O.detect_sql(_source_sql('documents'), 'doc_id', 'text', r)}) z{k}"
        for k, r in enumerate(RULES))
    return f"""
SELECT c.level, c.rule_id, c.tag, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits
FROM (VALUES {vals}) c(level, rule_id, tag) LEFT JOIN ({counts}) h ON c.rule_id = h.rule_id"""


@register("rules_by_level", _rules_by_level_sql())
def rules_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue (a 15-row dimension, broadcast) with accepted hits per rule on documents."""
    from pseudoflow.functions.rules import RULES, rule_catalog
    docs = read_table(spark, sf_dir, "documents")
    hits = D.detect(docs, list(RULES)).groupBy("rule_id").agg(F.count(F.when(F.col("valid"), 1)).alias("hits"))
    cat = rule_catalog(spark).select("rule_id", "tag", F.explode("levels").alias("level"))
    return F.broadcast(cat).join(hits, "rule_id", "left") \
        .select("level", "rule_id", "tag", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


# ---------------------------------------------------------------- C2: chunks

def _chunks_sql(max_len: int = C.DEFAULT_MAX_LEN) -> str:
    init = ("{'chunks': []::VARCHAR[], 'cur': '', 'cur_len': 0::BIGINT, 'last': '', 'last_len': 0::BIGINT}")
    step = (f"CASE WHEN acc.cur_len + length(sx) > {max_len} AND acc.cur_len > 0 THEN "
            "{'chunks': list_append(acc.chunks, acc.cur), 'cur': acc.last || sx, 'cur_len': acc.last_len + length(sx), "
            "'last': sx, 'last_len': length(sx)} ELSE "
            "{'chunks': acc.chunks, 'cur': acc.cur || sx, 'cur_len': acc.cur_len + length(sx), "
            "'last': sx, 'last_len': length(sx)} END")
    return f"""
WITH s AS (
  SELECT doc_id, text, CASE WHEN len(x) = 0 THEN [text] ELSE x END AS sents
  FROM (SELECT doc_id, text, regexp_extract_all(text, {O.q(_SENT_RE2)}) AS x FROM documents) a),
f AS (SELECT doc_id, text, list_reduce(sents, lambda acc, sx: {step}, {init}) AS acc FROM s),
c AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN [''] WHEN acc.cur_len > 0 THEN list_append(acc.chunks, acc.cur)
                          ELSE acc.chunks END AS chunks FROM f)
SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk_no, unnest(chunks) AS chunk FROM c"""


@register("chunks", _chunks_sql())
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(read_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- M2: literals in sessions

# Fixed parameters of this query: two case-insensitive literals that cannot overlap each other.
CONV_LITERALS = ("que", "vi")


def _literal_rules():
    from pseudoflow.functions.rules import Rule
    ordered = sorted(CONV_LITERALS, key=lambda x: -len(x))
    return [Rule(f"literal.{i}", "CUSTOM", lit, None, (), "literal", flags="i") for i, lit in enumerate(ordered)]


_CONV_SRC = "SELECT conv_id * 100000 + turn AS msg_id, CAST(conv_id AS VARCHAR) AS sid, turn, text FROM conversations"


@register("custom_literals_conversations", O.session_cte_sql(
    _CONV_SRC, "msg_id", "text", {"any": _literal_rules()}, "'any'", "sid", "turn")
    + "\nSELECT k AS msg_id, masked_text FROM masked")
def custom_literals_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + T1: literals masked everywhere, numbered per conversation in turn order."""
    conv = read_table(spark, sf_dir, "conversations") \
        .select((F.col("conv_id") * 100000 + F.col("turn")).alias("msg_id"),
                F.col("conv_id").cast("string").alias("sid"), "turn", "text")
    res = M.mask_sessions(conv, "text", "msg_id", session_col="sid", order_col="turn",
                          options=MaskOptions(engines="llm", custom_literals=CONV_LITERALS))
    return res.masked.select("msg_id", "masked_text")


# ---------------------------------------------------------------- M3/M4/N5: entities

_ENT_SQL = f"""
SELECT m.doc_id, replace(m.masked_text, c.c_name, '[PERSON:1]') AS masked_text
FROM ({O.mask_rows_sql(NOTES_SQL, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang")}) m
JOIN customer c ON m.doc_id = c.c_custkey"""


def _note_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity table standing in for an extractor: the customer's name (PERSON) and nation (ORG)."""
    cust = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    person = cust.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit(0).alias("entity_no"),
                         F.lit("PERSON").alias("type"), F.col("c_name").alias("value"))
    org = cust.join(F.broadcast(nation.select("n_nationkey", "n_name")), cust.c_nationkey == nation.n_nationkey) \
        .select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit(1).alias("entity_no"),
                F.lit("ORG").alias("type"), F.col("n_name").alias("value"))
    return person.unionByName(org)


@register("entity_masking", _ENT_SQL)
def entity_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M4 hybrid: rules, then entities longest first; entities absent from the text get no token."""
    res = M.pseudonymize(pii_notes(spark, sf_dir), MaskOptions(engines="hybrid"), entities=_note_entities(spark, sf_dir),
                         lang_col="lang")
    return res.masked.select("doc_id", "masked_text")


@register("dictionary_entities", f"""
SELECT n.doc_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY strpos(n.text, g.value), length(g.value) DESC, g.value, g.type) - 1 AS entity_no, g.type, g.value
FROM ({NOTES_SQL}) n
JOIN (SELECT 'PERSON' AS type, c_name AS value FROM customer UNION SELECT 'ORG', n_name FROM nation UNION SELECT 'ORG', substr(c_name, 10) FROM customer) g
  ON contains(n.text, g.value)""")
def dictionary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer of customer names, their numbers (which lie inside the names) and nation names, by containment."""
    from pseudoflow.operators.entities import dictionary_entities as dict_ents
    names = read_table(spark, sf_dir, "customer").select("c_name")
    gaz = names.select(F.lit("PERSON").alias("type"), F.col("c_name").alias("value")) \
        .unionByName(names.select(F.lit("ORG").alias("type"), F.expr("substr(c_name, 10)").alias("value"))) \
        .unionByName(read_table(spark, sf_dir, "nation").select(F.lit("ORG").alias("type"), F.col("n_name").alias("value")))
    return dict_ents(pii_notes(spark, sf_dir), gaz).select("doc_id", "entity_no", "type", "value")


# ---------------------------------------------------------------- N2 / N3 / N4

_REPLY_SQL = """
SELECT c_custkey AS doc_id,
       concat('Found: [{{"type":"PERSON","value":"', c_name, '"}},{{"type":"ORG","value":"', c_mktsegment,
              '"}},{{"type":"LOC","value":"x"}},{{"type":"PERSON","value":', cast(c_nationkey AS string),
              '}},{{"type":"ORG","value":"  "}}',
              CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ']' END, ' end') AS reply
FROM {customer}"""
_REPLY_SQL_DUCK = _REPLY_SQL.replace("{customer}", "customer").replace("{{", "{").replace("}}", "}")

_WS_RE2 = O.WS_RE2


@register("parse_model_replies", f"""
WITH r AS ({_REPLY_SQL_DUCK}),
a AS (SELECT doc_id, regexp_extract(reply, '\\[[\\s\\S]*\\]') AS arr FROM r),
l AS (SELECT doc_id, CASE WHEN json_valid(arr) AND json_type(arr) = 'ARRAY' THEN json_extract(arr, '$[*]') ELSE [] END AS l FROM a),
e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS entity_no, unnest(l) AS e FROM l)
SELECT doc_id, entity_no, e ->> 'type' AS type, e ->> 'value' AS value FROM e
WHERE json_type(e) = 'OBJECT' AND (e ->> 'type') IN ('PERSON', 'ORG') AND json_type(e -> 'value') = 'VARCHAR'
  AND length(regexp_replace(e ->> 'value', '^{_WS_RE2}+|{_WS_RE2}+$', '', 'g')) > 0""")
def parse_model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pseudoflow.operators.entities import parse_model_replies as parse
    replies = spark.sql(_REPLY_SQL, customer=read_table(spark, sf_dir, "customer"))
    return parse(replies).select("doc_id", "entity_no", "type", "value")


@register("merge_entities", """
WITH e AS (
  SELECT o.o_custkey AS doc_id, o.o_orderkey AS chunk_no, 0 AS entity_no, 'PERSON' AS type, c.c_name AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION ALL
  SELECT o_custkey, o_orderkey, 1, 'ORG', o_orderpriority FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, value ORDER BY chunk_no, entity_no) AS rn FROM e)
SELECT doc_id, chunk_no, entity_no, type, value FROM r WHERE rn = 1""")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-chunk entities (one chunk per order) merged per customer at first occurrence."""
    from pseudoflow.operators.entities import merge_entities as merge
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    person = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_no"), F.lit(0).alias("entity_no"),
        F.lit("PERSON").alias("type"), F.col("c_name").alias("value"))
    org = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_no"),
                        F.lit(1).alias("entity_no"), F.lit("ORG").alias("type"), F.col("o_orderpriority").alias("value"))
    return merge(person.unionByName(org))


def moody_extractor(chunk: str, known: list) -> list:
    """Stand-in extractor whose calls succeed, time out or are refused, by the chunk's first character."""
    if chunk[:1] and chunk[0] in "ABCDEFGHIJKL":
        raise TimeoutError("slow")
    if chunk[:1] and chunk[0] in "MNOPQRSTUVWXYZ":
        raise ConnectionError("refused")
    return []


def _status_sql(chunks: str) -> str:
    return f"""
SELECT doc_id, CASE WHEN bool_or(NOT regexp_matches(chunk, '^[A-Z]')) THEN 'ready'
                    WHEN bool_or(regexp_matches(chunk, '^[A-L]')) THEN 'warming_up' ELSE 'disabled' END AS ner_status
FROM ({chunks}) sc GROUP BY doc_id"""


@register("ner_status", _status_sql(_chunks_sql()))
def ner_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4 + N6 over N1's results: calls fail by chunk, the others go on."""
    from pseudoflow.operators.entities import extract_entities, ner_status as status
    res = extract_entities(read_table(spark, sf_dir, "documents"), moody_extractor)
    return status(res).withColumn("doc_id", F.col("doc_id").cast("long"))


# ---------------------------------------------------------------- L1-L3

def _lang_norm_sql(src: str, key: str) -> str:
    return (f"SELECT {key}, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM ({src}) s")


def _gram_sql(src: str, key: str) -> str:
    return f"""
SELECT {key}, gram, count(*) AS cnt FROM (
  SELECT {key}, substr(t, i, 3) AS gram FROM (
    SELECT {key}, t, unnest(range(1, length(t) - 1)) AS i FROM ({_lang_norm_sql(src, key)}) n WHERE length(t) >= 3) u) g
GROUP BY {key}, gram"""


def _iso3_case(col: str) -> str:
    from pseudoflow.operators.language import ISO3
    return "CASE " + " ".join(f"WHEN {col} = '{a}' THEN '{b}'" for a, b in ISO3.items()) + f" ELSE {col} END"


_PROFILES_SQL = f"""
SELECT code, gram, rank FROM (
  SELECT code, gram, row_number() OVER (PARTITION BY code ORDER BY cnt DESC, gram) AS rank
  FROM ({_gram_sql(f"SELECT {_iso3_case('lang')} AS code, text FROM documents WHERE lang IS NOT NULL", "code")}) c) r
WHERE rank <= 300"""


@register("language_profiles", _PROFILES_SQL)
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pseudoflow.operators.language import train_language_profiles
    return train_language_profiles(read_table(spark, sf_dir, "documents"))


@register("detect_language", f"""
WITH prof AS ({_PROFILES_SQL}),
docs AS (SELECT doc_id, text, length(regexp_replace(text, '^{_WS_RE2}+|{_WS_RE2}+$', '', 'g')) AS n_chars FROM documents),
g AS ({_gram_sql("SELECT doc_id, text FROM docs WHERE n_chars >= 20", "doc_id")}),
dr AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, gram) AS drank FROM g),
dt AS (SELECT doc_id, gram, drank FROM dr WHERE drank <= 300),
nd AS (SELECT doc_id, count(*) AS n_doc FROM dt GROUP BY doc_id),
codes AS (SELECT DISTINCT code FROM prof),
hit AS (SELECT dt.doc_id, p.code, sum(abs(dt.drank - p.rank)) AS near, count(*) AS n_hit
        FROM dt JOIN prof p ON dt.gram = p.gram GROUP BY dt.doc_id, p.code),
dist AS (SELECT nd.doc_id, c.code, coalesce(h.near, 0) + (nd.n_doc - coalesce(h.n_hit, 0)) * 300 AS d
         FROM nd CROSS JOIN codes c LEFT JOIN hit h ON h.doc_id = nd.doc_id AND h.code = c.code),
best AS (SELECT doc_id, code, d, row_number() OVER (PARTITION BY doc_id ORDER BY d, code) AS r,
                min(d) OVER (PARTITION BY doc_id) AS dmin FROM dist),
top AS (SELECT b.doc_id, b.code, CASE WHEN docs.n_chars * 300 - b.dmin > 0
                THEN round(1 - (b.d - b.dmin) / (docs.n_chars * 300 - b.dmin), 6) ELSE 0.0 END AS score
        FROM best b JOIN docs ON b.doc_id = docs.doc_id WHERE b.r = 1)
SELECT d.doc_id,
  CASE WHEN d.n_chars < 20 OR t.code IS NULL THEN 'unknown' WHEN t.code NOT IN ('pol', 'eng') THEN 'unknown'
       WHEN t.score < 0.5 THEN 'unknown' WHEN t.code = 'pol' THEN 'pl' ELSE 'en' END AS detected,
  CASE WHEN d.n_chars < 20 OR t.code IS NULL THEN 'fallback' WHEN t.code NOT IN ('pol', 'eng') THEN 'text'
       WHEN t.score < 0.5 THEN 'fallback' ELSE 'text' END AS source,
  CASE WHEN d.n_chars < 20 THEN NULL ELSE t.code END AS raw,
  CASE WHEN d.n_chars < 20 THEN NULL ELSE t.score END AS confidence
FROM docs d LEFT JOIN top t ON d.doc_id = t.doc_id""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pseudoflow.operators.language import detect_language as detect_lang, train_language_profiles
    docs = read_table(spark, sf_dir, "documents")
    return detect_lang(docs.select("doc_id", "text"), train_language_profiles(docs))


# ---------------------------------------------------------------- U3 / U7 / T3 / T6 / M6

@register("unmask_answers", _SESSION_CTE + """
SELECT n.doc_id, a.answer_no, CASE a.answer_no WHEN 0 THEN n.text WHEN 1 THEN 'Again: ' || n.text || ' [NONE:1]' ELSE m.masked_text END AS restored_text
FROM masked m JOIN (""" + NOTES_SQL + """) n ON m.k = n.doc_id, (VALUES (0), (1), (2)) a(answer_no)""")
def unmask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers to a note share its key; the third is of a session without values."""
    res = _notes_sessions(spark, sf_dir).checkpoint()
    answer = lambda n, sid, text: F.struct(F.lit(n).alias("answer_no"), sid.alias("sid"), text.alias("answer"))
    sid, text = F.col("session_id"), F.col("masked_text")
    answers = res.masked.select("doc_id", F.inline(F.array(
        answer(0, sid, text), answer(1, sid, F.concat(F.lit("Again: "), text, F.lit(" [NONE:1]"))),
        answer(2, F.concat(F.lit("other "), sid), text))))
    return U.unmask(answers, res.mapping, "answer", "doc_id", "sid").select("doc_id", "answer_no", "restored_text")


@register("mask_response", _SESSION_CTE + """
SELECT n.doc_id, n.session_id, m.masked_text, false AS auto_unmask, 'disabled' AS ner_status,
       CAST(NULL AS VARCHAR) AS ner_warning
FROM masked m JOIN (""" + NOTES_SQL + ") n ON m.k = n.doc_id")
def mask_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = M.pseudonymize(pii_notes(spark, sf_dir), MaskOptions(engines="regex"), session_col="session_id",
                         order_col="call_seq", lang_col="lang")
    return U.mask_response(res.masked, auto_unmask=False, key_cols=("doc_id",)).drop("response_json")


_PLAIN = "CASE WHEN c.c_nationkey % 4 = 3 THEN 'Nothing to hide in note ' || n.doc_id ELSE n.text END"


@register("unknown_session", f"""
SELECT n.doc_id,
  CASE WHEN nat.n_regionkey = 0 THEN 'Error: session "' || n.session_id || '" not found. It may have expired or never existed.'
       ELSE {_PLAIN} END AS text,
  nat.n_regionkey = 0 AS is_error
FROM ({NOTES_SQL}) n JOIN customer c ON n.doc_id = c.c_custkey JOIN nation nat ON c.c_nationkey = nat.n_nationkey""")
def unknown_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 + U3: a quarter of the sessions have no hits, so only the registry knows them; sessions of region-0 nations are
    cleared from mapping and registry, and restoring their rows reports the missing session."""
    from pseudoflow.operators.tokens import clear_sessions
    from pseudoflow.sources.store import session_registry
    plain = F.concat(F.lit("Nothing to hide in note "), F.col("doc_id").cast("string"))
    notes = pii_notes(spark, sf_dir).withColumn("text", F.when(F.expr("cast(substr(session_id, 2) as int) % 4 = 3"), plain).otherwise(F.col("text")))
    res = M.mask_sessions(notes, order_col="call_seq", lang_col="lang").checkpoint()
    nation = read_table(spark, sf_dir, "nation")
    cleared = nation.filter(F.col("n_regionkey") == 0).select(
        F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("session_id"))
    mapping, registry = clear_sessions(res.mapping, cleared), clear_sessions(session_registry(res.masked), cleared)
    return U.unmask_checked(res.masked, mapping, "masked_text", "doc_id", known_sessions=registry).select("doc_id", "text", "is_error")


_EXT_SRC = f"SELECT n.*, c.c_mktsegment FROM ({NOTES_SQL}) n JOIN customer c ON n.doc_id = c.c_custkey"


@register("extend_mapping", O.session_cte_sql(
    _EXT_SRC, "doc_id", "text", {"pl": PACKS["pl"], "en": PACKS["en"]}, "lang", "session_id", "call_seq",
    batch_expr="CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 0 ELSE 1 END") + """
SELECT sid AS session_id, tag, CAST(n AS BIGINT) AS n, '[' || tag || ':' || CAST(n AS VARCHAR) || ']' AS token, core AS value
FROM snum""")
def extend_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch continues the numbering of the sessions the first batch created."""
    notes = pii_notes(spark, sf_dir).join(
        read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment"), "doc_id")
    first = notes.filter(F.col("c_mktsegment") == "AUTOMOBILE")
    rest = notes.filter(F.col("c_mktsegment").isNull() | (F.col("c_mktsegment") != "AUTOMOBILE"))
    kw = dict(session_col="session_id", order_col="call_seq", options=MaskOptions(engines="regex"), lang_col="lang")
    m1 = M.mask_sessions(first, **kw).mapping
    return M.mask_sessions(rest, existing_mapping=m1, **kw).mapping


_PAGES_COLS_SRC = ("SELECT page_id * 10 AS k2, CAST(page_id AS VARCHAR) AS sid, 0 AS cs, url AS text FROM pages "
                   "UNION ALL SELECT page_id * 10 + 1, CAST(page_id AS VARCHAR), 1, html FROM pages")


@register("mask_columns", O.session_cte_sql(
    _PAGES_COLS_SRC, "k2", "text", {"en": PACKS["en"]}, "'en'", "sid", "cs") + """
SELECT CAST(k // 10 AS VARCHAR) AS session_id,
       max(CASE WHEN k % 10 = 0 THEN masked_text END) AS url,
       max(CASE WHEN k % 10 = 1 THEN masked_text END) AS html
FROM masked GROUP BY k // 10""")
def mask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: url and html of a page share one session; url is the first call."""
    pages = read_table(spark, sf_dir, "pages")
    res = M.mask_columns(pages, ["url", "html"], "page_id", options=MaskOptions(lang="en", engines="regex"))
    return res.masked.select(F.col("page_id").cast("string").alias("session_id"), "url", "html")


# ---------------------------------------------------------------- ST2: sessions over a stream

@register("stream_literals_conversations", ORACLE["custom_literals_conversations"])
def stream_literals_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: the literal masking of conversations, fed as a file stream in three turn slices.

    Spark writes the slices (hash-partitioned by conversation, so a conversation's rows of one
    slice share a file) into the checkpoint folder; the stream runs after each slice and the session sink continues each conversation's numbering across batches.  The result must
    equal the batch query.
    """
    import uuid

    from pseudoflow.session import ensure_checkpoint_dir
    from pseudoflow.streaming import SessionMaskSink, read_batches, run_available

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    conv = read_table(spark, sf_dir, "conversations") \
        .select((F.col("conv_id") * 100000 + F.col("turn")).alias("msg_id"),
                F.col("conv_id").cast("string").alias("sid"), "turn", "text")
    try:
        parts = max(2, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - remote session
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for lo, hi in ((None, 2), (2, 4), (4, None)):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("turn") >= lo)
        if hi is not None:
            cond = cond & (F.col("turn") < hi)
        conv.filter(cond).repartition(parts, "sid").write.mode("append").parquet(f"{base}/in")
        # each slice is one run from the same checkpoint, so batches respect the slice (turn) order
        stream = spark.readStream.schema(conv.schema).parquet(f"{base}/in")
        sink = SessionMaskSink(f"{base}/mapping", f"{base}/masked", "text", "msg_id", session_col="sid", order_col="turn",
                               options=MaskOptions(engines="llm", custom_literals=CONV_LITERALS), compact_every=2)
        run_available(stream, sink, f"{base}/ckpt")
    return read_batches(spark, f"{base}/masked").select("msg_id", "masked_text")


# ---------------------------------------------------------------- N1: extractor over ordered chunks

# Fixed parameter of this query's stand-in extractor: capitalised ASCII words of 8+ letters are ORG.
_CAP_WORD = r"\b[A-Z][a-z]{7,}\b"


def _cap_word_extractor(chunk: str, known: list) -> list:
    import re
    return [{"type": "ORG", "value": w} for w in re.findall(_CAP_WORD, chunk, flags=re.ASCII)]


_EXTRACT_SQL = (
    "SELECT doc_id, chunk_no, entity_no, type, value FROM ("
    " SELECT doc_id, chunk_no, generate_subscripts(e, 1) - 1 AS entity_no, 'ORG' AS type, unnest(e) AS value FROM ("
    f"  SELECT doc_id, chunk_no, regexp_extract_all(chunk, {O.q(_CAP_WORD)}) AS e FROM ({_chunks_sql()}) ch) w) z")


@register("extract_entities_chunks", _EXTRACT_SQL)
def extract_entities_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python extractor called per chunk (800 chars, one-sentence overlap), chunks in order."""
    from pseudoflow.operators.entities import entities_of, extract_entities
    res = extract_entities(read_table(spark, sf_dir, "documents"), _cap_word_extractor)
    return entities_of(res).withColumn("doc_id", F.col("doc_id").cast("long"))


# ---------------------------------------------------------------- T4 / T7 / U6

_TOKEN_RE = r"\[[A-Z_]+:\d+\]"


@register("lookup_tokens", _SESSION_CTE + f""",
notes AS ({NOTES_SQL}),
toks AS (SELECT DISTINCT n.session_id, unnest(regexp_extract_all(m.masked_text, {O.q(_TOKEN_RE)})) AS token
         FROM masked m JOIN notes n ON m.k = n.doc_id
         UNION SELECT DISTINCT session_id, '[SSN:999999]' FROM notes)
SELECT t.session_id, t.token, s.core AS value
FROM toks t LEFT JOIN snum s ON t.session_id = s.sid AND t.token = '[' || s.tag || ':' || CAST(s.n AS VARCHAR) || ']'""")
def lookup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: every token found in the masked notes plus one unknown token per session -> value (or NULL)."""
    from pseudoflow.operators.tokens import lookup_tokens as lookup
    res = _notes_sessions(spark, sf_dir).checkpoint()
    found = res.masked.select("session_id", F.explode(F.regexp_extract_all("masked_text", F.lit(_TOKEN_RE), F.lit(0))).alias("token"))
    unknown = res.masked.select("session_id", F.lit("[SSN:999999]").alias("token"))
    return lookup(res.mapping, found.unionByName(unknown).distinct()).select("session_id", "token", "value")


@register("row_session_ids", f"""
SELECT doc_id, sha256('run' || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || coalesce(sha256(text), '')) AS session_id FROM documents""")
def row_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic session id per row when none is given (masked and mapping outputs agree)."""
    res = M.mask_rows(read_table(spark, sf_dir, "documents"), options=MaskOptions(lang="en", engines="regex"))
    return res.masked.select("doc_id", "session_id")


@register("protected_apply", f"SELECT doc_id, 'Summary: ' || text AS result_text FROM ({NOTES_SQL}) n")
def protected_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask -> a transform that only sees masked text -> restore."""
    out = U.protected_apply(pii_notes(spark, sf_dir),
                            lambda d: d.withColumn("masked_text", F.concat(F.lit("Summary: "), "masked_text")),
                            MaskOptions(engines="regex"), session_col="session_id", order_col="call_seq", lang_col="lang")
    return out.select("doc_id", "result_text")


# ---------------------------------------------------------------- D1 with offsets, D3 rollup, L2 scores

@register("detect_email_offsets", f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, {O.q(O.re2_of(rule_by_id('global.email')))}) AS h,
                  regexp_split_to_array(text, {O.q(O.re2_of(rule_by_id('global.email')))}) AS g FROM documents),
x AS (SELECT doc_id, h, g, generate_subscripts(h, 1) AS i FROM p)
SELECT doc_id, i - 1 AS hit_no, h[i] AS value,
       CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(h[1:i-1], lambda s: length(s))), 0) AS INTEGER) AS start,
       CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + list_sum(list_transform(h[1:i], lambda s: length(s))) AS INTEGER) AS "end"
FROM x""")
def detect_email_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = D.detect(read_table(spark, sf_dir, "documents"), [rule_by_id("global.email")], with_offsets=True)
    return spans.select("doc_id", "hit_no", "value", "start", "end")


@register("pii_report_rollup", ORACLE["pii_report_by_source"].replace(
    "GROUP BY d.source, s.tag", "GROUP BY ROLLUP (d.source, s.tag)"))
def pii_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 with subtotals per source and a grand total (rollup)."""
    from pseudoflow.operators.report import pii_report
    docs = read_table(spark, sf_dir, "documents")
    return pii_report(D.detect(docs, _REPORT_RULES, carry=["source"]), None, ["source"], rollup=True)


_LANG_ORACLE = ORACLE["detect_language"]
_SCORES_SQL = _LANG_ORACLE[:_LANG_ORACLE.index("top AS (")] + """scored AS (SELECT b.doc_id, b.code, CAST(b.d AS BIGINT) AS distance,
       CASE WHEN docs.n_chars * 300 - b.dmin > 0 THEN round(1 - (b.d - b.dmin) / (docs.n_chars * 300 - b.dmin), 6) ELSE 0.0 END AS score
       FROM best b JOIN docs ON b.doc_id = docs.doc_id)
SELECT doc_id, code, distance, score FROM scored"""


@register("language_scores", _SCORES_SQL)
def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: distance and score of every document (20+ characters) against every profile."""
    from pseudoflow.operators.language import score_languages, train_language_profiles, MIN_TEXT_LENGTH
    from pseudoflow.operators.segments import trim_js
    docs = read_table(spark, sf_dir, "documents")
    src = docs.filter(F.length(trim_js(F.col("text"))) >= MIN_TEXT_LENGTH).select("doc_id", "text")
    return score_languages(src, train_language_profiles(docs)) \
        .select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.code", "s.distance", "s.score")



# ---------------------------------------------------------------- ST1 / ST3: stateless stream, restore stream

def _stream_base(spark: SparkSession) -> str:
    import uuid

    from pseudoflow.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "documents", spread_input=False).schema
    # a glob keeps the file source on the one table file of the folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/documents*.parquet")


@register("mask_stream_documents", ORACLE["mask_documents_en"])
def mask_stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the row-local masking expressions on a file stream of documents (equal to the batch query)."""
    from pseudoflow.streaming import mask_stream
    base = _stream_base(spark)
    q = mask_stream(_documents_stream(spark, sf_dir), options=MaskOptions(lang="en", engines="regex")) \
        .select("doc_id", "masked_text").writeStream.format("parquet") \
        .option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("stream_restore_documents", "SELECT doc_id, text, false AS is_error FROM documents")
def stream_restore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 + ST3: documents masked by the session sink (one session per document), then the masked
    stream restored by the restore sink: every text comes back, no session is unknown."""
    from pseudoflow.streaming import SessionMaskSink, SessionUnmaskSink, read_batches, run_available
    base = _stream_base(spark)
    docs = _documents_stream(spark, sf_dir).withColumn("session_id", F.col("doc_id").cast("string"))
    run_available(docs, SessionMaskSink(f"{base}/mapping", f"{base}/masked", "text", "doc_id",
                                        options=MaskOptions(lang="en", engines="regex")), f"{base}/ck1")
    masked_schema = read_batches(spark, f"{base}/masked").drop("batch_id").schema
    masked = spark.readStream.schema(masked_schema).parquet(f"{base}/masked/batch_id=*")
    run_available(masked, SessionUnmaskSink(f"{base}/mapping", f"{base}/restored"),
                  f"{base}/ck2")
    return read_batches(spark, f"{base}/restored").select("doc_id", "text", "is_error")
