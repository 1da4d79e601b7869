"""Entity extraction around a pluggable extractor, reply parsing, merging and status.

* N1 ``extract_entities``: the user's extractor runs per chunk, chunks of a document in order,
  entities found so far handed to the next call.  All chunks of a document live in one row,
  so this is a ``mapInArrow`` over document rows — documents in parallel, no shuffle.
  ``extract_in_rows`` gives the merged list and the status in the row itself, for masking that goes on from there.
* N2 ``parse_model_replies``: stored model replies -> entities, with variant functions.
* N3 ``merge_entities`` / ``entity_lists``: dedupe on (type, value), first occurrence order.
* N4 ``ner_status``: ready / warming_up / disabled per document.
* N5 ``dictionary_entities``: a gazetteer table as extractor (containment), met by anchors, checked exactly.
"""

from __future__ import annotations

from typing import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.functions.arrow import in_pieces
from pseudoflow.operators.chunks import DEFAULT_MAX_LEN, chunks_expr
from pseudoflow.operators.segments import trim_js

ENTITY_TYPES = ("PERSON", "ORG")  # fixed values
RESULT_SCHEMA = ("doc_key string, chunk_no int, kind string, entity_no int, type string, value string, "
                 "ok boolean, timeout boolean, error string")

Extractor = Callable[[str, list], Iterable[dict]]


def _is_timeout(err: BaseException) -> bool:
    return isinstance(err, TimeoutError) or type(err).__name__ == "AbortError"


# What JavaScript's trim() removes.
JS_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _valid_entity(e) -> bool:
    return (isinstance(e, dict) and e.get("type") in ENTITY_TYPES and isinstance(e.get("value"), str)
            and e["value"].strip(JS_SPACE) != "")


def _run_document(key: str, chunks: list, extractor: Extractor) -> list[tuple]:
    rows: list[tuple] = []
    known: dict[tuple[str, str], dict] = {}  # by type and trimmed value, in order of first occurrence
    for i, chunk in enumerate(chunks):
        try:
            found = list(extractor(chunk, list(known.values())))
        except Exception as err:  # N6: a failing chunk is skipped, the others continue
            rows.append((key, i, "chunk", None, None, None, False, _is_timeout(err), repr(err)))
            continue
        rows.append((key, i, "chunk", None, None, None, True, False, None))
        for j, e in enumerate(x for x in found if _valid_entity(x)):
            rows.append((key, i, "entity", j, e["type"], e["value"], None, None, None))
            known.setdefault((e["type"], e["value"].strip(JS_SPACE)), e)
    return rows


def extract_in_rows(df: DataFrame, extractor: Extractor, text_col: str, max_len: int = DEFAULT_MAX_LEN) -> DataFrame:
    """N1 + N3 + N4 in the row: ``df`` with ``_entities`` (array of type, value; merged, in order of first occurrence)
    and ``ner_status``.  All other columns pass through as Arrow data; nothing is shuffled.  A null text has no chunks."""
    src = df.withColumn("_chunks", chunks_expr(F.col(text_col), max_len))
    at = src.columns.index("_chunks")
    entity = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
    schema = T.StructType([*df.schema.fields, T.StructField("_entities", T.ArrayType(entity)), T.StructField("ner_status", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())]))
        lists, states = [], []
        for chunks in batch.column(at):
            rows = _run_document("", chunks.as_py() or [], extractor)
            found: dict[tuple[str, str], dict] = {}
            for r in rows:
                if r[2] == "entity":
                    found.setdefault((r[4], r[5].strip(JS_SPACE)), {"type": r[4], "value": r[5]})
            calls = [r for r in rows if r[2] == "chunk"]
            states.append("ready" if any(r[6] for r in calls) else "warming_up" if any(r[7] for r in calls) else "disabled")
            lists.append(list(found.values()))
        cols = [batch.column(i) for i in range(batch.num_columns) if i != at]
        return pa.RecordBatch.from_arrays([*cols, pa.array(lists, kind), pa.array(states, pa.string())], names=schema.names)

    return src.mapInArrow(in_pieces(run), schema)


def extract_entities(df: DataFrame, extractor: Extractor, text_col: str = "text", key_col: str = "doc_id",
                     max_len: int = DEFAULT_MAX_LEN, persist: bool = True) -> DataFrame:
    """Returns rows of kind 'chunk' (ok / timeout / error) and 'entity' (type, value).

    The extractor is ``(chunk_text, known_entities) -> iterable of {"type", "value"}``; it must carry
    its own time limit and raise ``TimeoutError`` on expiry.  The result feeds both the entity list
    and the status, so it is checkpointed (``persist``): the extractor is never called twice for a
    chunk, and a lost executor does not repeat finished model calls.
    """
    src = df.select(F.col(key_col).cast("string").alias("doc_key"), chunks_expr(F.col(text_col), max_len).alias("chunks"))

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [(name, kinds[kind]) for name, kind in (c.split() for c in RESULT_SCHEMA.split(", "))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for key, chunks in zip(batch.column(0), batch.column(1)):
            out.extend(_run_document(key.as_py(), chunks.as_py() or [], extractor))
        columns = list(zip(*out)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])

    out = src.mapInArrow(in_pieces(run), RESULT_SCHEMA)
    if persist:
        from pseudoflow.session import materialize
        out = materialize(out)
    return out


def entities_of(results: DataFrame, key_col: str = "doc_id") -> DataFrame:
    return results.filter(F.col("kind") == "entity") \
        .select(F.col("doc_key").alias(key_col), "chunk_no", "entity_no", "type", "value")


def ner_status(chunk_results: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Any chunk ok -> ready; else any timeout -> warming_up; else disabled."""
    src = chunk_results
    if "kind" in src.columns:
        src = src.filter(F.col("kind") == "chunk").withColumnRenamed("doc_key", key_col)
    agg = src.groupBy(key_col).agg(F.bool_or("ok").alias("any_ok"), F.bool_or("timeout").alias("any_timeout"))
    status = F.when(F.col("any_ok"), "ready").when(F.col("any_timeout"), "warming_up").otherwise("disabled")
    return agg.select(key_col, status.alias("ner_status"))


def merge_entities(entities: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """One row per (document, type, trimmed value) at its first occurrence (chunk_no, entity_no)."""
    e = entities.withColumn("value_trim", trim_js(F.col("value"))).filter(F.length("value_trim") > 0) \
        .filter(F.col("type").isin(*ENTITY_TYPES))
    first = F.min(F.struct("chunk_no", "entity_no", "value")).alias("first")
    return e.groupBy(key_col, "type", "value_trim").agg(first) \
        .select(key_col, F.col("first.chunk_no").alias("chunk_no"), F.col("first.entity_no").alias("entity_no"),
                "type", F.col("first.value").alias("value"))


def entity_lists(entities: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Merged entities of each document as ``array<struct<type, value>>`` in first-occurrence order."""
    merged = merge_entities(entities, key_col)
    return merged.groupBy(key_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "entity_no", "type", "value"))),
                    lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("entities"))


def parse_model_replies(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """First '[' .. last ']' of a reply, parsed; keep objects with type PERSON/ORG and a
    non-blank string value, in array order.  A reply that does not parse gives no rows."""
    arr_text = F.regexp_extract(F.col(reply_col), r"\[[\s\S]*\]", 0)
    parsed = F.try_variant_get(F.try_parse_json(arr_text), "$", "array<variant>")
    elems = df.select("*", F.posexplode(F.coalesce(parsed, F.array().cast("array<variant>"))).alias("entity_no", "e"))
    etype = F.try_variant_get("e", "$.type", "string")
    evalue_kind = F.schema_of_variant(F.try_variant_get("e", "$.value", "variant"))
    evalue = F.try_variant_get("e", "$.value", "string")
    is_obj = F.schema_of_variant(F.col("e")).startswith("OBJECT")
    keep = is_obj & etype.isin(*ENTITY_TYPES) & (evalue_kind == "STRING") & (F.length(trim_js(evalue)) > 0)
    return elems.filter(keep).withColumn("type", etype).withColumn("value", evalue).drop("e")


# ---------------------------------------------------------------- N5: gazetteer as extractor

def dictionary_entities(df: DataFrame, gazetteer: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Every gazetteer entry (type, value) contained in the text (case-sensitive, anywhere).

    Texts and entries meet by their anchors (``literals.candidates``), then ``instr`` decides.  Output: key, chunk_no (0),
    entity_no (by first position, then the longer value, value and type; in the row, so keys may repeat), type, value.
    """
    from pseudoflow.operators.literals import candidates

    entries = gazetteer.select(F.col("type").cast("string").alias("type"), trim_js(F.col("value").cast("string")).alias("value")) \
        .filter(F.col("type").isin(*ENTITY_TYPES) & (F.length("value") > 0)).distinct()
    src = df.select(F.col(key_col), F.col(text_col).cast("string").alias("_text"))
    some, _ = candidates(src, entries, "_text", False, ["type", "value"], "_found")
    at = F.transform("_found", lambda e: F.struct(F.instr(F.col("_text"), e["value"]).alias("pos"), (-F.length(e["value"])).alias("less"),
                                                   e["value"].alias("value"), e["type"].alias("type")))
    hits = F.array_sort(F.filter(F.array_distinct(at), lambda e: e["pos"] > 0))
    return some.select(key_col, F.posexplode(hits).alias("entity_no", "e")) \
        .select(key_col, F.lit(0).alias("chunk_no"), "entity_no", "e.type", "e.value")
