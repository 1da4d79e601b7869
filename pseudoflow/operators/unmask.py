"""Restore, session checks, round-trip and leak checks, response table, protected apply."""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudoflow.functions.hof import let
from pseudoflow.functions.regex import TOKEN_PATTERN
from pseudoflow.operators.segments import places_of

# Messages of the service responses.
NER_WARNING_WARMING_UP = (
    "NER unavailable — Ollama is still loading the model. Retry in a few seconds for PERSON/ORG masking."
)
SESSION_NOT_FOUND = 'Error: session "{sid}" not found. It may have expired or never existed.'


def restore_expr(text, vals):
    """Single pass: gap_0 v_0 gap_1 v_1 ... gap_n, where ``vals[i]`` (sorted by position) replaces
    the i-th token — an index read, not a map lookup."""

    def body(v):
        p = v["p"]
        k = F.size(p) - 1
        return F.array_join(F.flatten(F.transform(
            F.sequence(F.lit(0), k),
            lambda i: F.when(i < k, F.array(F.get(p, i), F.get(vals, i))).otherwise(F.array(F.get(p, i))),
        )), "")

    return let({"p": F.split(text, TOKEN_PATTERN, -1)}, body)


def token_values(mapping: DataFrame) -> DataFrame:
    """session_id, token, value: the mapping once; a token of a session with two values is refused."""
    twice = F.raise_error(F.concat(F.lit("the mapping has two values for "), F.any_value("token"), F.lit(" of one session")))
    return mapping.groupBy("session_id", "token").agg(
        F.when(F.min("value").eqNullSafe(F.max("value")), F.min("value")).otherwise(twice).alias("value"))


def unmask(df: DataFrame, mapping: DataFrame, text_col: str = "masked_text", key_col: str = "doc_id",
           session_col: str = "session_id", out_col: str = "restored_text") -> DataFrame:
    """Replace every known ``[TAG:N]`` of the row's session; unknown tokens stay.

    Only rows that contain token-shaped text are touched: their tokens are exploded, looked up
    with an equi-join on (session, token) and folded back by session and text, which alone decide the
    result: ``key_col`` may repeat or be null (several answers to a document), and equal answers are
    looked up once.  A null session keeps its tokens.  A mapping in which a token of a session has two
    values is refused.
    """
    has = F.regexp(F.col(text_col), F.lit(TOKEN_PATTERN))
    session = F.col(session_col).cast("string")
    t = df.withColumn("_has", F.coalesce(has, F.lit(False)))
    with_tok = t.filter("_has").withColumn("_answer", F.sha2(F.to_json(F.struct(session.alias("s"), F.col(text_col).alias("t"))), 256))
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), F.lit(0))
    # a token of an answer leaves the row once, with its places; equal answers fall together in the aggregate
    toks = with_tok.select("_answer", session.alias("session_id"), F.inline(places_of(tokens))).withColumnRenamed("value", "token")
    values = token_values(mapping)
    found = F.collect_set(F.struct("places", F.coalesce("value", "token").alias("v")))
    placed = F.flatten(F.transform(found, lambda x: F.transform(x["places"], lambda i: F.struct(i.alias("pos"), x["v"].alias("v")))))
    vals = toks.join(values, ["session_id", "token"], "left").groupBy(F.col("_answer").alias("_k")) \
        .agg(F.transform(F.array_sort(placed), lambda x: x["v"]).alias("_vals"))
    restored = with_tok.join(vals, F.col("_answer") == F.col("_k"), "left") \
        .withColumn(out_col, restore_expr(F.col(text_col), F.col("_vals"))).drop("_k", "_vals", "_answer")
    plain = t.filter(~F.col("_has")).withColumn(out_col, F.col(text_col))
    return restored.unionByName(plain).drop("_has")


def unmask_checked(df: DataFrame, mapping: DataFrame, text_col: str = "masked_text", key_col: str = "doc_id",
                   session_col: str = "session_id", known_sessions: Optional[DataFrame] = None,
                   on_missing_session: str = "error_row") -> DataFrame:
    """Rows whose session is unknown get an error message and ``is_error = true``.

    Restore runs once over all rows (tokens of an unknown session simply stay); one left join with
    the distinct known sessions then flags the rows (AQE splits a hot session on the big side).  A mapping
    holds no sessions without hits: give ``known_sessions`` (every session that was masked) where there may be some.
    The text of an unknown session stays in its own column; one named ``text`` moves to ``masked_text``.
    """
    sessions = (known_sessions if known_sessions is not None else mapping).select(
        F.col("session_id").cast("string").alias("_sid")).distinct().withColumn("_known", F.lit(True))
    if on_missing_session == "raise":
        missing = df.select(F.col(session_col).cast("string").alias("_sid")).distinct() \
            .join(sessions, "_sid", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(SESSION_NOT_FOUND.format(sid=missing[0][0]))
    if text_col == "text":
        if "masked_text" in df.columns:
            raise ValueError("the input's text column would replace its masked_text")
        df, text_col = df.withColumnRenamed("text", "masked_text"), "masked_text"
    restored = unmask(df, mapping, text_col, key_col, session_col, "_restored")
    flagged = restored.join(sessions, F.col(session_col).cast("string") == F.col("_sid"), "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    message = F.format_string(SESSION_NOT_FOUND.format(sid="%s"), F.col(session_col).cast("string"))
    return flagged.withColumn("text", F.when(known, F.col("_restored")).otherwise(message)) \
        .withColumn("is_error", ~known).drop("_sid", "_known", "_restored")


def round_trip_check(original: DataFrame, restored: DataFrame, key_col: str = "doc_id",
                     text_col: str = "text", restored_col: str = "restored_text") -> DataFrame:
    """U4: per-row equality of the restored text with the original."""
    return original.select(key_col, text_col).join(restored.select(key_col, restored_col), key_col, "full") \
        .withColumn("round_trip_ok", F.col(text_col).eqNullSafe(F.col(restored_col)))


def round_trip_rate(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("rows"),
                       F.sum(F.col("round_trip_ok").cast("long")).alias("ok_rows"))


def leak_check(masked: DataFrame, hits: DataFrame, key_col: str = "doc_id",
               text_col: str = "masked_text") -> DataFrame:
    """A value masked in a row must not remain in that row's masked text.

    ``hits`` = (key, value) of the row's own hits; the join is per row (bounded by the row's hits).
    """
    h = hits.select(F.col(key_col), "value").distinct()
    return masked.select(key_col, text_col).join(h, key_col) \
        .filter(F.instr(F.col(text_col), F.col("value")) > 0) \
        .select(key_col, F.col("value").alias("leaked_value"))


def leak_check_sessions(masked: DataFrame, mapping: DataFrame, key_col: str = "doc_id", text_col: str = "masked_text") -> DataFrame:
    """U5 across a session: values of the session's mapping that stand in any of its masked texts.

    Values and texts meet by session and anchor gram (``literals.candidates``), then ``instr`` decides; session x
    values pairs are never made.  Result: key, session_id, leaked_value.
    """
    from pseudoflow.operators.literals import candidates

    rows = masked.select(F.col(key_col), F.col("session_id").cast("string").alias("session_id"), F.col(text_col).alias("_text"))
    values = mapping.select(F.col("session_id").cast("string").alias("session_id"), "value").where("length(value) > 0").distinct()
    some, _ = candidates(rows, values, "_text", False, ["value"], "_found", by="session_id")
    leaked = F.filter(F.array_distinct("_found"), lambda v: F.instr(F.col("_text"), v["value"]) > 0)
    return some.select(key_col, "session_id", F.explode(leaked).alias("v")).select(key_col, "session_id", F.col("v.value").alias("leaked_value"))


def token_shaped_inputs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Inputs that already contain token-shaped text (a restore would rewrite them)."""
    return df.withColumn("token_like_count", F.size(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), F.lit(0)))) \
        .filter(F.col("token_like_count") > 0)


def mask_response(masked: DataFrame, auto_unmask: bool = False, key_cols=()) -> DataFrame:
    """Service-style response rows; the warning appears only while the extractor warms up."""
    status = F.coalesce(F.col("ner_status"), F.lit("disabled")) if "ner_status" in masked.columns else F.lit("disabled")
    warn = F.when(status == "warming_up", F.lit(NER_WARNING_WARMING_UP))
    out = masked.select(*key_cols, "session_id", "masked_text", F.lit(auto_unmask).alias("auto_unmask"),
                        status.alias("ner_status"), warn.cast("string").alias("ner_warning"))
    return out.withColumn("response_json", F.to_json(F.struct("session_id", "masked_text", "auto_unmask",
                                                               "ner_status", "ner_warning")))


def protected_apply(df: DataFrame, transform: Callable[[DataFrame], DataFrame], options, text_col: str = "text",
                    key_col: str = "doc_id", **mask_kwargs) -> DataFrame:
    """Mask -> user's transform on masked text -> restore, in one plan.

    ``transform`` receives (key, session_id, masked_text) and must keep key and session_id and
    return a ``masked_text`` column (for example a summary written by some model).
    """
    from pseudoflow.operators.mask import pseudonymize

    from pseudoflow.session import materialize

    res = pseudonymize(df, options, text_col, key_col, **mask_kwargs).checkpoint()
    worked = materialize(transform(res.masked.select(key_col, "session_id", "masked_text")))
    return unmask(worked, res.mapping, "masked_text", key_col, "session_id", "result_text")
