"""Token assignment: the mapping table ``session_id, tag, n, token, value``.

Numbering is dense per (session, tag) in order of first replacement; the ordering key of a
hit is (call_seq, row key, digest of the row's text, pass_no, piece index).  Three paths give the same numbers:

* row-local (every row is its own session): a higher-order function inside the row, no shuffle
  (``segments.local_numbering``);
* ``window``: hash-aggregate the hits to distinct values (map-side partial aggregation), then
  ``row_number`` per (session, tag).  One task per (session, tag): fine for many small sessions;
* ``range`` (default): distinct values are range-partitioned on (session, tag, first key), so a
  giant session is spread over many tasks; each task numbers its slice and adds the count of
  the slices before it (a small table of per-partition counts).  No group is ever held by one
  task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pseudoflow.operators.segments import grouped_hits, token_text
from pseudoflow.session import materialize

ORDER_COLS = ("f_call", "f_key", "f_tie", "f_pass", "f_idx")
MAPPING_COLS = ("session_id", "tag", "n", "token", "value")


def call_number(df: DataFrame, order_col: str | None) -> Column:
    """Place of a row in its session: text holds a number, any other type orders as it is."""
    if not order_col:
        return F.lit(0).cast("long")
    return F.col(order_col).cast("long") if df.schema[order_col].dataType.simpleString() == "string" else F.col(order_col)


def hits_table(seg_df: DataFrame, key_col: str, session_col: str = "session_id",
               order_col: str | None = None, segs_col: str = "segs") -> DataFrame:
    """One row per accepted hit: key, session_id, call_seq, pass_no, idx, tag, value."""
    return (
        seg_df.select(F.col(key_col).alias("_key"), F.col(session_col).alias("session_id"),
                      call_number(seg_df, order_col).alias("call_seq"), F.posexplode(segs_col).alias("idx", "seg"))
        .filter(F.col("seg.tag").isNotNull())
        .select("_key", "session_id", "call_seq", F.col("seg.pass_no").alias("pass_no"), "idx",
                F.col("seg.tag").alias("tag"), F.col("seg.txt").alias("value"))
    )


def row_values(seg_df: DataFrame, key_col: str, order_col: str | None, row_col: str, tie_col: str, segs_col: str = "segs") -> DataFrame:
    """One row per distinct value of a row, with all its places: what a hit occurrence costs stays in the row."""
    return seg_df.select(row_col, F.col(key_col).alias("_key"), F.col(tie_col).alias("_tie"), "session_id",
                         call_number(seg_df, order_col).alias("call_seq"), F.inline(grouped_hits(F.col(segs_col)))) \
        .withColumnRenamed("txt", "value")


def _first(hits: DataFrame) -> Column:
    tie = F.col("_tie") if "_tie" in hits.columns else F.lit("")
    return F.struct(F.col("call_seq").alias("f_call"), F.col("_key").alias("f_key"), tie.alias("f_tie"),
                    F.col("pass_no").alias("f_pass"), F.col("idx").alias("f_idx"))


def first_appearance(hits: DataFrame) -> DataFrame:
    """Distinct (session, tag, value) with the ordering key of its first replacement."""
    first = F.min(_first(hits)).alias("first")
    return hits.groupBy("session_id", "tag", "value").agg(first).select("session_id", "tag", "value", "first.*")


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.col("n").cast("long")).withColumn("token", token_text(F.col("tag"), F.col("n"))) \
        .select(*MAPPING_COLS)


def number_values(firsts: DataFrame, strategy: str = "range", base: DataFrame | None = None) -> DataFrame:
    """Dense numbers per (session, tag) by first appearance.  ``base`` = (session_id, tag, n0) offsets."""
    order = [F.col(c) for c in ORDER_COLS]
    if strategy == "window":
        w = Window.partitionBy("session_id", "tag").orderBy(*order)
        out = firsts.withColumn("n", F.row_number().over(w))
    elif strategy == "range":
        nparts = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the slice id must be fixed once: it is read by two branches below
        ranged = materialize(firsts.repartitionByRange(nparts, "session_id", "tag", *ORDER_COLS)
                             .withColumn("pid", F.spark_partition_id()))
        local = ranged.withColumn(
            "rn", F.row_number().over(Window.partitionBy("pid", "session_id", "tag").orderBy(*order)))
        counts = ranged.groupBy("pid", "session_id", "tag").agg(F.count("*").alias("cnt"))
        before = Window.partitionBy("session_id", "tag").orderBy("pid") \
            .rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("off", F.coalesce(F.sum("cnt").over(before), F.lit(0))).drop("cnt")
        out = local.join(offsets, ["pid", "session_id", "tag"]).withColumn("n", F.col("rn") + F.col("off"))
    else:
        raise ValueError("strategy must be 'range' or 'window'")
    if base is not None:
        out = out.join(base, ["session_id", "tag"], "left") \
            .withColumn("n", F.col("n") + F.coalesce(F.col("n0"), F.lit(0)))
    return _finish(out)


def assign_tokens(hits: DataFrame, strategy: str = "range") -> DataFrame:
    """Mapping table for a table of hits (idempotent per (session, tag, value))."""
    return number_values(first_appearance(hits), strategy)


def added_tokens(existing: DataFrame, hits: DataFrame, strategy: str = "range") -> DataFrame:
    """Mapping rows of the values in ``hits`` that ``existing`` lacks, numbered after max(n) of their (session, tag).

    Known values and hits meet in one aggregate, which is kept (checkpoint): it says which values are new and where
    the numbers of a (session, tag) ended, so ``existing`` is read once.
    """
    new = hits.select("session_id", "tag", "value", F.lit(None).cast("long").alias("known"), _first(hits).alias("first"))
    kind = new.schema["first"].dataType.simpleString()
    old = existing.select("session_id", "tag", "value", F.col("n").alias("known"), F.lit(None).cast(kind).alias("first"))
    seen = materialize(old.unionByName(new).groupBy("session_id", "tag", "value").agg(F.max("known").alias("known"), F.min("first").alias("first")))
    base = seen.where("known IS NOT NULL").groupBy("session_id", "tag").agg(F.max("known").alias("n0"))
    firsts = seen.where("known IS NULL").select("session_id", "tag", "value", "first.*")
    return number_values(firsts, strategy, base)


def extend_mapping(existing: DataFrame, hits: DataFrame, strategy: str = "range") -> DataFrame:
    """Known values keep their tokens, new values continue after max(n) of their (session, tag)."""
    return existing.select(*MAPPING_COLS).unionByName(added_tokens(existing, hits, strategy))


def lookup_tokens(mapping: DataFrame, tokens: DataFrame) -> DataFrame:
    """T4: (session_id, token) -> value, unknown tokens give NULL."""
    return tokens.join(mapping.select("session_id", "token", "value"), ["session_id", "token"], "left")


def mapping_for_session(mapping: DataFrame, session_id: str) -> DataFrame:
    """T5: all entries of one session (a pushed-down filter; prunes a session-partitioned table)."""
    return mapping.filter(F.col("session_id") == F.lit(session_id))


def clear_sessions(mapping: DataFrame, sessions: DataFrame) -> DataFrame:
    """Forget the listed sessions (numbering for them restarts at 1 afterwards)."""
    return mapping.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def own_session(key: Column, text: Column, run_id: str) -> Column:
    """The session id of a call that names none: from the run, the row's key and its text.

    Deterministic, so that masked and mapping outputs agree on recomputation; a null key is none of the strings.
    """
    return F.sha2(F.concat_ws("\u0000", F.lit(run_id), F.when(key.isNull(), F.lit("\u0001")).otherwise(key.cast("string")),
                              F.coalesce(F.sha2(text, 256), F.lit(""))), 256)


def with_session_id(df: DataFrame, key_col: str, session_col: str = "session_id", run_id: str = "run", text_col: str | None = None) -> DataFrame:
    """Keep a given session id, otherwise derive a deterministic one per row."""
    derived = own_session(F.col(key_col), F.col(text_col) if text_col else F.lit(""), run_id)
    if session_col in df.columns:
        return df.withColumn(session_col, F.coalesce(F.col(session_col).cast("string"), derived))
    return df.withColumn(session_col, derived)
