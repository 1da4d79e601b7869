"""Structured Streaming: long-lived sessions over a stream of texts (ST1-ST4).

* ST1 ``mask_stream`` / ``detect_stream``: stateless column expressions on a streaming DataFrame
  (row-local sessions need no state at all).
* ST2 ``SessionMaskSink``: a ``foreachBatch`` sink.  The session state is the mapping store
  (``sources.store``), extended batch by batch with the batch job's numbering
  (``mask_sessions(existing_mapping=...)``), so numbers continue across micro-batches and a
  giant session is numbered by many tasks, never held whole by one.  A batch reads only the buckets of its
  sessions, and every batch writes its own folders with overwrite and commits them last, so a batch replayed
  after a failure rewrites the same rows (idempotent).
* ST3 ``SessionUnmaskSink``: restore each micro-batch against the mapping store.  ``restore_stream`` does so
  in append mode, without ``foreachBatch``.
* ST4 session expiry: a session without rows for more than ``ttl_batches`` batches starts a new
  generation, whose numbers restart at 1 under a session id of its own (``GENERATION`` and a number are
  added), so texts masked before the expiry never get the values of later ones.  Off by default.

The mapping folder belongs to one stream: ``mapping_path.query`` names it, and another stream, such as one
with a new checkpoint that would count its batches from 0 again, is refused before it writes anything.
"""

from __future__ import annotations

import re
from typing import Optional, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pseudoflow.functions.regex import TOKEN_PATTERN
from pseudoflow.functions.rules import Rule
from pseudoflow.operators import detect as D
from pseudoflow.operators import mask as M
from pseudoflow.operators import segments as S
from pseudoflow.operators import unmask as U
from pseudoflow.options import MaskOptions
from pseudoflow.sources.store import MappingStore, State, has_data, session_registry


def mask_stream(stream: DataFrame, text_col: str = "text", key_col: str = "doc_id",
                options: MaskOptions = MaskOptions(engines="regex"), lang_col: Optional[str] = None) -> DataFrame:
    """ST1: row-local masking of a streaming DataFrame (key, session_id, masked_text)."""
    res = M.mask_rows(stream, text_col, key_col, options=options, lang_col=lang_col)
    return res.masked


def detect_stream(stream: DataFrame, rules: Sequence[Rule], text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """ST1: spans of a streaming DataFrame."""
    return D.detect(stream, rules, text_col, key_col)


#: Stands between a session id and the number of its generation, from the second one on.
GENERATION = "\u001f"
#: Most values of a session in ``session_values``.
MOST_VALUES = 100_000
#: Shares of a micro-batch that ``restore_stream`` brings together one at a time.
RESTORE_GROUPS = 1 << 12
#: Begins what stands for the row itself among its tokens.
NO_TOKEN = "\u0000"
TOKEN = re.compile(TOKEN_PATTERN, re.ASCII)


def _claim(spark: SparkSession, mapping_path: str) -> None:
    """Note which stream writes the mapping; its id outlives restarts from the same checkpoint."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "no stream"
    path = f"{mapping_path}.query"
    noted = spark.read.text(path).first() if has_data(spark, path) else None
    if noted is None and has_data(spark, mapping_path):
        raise RuntimeError(f"{mapping_path} holds a mapping of an unknown stream")
    if noted is not None and noted[0] != query:
        raise RuntimeError(f"{mapping_path} belongs to stream {noted[0]}, not to {query}: resume from its checkpoint or take a new folder")
    if noted is None:
        spark.range(1).select(F.lit(query).alias("value")).coalesce(1).write.mode("overwrite").text(path)


class SessionMaskSink:
    """ST2: ``stream.writeStream.foreachBatch(SessionMaskSink(...))``.

    Writes masked rows to ``masked_path/batch_id=N`` and the new mapping entries and seen sessions to the store at
    ``mapping_path``, then commits the batch.  Within a batch, rows of a session are numbered in
    ``order_col`` order; across batches, in arrival order.  Every ``compact_every`` batches the store is compacted.
    """

    def __init__(self, mapping_path: str, masked_path: str, text_col: str = "text", key_col: str = "doc_id",
                 session_col: str = "session_id", order_col: Optional[str] = None,
                 options: MaskOptions = MaskOptions(engines="regex"), strategy: str = "range",
                 ttl_batches: Optional[int] = None, keep_cols: Sequence[str] = (), buckets: int = 64,
                 compact_every: int = 50, **seg_kwargs):
        self.mapping_path, self.masked_path = mapping_path, masked_path
        self.text_col, self.key_col, self.session_col, self.order_col = text_col, key_col, session_col, order_col
        self.options, self.strategy, self.ttl, self.keep_cols = options, strategy, ttl_batches, tuple(keep_cols)
        self.buckets, self.compact_every, self.seg_kwargs = buckets, compact_every, seg_kwargs

    def _with_generations(self, batch: DataFrame, seen: DataFrame, store: MappingStore, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """ST4: the batch's sessions with their generation; those that had expired get the id of a new one."""
        spark = batch.sparkSession
        last = store.sessions(store.buckets_of(seen), before=batch_id).select("session_id", F.col("generation").alias("_known"), "last_seen")
        expired = (F.col("last_seen") < batch_id - self.ttl).cast("int")
        here = seen.join(last, "session_id", "left").select(
            "session_id", F.coalesce(F.col("_known") + expired, F.lit(1)).alias("generation"), "n_rows", F.lit(batch_id).cast("long").alias("last_seen"))
        path = f"{self.mapping_path}.seen/batch_id={batch_id}"
        here.write.mode("overwrite").parquet(path)
        here = spark.read.schema(here.schema).parquet(path)
        later = here.where("generation > 1").select(F.col("session_id").alias("_sid"), F.col("generation").alias("_generation"))
        sid = F.col(self.session_col).cast("string")
        named = F.when(F.col("_generation").isNull(), sid).otherwise(F.concat(sid, F.lit(GENERATION), F.col("_generation").cast("string")))
        return batch.join(later, sid == F.col("_sid"), "left").withColumn(self.session_col, named).drop("_sid", "_generation"), here

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _claim(spark, self.mapping_path)
        store = MappingStore(spark, self.mapping_path, self.buckets)
        sid = F.col(self.session_col).cast("string")
        seen = batch.where(sid.isNotNull()).groupBy(sid.alias("session_id")).agg(F.count(F.lit(1)).alias("n_rows"))
        registry = None
        if self.ttl is not None:
            batch, registry = self._with_generations(batch, seen, store, batch_id)
        here = batch.where(sid.isNotNull()).select(sid.alias("session_id")).distinct()
        existing = None
        if store.state(before=batch_id) != State(None, []):
            # only the sessions of this batch matter: other buckets are not read, and the numbering joins never touch the rest
            existing = store.mapping(store.buckets_of(here), before=batch_id).join(here, "session_id", "left_semi")
        res = M.mask_sessions(batch, self.text_col, self.key_col, session_col=self.session_col,
                              order_col=self.order_col, options=self.options, strategy=self.strategy,
                              existing_mapping=existing, keep_cols=self.keep_cols, run_id=f"batch {batch_id}", **self.seg_kwargs)
        folder = f"{self.masked_path}/batch_id={batch_id}"
        res.masked.write.mode("overwrite").parquet(folder)
        # sessions as the masked rows have them: rows without a session got one of their own, expired ones a new id
        masked = spark.read.schema(res.masked.schema).parquet(folder)
        known = session_registry(masked, batch_id)
        if registry is not None:  # the plain id keeps the number of its generation
            known = known.join(registry.select("session_id"), "session_id", "left_anti").unionByName(registry)
        store.write(batch_id, res.added, known)
        store.commit(batch_id)
        if batch_id and batch_id % self.compact_every == 0:
            store.compact(before=batch_id)


class SessionUnmaskSink:
    """ST3: restore every micro-batch against the mapping store; writes ``out_path/batch_id=N``."""

    def __init__(self, mapping_path: str, out_path: str, text_col: str = "masked_text", key_col: str = "doc_id",
                 session_col: str = "session_id"):
        self.mapping_path, self.out_path = mapping_path, out_path
        self.text_col, self.key_col, self.session_col = text_col, key_col, session_col

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = MappingStore(spark, self.mapping_path)
        buckets = store.buckets_of(batch.select(F.col(self.session_col).cast("string").alias("session_id")).where("session_id IS NOT NULL"))
        # sessions that were masked are known even when they have no mapping rows: the registry has them
        out = U.unmask_checked(batch, store.mapping(buckets), self.text_col, self.key_col, self.session_col, known_sessions=store.sessions(buckets))
        out.write.mode("overwrite").parquet(f"{self.out_path}/batch_id={batch_id}")


def session_values(mapping: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """session_id, values (array of token, value): a session's mapping as one row; a session of more than ``most`` is refused."""
    too_many = F.raise_error(F.concat(F.lit("more values than a row should hold in session "), F.col("session_id")))
    values = mapping.groupBy("session_id").agg(F.count(F.lit(1)).alias("c"), F.collect_list(F.struct("token", "value")).alias("values"))
    return values.select("session_id", F.when(F.col("c") <= most, F.col("values")).otherwise(too_many).alias("values"))


def restore_stream(stream: DataFrame, mapping: DataFrame, sessions: DataFrame, text_col: str = "masked_text",
                   session_col: str = "session_id") -> DataFrame:
    """ST3 without ``foreachBatch``: append mode, stateless; ``text`` and ``is_error`` as in ``unmask_checked``.

    A row sends out its distinct tokens, which meet the mapping in a (stream-static) equi-join on session and token, and comes
    together with their values again by a hash of the row, so a session may have any number of values; a group holds one of
    ``RESTORE_GROUPS`` shares of a micro-batch.  A query sees the committed mapping of its start; run it again from the same
    checkpoint to take in later batches.
    """
    cols = stream.columns
    sid, text = F.col(session_col).cast("string"), F.col(text_col).cast("string")
    known = sessions.select(F.col("session_id").cast("string").alias("_sid")).distinct().withColumn("_known", F.lit(True))
    rows = stream.join(known, sid == F.col("_sid"), "left")
    tokens = F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))), F.array().cast("array<string>"))
    group = F.pmod(F.xxhash64(F.to_json(F.struct(*cols))), F.lit(RESTORE_GROUPS))
    rows = rows.select(*cols, F.coalesce("_known", F.lit(False)).alias("_known"), sid.alias("_s"), text.alias("_text"), group.alias("_g"),
                       F.when(F.col("_known"), tokens).otherwise(F.array().cast("array<string>")).alias("_tokens"))
    held = [*cols, "_known", "_text"]
    # the row itself goes along with a token that no mapping has, another one for each group
    whole = F.struct(F.concat(F.lit(NO_TOKEN), F.col("_g").cast("string")).alias("_token"), *held)
    part = lambda t: F.struct(t.alias("_token"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in held])
    parts = rows.select("_s", "_g", F.inline(F.concat(F.array(whole), F.transform("_tokens", part))))
    values = U.token_values(mapping).select(F.col("session_id").alias("_vs"), F.col("token").alias("_vt"), F.col("value").alias("_value"))
    met = parts.join(values, (F.col("_s") == F.col("_vs")) & (F.col("_token") == F.col("_vt")), "left").select("_g", "_s", "_token", "_value", *held)
    schema = StructType([*[StructField(f.name, f.dataType) for f in met.schema.fields if f.name in {*cols, "_known"}], StructField("_restored", StringType())])

    def restored(group: pa.Table) -> pa.Table:
        own = pc.starts_with(group["_token"], NO_TOKEN)
        found = group.filter(pc.and_(pc.invert(own), pc.is_valid(group["_value"])))
        value = dict(zip(zip(found["_s"].to_pylist(), found["_token"].to_pylist()), found["_value"].to_pylist()))
        group = group.filter(own)
        texts = [t and TOKEN.sub(lambda m: value.get((s, m[0]), m[0]), t) for s, t in zip(group["_s"].to_pylist(), group["_text"].to_pylist())]
        return group.select([f.name for f in schema.fields[:-1]]).append_column("_restored", pa.array(texts, pa.string()))

    out = met.groupBy("_g").applyInArrow(restored, schema)
    message = F.format_string(U.SESSION_NOT_FOUND.format(sid="%s"), sid)
    shown = F.when(F.col("_known"), F.col("_restored")).otherwise(message)
    return out.select(*[c for c in cols if c != "text"], shown.alias("text"), (~F.col("_known")).alias("is_error"))


def run_available(stream: DataFrame, sink, checkpoint: str) -> None:
    """Drive a stream to the end of the data that is available now (batch-like runs and tests)."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
