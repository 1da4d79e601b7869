"""Exact deduplication: a streaming query whose disk-backed keyed state never expires.

Every row's digest goes with a stable identifier and a content locator into a stateful aggregation
(RocksDB state store, no watermark, so no expiry).  The state keeps, for each digest, the retained row
(largest id), its locator and the number of rows.  Rows whose digest was hit more than once are then
compared by their full bytes; a digest shared by different texts is split by text.

Defined cases: null text counts as empty; a null id is smaller than any other; rows that agree in id
and text are copies like any others (exactly one row of each group has ``kept``); an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudoflow.llm.common import fresh, lower_ascii, parted, scratch, sieve, text_or_empty, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State stays on disk, commits write change logs, and small stores reserve no disk ahead.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex) -> DataFrame:
    """(row_no, doc_id, digest, sha256, locator) of every row, written once so that row numbers are stable."""
    norm = lower_ascii(text_or_empty(docs, text_col))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), norm.alias("norm"))
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("row_no"),
            "doc_id",
            digest(F.col("norm")).alias("digest"),
            sha256_hex(F.col("norm")).alias("text_sha256"),
            F.struct(
                F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.octet_length("norm").cast("long").alias("n_bytes")
            ).alias("locator"),
        ),
        "fingerprints",
    )


def stream_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stateful query over what ``stream`` has now; returns the state as a table.

    Started again with the same ``checkpoint`` it goes on where it stopped, with all digests seen before.
    Columns: digest, keep_row, keep_id, locator, group_size.
    """
    spark = stream.sparkSession
    kept = F.max(F.struct("doc_id", "row_no", "locator")).alias("keep")
    state = stream.groupBy("digest").agg(kept, F.count(F.lit(1)).alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if query.lastProgress is None:  # no rows ever arrived: there is no state yet
        return spark.createDataFrame(
            [], "digest string, keep_row long, keep_id long, locator struct<file string, n_bytes long>, group_size long"
        )
    rows = spark.read.format("statestore").load(checkpoint)
    value = [f"value.`{x}`" for x in rows.schema["value"].dataType.names]
    return rows.select(F.col("key.digest").alias("digest"), F.col(value[0]).alias("keep"), F.col(value[1]).alias("group_size")).select(
        "digest", F.col("keep.row_no").alias("keep_row"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("locator"), "group_size"
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, keep_locator, n_same.

    ``n_same`` is the number of rows that agree with the kept row in id and text.  ``digest`` can be any
    hash; groups are right even if it collides.
    """
    spark = docs.sparkSession
    prints = fingerprints(docs, id_col, text_col, digest)
    path = prints.inputFiles()[0].rsplit("/", 1)[0] if prints.inputFiles() else None
    if path is None:
        return prints.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                             F.lit(True).alias("kept"), "text_sha256", F.col("locator").alias("keep_locator"), F.lit(1).cast("long").alias("n_same"))
    stream = spark.readStream.schema(prints.schema).parquet(path)
    state = written(stream_state(stream, scratch(spark, "dedup-state")), "dedup-groups")
    hits = state.where("group_size > 1").select("digest")

    # hits: compare the full bytes of every row whose digest was seen more than once; a sieve on the ids lets some
    # others pass, whose digest is of one text in any case
    hit_ids = written(prints.join(hits, "digest", "left_semi").select(F.xxhash64("doc_id").alias("hit")).distinct(), "dedup-hits")
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    found = sieve(found, F.xxhash64(found["doc_id"]), hit_ids)
    found = found.select("doc_id", lower_ascii(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    texts = found.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))  # partial: a text once a task
    collided = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "dedup-collided")

    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "keep_locator"]
    plain = prints.join(state, "digest").withColumn("kept", F.col("row_no") == F.col("keep_row")).withColumn("keep_locator", state["locator"])
    if not collided.isEmpty():
        plain = plain.join(collided, "digest", "left_anti")
        rows = written(found.join(collided, "digest", "left_semi").withColumn("row_no", F.monotonically_increasing_id()), "dedup-split")
        by_text = rows.groupBy("norm").agg(F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        nowhere = F.struct(F.lit("").alias("file"), F.octet_length("norm").cast("long").alias("n_bytes"))
        split = rows.join(by_text, "norm").select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("keep.row_no")).alias("kept"),
            sha256_hex(F.col("norm")).alias("text_sha256"), nowhere.alias("keep_locator"),
        )
        return plain.select(*columns).unionByName(split)
    return plain.select(*columns)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that agree in id and (normalised) text one stays, any of them.
    """
    found = written(groups(docs, id_col, text_col).select("doc_id", "kept", "group_size", F.col("text_sha256").alias("sha")), "dedup-rows")
    copies = found.where("group_size > 1")
    # rows with a text of their own need no decision; the others are few, and only these are joined
    lost = copies.groupBy("doc_id", "sha").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    lost = written(lost, "dedup-lost")
    sha, *key = fresh(docs, "sha", "lost_id", "lost_sha", "lost_kept", "lost_n")
    mine = docs.withColumn(sha, sha256_hex(lower_ascii(text_or_empty(docs, text_col))))
    own = F.xxhash64(mine[f"`{id_col}`"].cast("long"), mine[sha])
    held, rest = parted(mine, own, lost.select(F.xxhash64("doc_id", "sha").alias("lost")))
    lost = lost.toDF(*key)
    on = held[f"`{id_col}`"].cast("long").eqNullSafe(lost[key[0]]) & (held[sha] == lost[key[1]])
    joined = held.join(lost, on, "left")
    names = docs.columns
    single = joined.where(F.col(key[0]).isNull() & F.col(key[1]).isNull()).select(*[joined[f"`{x}`"] for x in names])
    again = joined.where(F.col(key[2])).dropDuplicates([key[0], key[1]]).select(*[joined[f"`{x}`"] for x in names])
    return rest.select(*[rest[f"`{x}`"] for x in names]).unionByName(single).unionByName(again)


SQL = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
