"""Inputs and outputs (I1, I2) and derived input tables built from the shipped parquet tables."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudoflow.sources.store import has_data, session_registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

#: Tasks that may write one bucket of a mapping.
BUCKET_TASKS = 8

# The row key of each shipped table (used to spread small inputs deterministically).
TABLE_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"),
              "customer": ("c_custkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"),
              "events": ("event_id",), "labels": ("doc_id",), "benchmark": ("item_id",)}


def spread(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Give CPU-heavy text work enough tasks when the input is a few large files.

    A big input (at least as many files as the cluster has cores) is left alone — no shuffle.
    A small one (for example one parquet row group holding every document) is hash-partitioned
    on its row key into 2 x default parallelism, which is deterministic on task retry.
    """
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        files = len(df._jdf.inputFiles())  # counted in the JVM; the paths are not copied to Python
    except Exception:  # noqa: BLE001 - not a file source, or a remote session
        return df
    if files == 0 or files >= par:
        return df
    cols = [c for c in keys if c in df.columns]
    return df.repartition(par * 2, *cols) if cols else df.repartition(par * 2)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_input: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TABLE_KEYS.get(name, ())) if spread_input else df


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text",
                   key_col: Optional[str] = None, schema: Optional[str] = None, **options) -> DataFrame:
    """Any source with a text column (parquet / json / csv / orc / text)."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if fmt == "text" and text_col != "value":
        df = df.withColumnRenamed("value", text_col)
    if text_col not in df.columns:
        raise ValueError(f"input has no text column {text_col!r}: {df.columns}")
    if key_col and key_col not in df.columns:
        raise ValueError(f"input has no key column {key_col!r}")
    return df


def write_outputs(masked: DataFrame, mapping: DataFrame, masked_path: str, mapping_path: str,
                  session_buckets: int = 64, mode: str = "overwrite") -> None:
    """Masked rows and the (sensitive) mapping go to separate locations.

    The mapping is partitioned by the number of buckets and a hash bucket of the session id, so a restore of
    one session reads one partition, whatever number it was written with.  A bucket is written by up to
    ``BUCKET_TASKS`` tasks, so that a giant session is not one task's and files stay few.
    """
    masked.write.mode(mode).parquet(masked_path)
    bucketed = mapping.withColumn("session_buckets", F.lit(session_buckets)) \
        .withColumn("session_bucket", F.pmod(F.xxhash64("session_id"), F.lit(session_buckets)))
    bucketed.repartition("session_bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKET_TASKS))) \
        .write.mode(mode).partitionBy("session_buckets", "session_bucket").parquet(mapping_path)


MANIFEST = "seq long, run_id string, masked string, mapping string, sessions string"


def write_run(masked: DataFrame, mapping: DataFrame, masked_path: str, mapping_path: str, run_id: str,
              session_buckets: int = 64) -> None:
    """I2 for a whole run: masked rows, mapping and session registry in folders of the run, then the manifest row that
    names them.  Readers go by the last manifest row, so a run that stops before it leaves the former state readable."""
    spark = masked.sparkSession
    own = {"masked": f"{masked_path}/run_id={run_id}", "mapping": f"{mapping_path}/run_id={run_id}", "sessions": f"{mapping_path}.sessions/run_id={run_id}"}
    write_outputs(masked, mapping, own["masked"], own["mapping"], session_buckets)
    session_registry(spark.read.schema(masked.schema).parquet(own["masked"])).write.mode("overwrite").parquet(own["sessions"])
    _commit_run(spark, mapping_path, run_id, own)


def _commit_run(spark: SparkSession, mapping_path: str, run_id: str, folders: dict[str, str]) -> None:
    last = committed_run(spark, mapping_path)
    row = spark.range(1).select(F.lit(last["seq"] + 1 if last else 0).cast("long").alias("seq"), F.lit(run_id).alias("run_id"),
                                *[F.lit(folders[k]).alias(k) for k in ("masked", "mapping", "sessions")])
    row.coalesce(1).write.mode("overwrite").parquet(f"{mapping_path}.manifest/{run_id}")


def committed_run(spark: SparkSession, mapping_path: str) -> Optional[dict]:
    """The manifest row of the last committed run, None without any."""
    path = f"{mapping_path}.manifest"
    if not has_data(spark, path):
        return None
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(path).orderBy(F.desc("seq")).limit(1).collect()
    return rows[0].asDict() if rows else None


def clear_run(spark: SparkSession, mapping_path: str, sessions: DataFrame, run_id: str) -> None:
    """T6 on a stored run: the sessions leave mapping and registry; committed as a run of its own, the masked rows stay."""
    last = committed_run(spark, mapping_path)
    if last is None:
        raise ValueError(f"{mapping_path} has no committed run")
    gone = sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct()
    own = {"masked": last["masked"], "mapping": f"{mapping_path}/run_id={run_id}", "sessions": f"{mapping_path}.sessions/run_id={run_id}"}
    spark.read.parquet(last["mapping"]).join(gone, "session_id", "left_anti") \
        .write.mode("overwrite").partitionBy("session_buckets", "session_bucket").parquet(own["mapping"])
    spark.read.parquet(last["sessions"]).join(gone, "session_id", "left_anti").write.mode("overwrite").parquet(own["sessions"])
    _commit_run(spark, mapping_path, run_id, own)


def read_mapping(spark: SparkSession, mapping_path: str, session_id: Optional[str] = None) -> DataFrame:
    """The mapping that ``write_outputs`` or the last committed ``write_run`` wrote; with ``session_id`` only that session's
    partitions are read (T5)."""
    run = committed_run(spark, mapping_path)
    df = spark.read.parquet(run["mapping"] if run else mapping_path)
    if session_id is not None:
        bucket = F.pmod(F.xxhash64(F.lit(session_id)), F.col("session_buckets"))
        df = df.filter((F.col("session_bucket") == bucket) & (F.col("session_id") == session_id))
    return df.drop("session_buckets", "session_bucket")


# The generated PII notes (both Spark SQL and DuckDB run this text; reads only `customer`).
PII_NOTES_SQL = """
SELECT c_custkey AS doc_id,
       concat('s', cast(c_nationkey AS string)) AS session_id,
       c_custkey AS call_seq,
       CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'pl' END AS lang,
       CASE WHEN c_custkey % 2 = 0 THEN
         concat('Client ', c_name, ' (SSN: ', lpad(cast(c_custkey % 950 AS string), 3, '0'), '-',
                lpad(cast(c_custkey % 7 AS string), 2, '0'), '-', lpad(cast(c_custkey % 300 AS string), 4, '0'),
                ') card 4', lpad(cast(c_custkey % 400 AS string), 14, '0'), cast(c_custkey % 10 AS string),
                ', mail c', cast(c_custkey % 200 AS string), '@shop.example.com; call (555) 010-',
                lpad(cast(c_custkey % 250 AS string), 4, '0'), '.')
       ELSE
         concat('Klient ', c_name, ' PESEL: ', cast(70000000000 + (c_custkey % 300) * 7919 AS string),
                ', NIP: 526-000-', lpad(cast(c_custkey % 20 AS string), 2, '0'), '-', lpad(cast(c_custkey % 10 AS string), 2, '0'),
                '; konto PL', lpad(cast(c_custkey % 350 AS string), 26, '0'),
                '; tel. +48 601 234 ', lpad(cast(c_custkey % 150 AS string), 3, '0'), '; e-mail k',
                cast(c_custkey % 120 AS string), '@firma.pl.')
       END AS text
FROM {customer}
"""


def pii_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated notes with SSN / card / PESEL / NIP / IBAN / phone / e-mail values (FIXTURES §3)."""
    return spark.sql(PII_NOTES_SQL, customer=read_table(spark, sf_dir, "customer"))


# Notes with the values of the paranoid rules (both dialects; reads only `customer`): addresses, codes, hosts.
PLACE_NOTES_SQL = """
SELECT c_custkey AS doc_id,
       concat('Ship to ', lpad(cast(c_custkey % 90000 + 10000 AS string), 5, '0'), CASE WHEN c_custkey % 3 = 0 THEN concat('-', lpad(cast(c_custkey % 10000 AS string), 4, '0')) ELSE '' END,
              ', kod ', lpad(cast(c_custkey % 100 AS string), 2, '0'), '-', lpad(cast(c_custkey % 1000 AS string), 3, '0'),
              ', host 2001:db8:0:', cast(c_custkey % 10 AS string), ':0:0:0:', cast(c_custkey % 9000 AS string),
              CASE WHEN c_custkey % 2 = 0 THEN concat(', see https://shop', cast(c_custkey % 50 AS string), '.example.com/o?id=', cast(c_custkey AS string), ' now') ELSE ' at 12:34' END) AS text
FROM {customer}
"""


def place_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated notes with zip and postal codes, IPv6 and web addresses."""
    return spark.sql(PLACE_NOTES_SQL, customer=read_table(spark, sf_dir, "customer"))
