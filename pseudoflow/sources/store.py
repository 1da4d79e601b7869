"""The mapping store: a log of small deltas and a compacted base, in session buckets, with commits written last.

``<path>/batch_id=N/session_bucket=K``        mapping rows that batch N added
``<path>.sessions/batch_id=N/session_bucket=K``  sessions that batch N saw: generation, rows, batch
``<path>.base/version=V`` and ``<path>.sessions.base/version=V``  everything up to batch V
``<path>.commits/batch-N``, ``base-V``        one row each, written after the data it names

Readers take the last base and the deltas after it, of committed batches only, so a batch that stopped
half-way leaves the former state readable, and its replay overwrites its own folders.  A batch reads only the buckets of its sessions:
their numbers (at most ``buckets``) go into a partition filter.  Compaction reads one state and writes the next base;
ids that carry a generation are ids like any other, so it keeps generations.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING = "session_id string, tag string, n long, token string, value string"
SESSIONS = "session_id string, generation int, n_rows long, last_seen long"
COMMITS = "id long, kind string, buckets int"


def has_data(spark: SparkSession, path: str) -> bool:
    """Errors of the store are raised: an unreadable mapping must not look like an empty one."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jpath) and len(fs.listStatus(jpath)) > 0


def _drop(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@dataclass
class State:
    base: Optional[int]
    deltas: list[int]


class MappingStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._commits().agg(F.max("buckets")).first()[0]
        self.buckets = found or buckets  # a store keeps the number it began with

    # ------------------------------------------------------------ commits

    def _commits(self) -> DataFrame:
        path = f"{self.path}.commits"
        if not has_data(self.spark, path):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(path)

    def _commit(self, number: int, kind: str) -> None:
        row = self.spark.range(1).select(F.lit(number).cast("long").alias("id"), F.lit(kind).alias("kind"), F.lit(self.buckets).alias("buckets"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}.commits/{kind}-{number}")

    def state(self, before: Optional[int] = None) -> State:
        """What a reader sees; ``before`` leaves out that batch (a replay) and later ones."""
        rows = [(r["kind"], r["id"]) for r in self._commits().collect() if before is None or r["id"] < before]
        base = max((i for k, i in rows if k == "base"), default=None)
        return State(base, sorted({i for k, i in rows if k == "batch" and (base is None or i > base)}))

    # ------------------------------------------------------------ reading

    def bucket(self, session: Column) -> Column:
        return F.pmod(F.xxhash64(session), F.lit(self.buckets)).cast("int")

    def buckets_of(self, sessions: DataFrame) -> list[int]:
        """Buckets of the sessions of a batch: at most ``buckets`` numbers."""
        return sorted(r[0] for r in sessions.select(self.bucket(F.col("session_id").cast("string"))).distinct().collect())

    def _read(self, path: str, schema: str, buckets: Optional[Sequence[int]], before: Optional[int]) -> DataFrame:
        state = self.state(before)
        cols = [c.split()[0] for c in schema.split(", ")]
        out = self.spark.createDataFrame([], schema)
        parts = []
        if state.base is not None:
            parts.append((f"{path}.base", [f"{path}.base/version={state.base}"]))
        if state.deltas:
            parts.append((path, [f"{path}/batch_id={n}" for n in state.deltas]))
        for root, folders in parts:
            df = self.spark.read.schema(f"{schema}, session_bucket int").option("basePath", root).parquet(*folders)
            if buckets is not None:
                df = df.where(F.col("session_bucket").isin(list(buckets)))
            out = out.unionByName(df.select(*cols))
        return out

    def mapping(self, buckets: Optional[Sequence[int]] = None, before: Optional[int] = None) -> DataFrame:
        return self._read(self.path, MAPPING, buckets, before)

    def sessions(self, buckets: Optional[Sequence[int]] = None, before: Optional[int] = None) -> DataFrame:
        """The registry, one row per session: its generation, its rows and the last batch that saw it."""
        seen = self._read(f"{self.path}.sessions", SESSIONS, buckets, before)
        return seen.groupBy("session_id").agg(F.max("generation").alias("generation"), F.sum("n_rows").alias("n_rows"), F.max("last_seen").alias("last_seen"))

    def mapping_for_session(self, session_id: str) -> DataFrame:
        """T5: all entries of one session, from its bucket alone."""
        bucket = self.buckets_of(self.spark.createDataFrame([(session_id,)], "session_id string"))
        return self.mapping(bucket).where(F.col("session_id") == session_id)

    # ------------------------------------------------------------ writing

    def _write(self, df: DataFrame, path: str, spread: str) -> None:
        out = df.withColumn("session_bucket", self.bucket(F.col("session_id")))
        out.repartition("session_bucket", F.pmod(F.xxhash64(spread), F.lit(8))).write.mode("overwrite").partitionBy("session_bucket").parquet(path)

    def write(self, batch_id: int, added: DataFrame, sessions: DataFrame) -> None:
        """The two tables of a batch; readers don't see them before ``commit``."""
        self._write(added.select("session_id", "tag", "n", "token", "value"), f"{self.path}/batch_id={batch_id}", "token")
        self._write(sessions.select("session_id", "generation", "n_rows", "last_seen"), f"{self.path}.sessions/batch_id={batch_id}", "session_id")

    def commit(self, batch_id: int) -> None:
        self._commit(batch_id, "batch")

    def compact(self, before: Optional[int] = None) -> Optional[int]:
        """Write the state (of batches before ``before``) as the next base; its number, None if there is nothing to do."""
        state = self.state(before)
        if not state.deltas:
            return None
        version = state.deltas[-1]
        self._write(self.mapping(before=before), f"{self.path}.base/version={version}", "token")
        self._write(self.sessions(before=before), f"{self.path}.sessions.base/version={version}", "session_id")
        self._commit(version, "base")
        return version

    def vacuum(self) -> None:
        """Delete what the last base has replaced.  Not while other readers of former states run."""
        state = self.state()
        if state.base is None:
            return
        for r in self._commits().collect():
            if r["id"] < state.base or (r["kind"] == "batch" and r["id"] <= state.base):
                _drop(self.spark, f"{self.path}.commits/{r['kind']}-{r['id']}")
                for root in (self.path, f"{self.path}.sessions"):
                    _drop(self.spark, f"{root}/batch_id={r['id']}" if r["kind"] == "batch" else f"{root}.base/version={r['id']}")

    def clear(self, sessions: DataFrame) -> None:
        """Forget sessions, in the mapping and in the registry: a new base without them."""
        state = self.state()
        newest = max([*state.deltas, -1 if state.base is None else state.base])
        if newest < 0:
            return
        gone = sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct()
        version = newest + 1  # takes a number of its own: an empty batch that was compacted
        self._write(self.mapping().join(gone, "session_id", "left_anti"), f"{self.path}.base/version={version}", "token")
        self._write(self.sessions().join(gone, "session_id", "left_anti"), f"{self.path}.sessions.base/version={version}", "session_id")
        self._commit(version, "base")


def session_registry(masked: DataFrame, number: int = 0) -> DataFrame:
    """Every session of a masked table, also those without hits: session_id, generation, n_rows, last_seen."""
    return masked.groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.count(F.lit(1)).alias("n_rows")) \
        .select("session_id", F.lit(1).alias("generation"), "n_rows", F.lit(number).cast("long").alias("last_seen"))
