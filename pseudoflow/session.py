"""Session helpers: a tuned SparkSession for local runs and a reliable materialisation step."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Settings for a large cluster (values are starting points, not fixed limits).
SCALE_CONF = {
    # AQE: start with many shuffle partitions, let AQE coalesce small ones and split skewed joins
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8000",
    # scan splits: text rows are large; 128 MB splits keep a task's fold within executor memory
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
    # HOF folds over long texts allocate per row: keep Arrow / Python batches moderate
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # originals can reach shuffle files and spills: encrypt them
    "spark.io.encryption.enabled": "true",
}


def apply_scale_conf(spark: SparkSession, overrides: dict | None = None) -> None:
    """Apply ``SCALE_CONF`` (runtime-settable keys only) plus ``overrides`` to a session."""
    for k, v in {**SCALE_CONF, **(overrides or {})}.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # noqa: BLE001 - static settings (e.g. io encryption) belong in spark-submit
            pass


def get_spark(master: str | None = None, app: str = "pseudoflow", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests / benches.  On a cluster use the cluster's own session instead."""
    master = master or os.environ.get("PSEUDOFLOW_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("PSEUDOFLOW_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PSEUDOFLOW_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that setting is always
    used when present.  Where it is unset, a private folder is created on a local master (tests); a cluster
    is refused.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a remote (Connect) session: the server owns the setting
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the server and all executors share") from None
        return found
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="pseudoflow-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint directory.

    Used where one expensive result (the segment table) feeds several outputs, so that it is
    computed once and survives executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
