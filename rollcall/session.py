"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Scale-dependent knobs (shuffle partitions,
# maxPartitionBytes, executor memory) come from the cluster's own config.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key (one email, one event) even when that costs an extra shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int | None = None,
    app: str = "rollcall",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local session for tests and benchmarks (the driver JVM is the executor)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("ROLLCALL_DRIVER_MEMORY", "16g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the session's reliable checkpoint directory.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``;
    it is only set here when the session has none (tests, local runs).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not fallback and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; a machine-local folder is not reliable")
    target = configured or fallback or tempfile.mkdtemp(prefix="rollcall-ckpt-", dir="/tmp")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint directory.

    Used where a plan reads a table it later appends to, so the append does
    not re-read its own output, and where a lost executor must not force
    recomputation of a long lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table under the reliable checkpoint directory and read it back.

    The columnar, compressed copy cuts the lineage like ``checkpoint()`` and is
    read back with column pruning and filter pushdown, which matters for the
    large intermediate results (the shared national join). The folder is the
    shared one named by ``spark.checkpoint.dir``; each call writes a new path.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/staged/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def size_for_input(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for an input of ``input_bytes`` (the largest table a job reads).

    Scan splits of ``partition_bytes``; the initial shuffle partition count is
    sized so the largest shuffle (about the size of the scanned, pruned input)
    lands near ``partition_bytes`` per partition, and AQE coalesces smaller
    stages down from there. Returns the settings it applied.
    """
    n = max(200, math.ceil(input_bytes / partition_bytes))
    settings = {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings
