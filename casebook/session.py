"""Session defaults and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "casebook", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (local tests) do we create one of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder every executor can reach "
                "(a machine-local folder does not survive the loss of that machine)")
        configured = tempfile.mkdtemp(prefix="casebook-ckpt-")  # local mode / tests only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def size_for_input(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20,
                   max_partitions: int = 200_000) -> dict:
    """Size scan splits and shuffles for an input of ``input_bytes``.

    Scan tasks read ``partition_bytes`` of files each; the first shuffle
    starts with about one partition per ``partition_bytes`` of input
    (bounded), and AQE coalesces small partitions towards the same advisory
    size and splits skewed ones, so tasks stay in executor memory at any
    scale.  Runtime SQL settings only: safe to call on a live session."""
    n = max(spark.sparkContext.defaultParallelism * 2,
            min(max_partitions, -(-input_bytes // partition_bytes)))
    conf = {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes * 4),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under ``path`` from the Hadoop FileSystem of that path (local,
    HDFS or object store alike); a metadata call, no data is read."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(conf).getContentSummary(p).getLength())


def input_signature(spark: SparkSession, path: str) -> int:
    """A hash of the names, sizes and modification times of the files under
    ``path`` (metadata calls only)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    files = []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(files)))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local
    on a cluster), with the scheme that folder has."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/casebook-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the loss
    of executors; never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
