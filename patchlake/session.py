"""Session settings, reliable checkpoints and shared scratch folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Scratch paths this process made and has not released yet.
_SCRATCH: list[str] = []


def build_session(app_name: str = "patchlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Skewed lookups are left to the adaptive skew join, so it is forced on: one
    extra shuffle is cheaper than one task that holds a third of the rows.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Small files with work per row (texts, messages, code) are still read by all cores.
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.sql.files.openCostInBytes", "262144")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A session in one local process may leave it unset and gets a temporary
    folder, which goes when the process ends. Anywhere else that folder would lie
    on one machine only, so the setting is required.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not is_one_process(context.master):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        current = context.getCheckpointDir()
    return current


def is_one_process(master: str) -> bool:
    """Whether driver and executors are one local process."""
    return master.startswith("local") and not master.startswith("local-cluster")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back.

    For wide tables that several later steps read: unlike a checkpoint, a step
    that needs two columns reads two columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    kept.kept_path = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`stored` when everything that reads them is stored itself."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.kept_path)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused; :func:`release` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this process has stored so far, for its owner to call when no result reads it any more."""
    configuration = spark._jsc.hadoopConfiguration()
    gone = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += path.getFileSystem(configuration).delete(path, True)
    return gone
