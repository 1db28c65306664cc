"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SPREAD = "spark.foliant.spread"
TASK_ROWS = 200_000  # rows of a task where sorts and aggregates hold them


def build_session(app: str = "foliant", cpus: int | None = None, scratch: str | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own.

    ``scratch`` is its ``spark.checkpoint.dir``; without one a new temporary folder is, and goes with the process.
    """
    cores = cpus or os.cpu_count() or 4
    folder = scratch or _temporary()
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", folder)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(SPREAD, "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master gets a temporary folder when the setting is missing, for as long as the process lives.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = _temporary()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="foliant-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def clear_scratch(spark: SparkSession) -> None:
    """Removes what this library has written below the shared folder; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/foliant")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; unlike a checkpoint its size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame) -> int:
    """How many tasks hold the rows of ``df`` in bounded memory; reads it once, so it should be a written one.

    What is dealt into a stated number of parts is not put together again by its compressed size, which says little about
    rows that are mostly NULL or alike.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan over the cores, where the session asks for it.

    For tables that are one small file each, hence one scan task, as in tests and benches;
    ``spark.foliant.spread`` of the session turns it on. Elsewhere ``df`` stays as it is and no shuffle is added.
    """
    spark = df.sparkSession
    if spark.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, *keys)
