"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from typing import Dict, Iterator, List, Optional

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  app: str = "basketlens", driver_memory: str = "8g",
                  conf: Optional[Dict[str, str]] = None) -> SparkSession:
    """A local session configured the way the tests and the bench run."""
    builder = SparkSession.builder
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees, for intermediate tables and checkpoints.

    ``spark.checkpoint.dir`` of the session, else the checkpoint folder the
    caller registered.  Only a session inside one machine (``local``,
    ``local[n]``) may fall back to a temporary folder: executors of a cluster
    cannot read the driver's disk, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketlens-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` has a folder; one the caller has set is kept."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark.sparkContext.getCheckpointDir()


_SCOPES: List[List[str]] = []   # paths handed out since each open ``scratch_scope`` began


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one written intermediate table."""
    path = f"{shared_dir(spark)}/basketlens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[List[str]]:
    """Deletes, at the end of the block, the intermediate tables that were written in it.

    The block gets the list of their paths; what it takes out of the list stays.
    """
    paths: List[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [scope for scope in _SCOPES if scope is not paths]
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (survives lost executors, nothing is computed twice) and
    gives the planner the table's real size, so that joins with it are
    broadcast only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, jobs hand their Python tasks this many rows at a time.

    For tables whose rows are long (megabytes), of which the session's usual
    number would not fit into a task.  Jobs must run inside the block.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables this application has written."""
    delete(spark, f"{shared_dir(spark)}/basketlens-{spark.sparkContext.applicationId}")
