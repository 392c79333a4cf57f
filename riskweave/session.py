"""Session-level helpers: the shared folder and tables staged in it."""

from __future__ import annotations

import tempfile
import threading
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins, then a checkpoint directory already set on the
    context.  Where neither is set, local mode (driver and executors are one process)
    gets a temporary folder, with a warning; any other master is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        configured = tempfile.mkdtemp(prefix="riskweave-")
        warnings.warn(f"spark.checkpoint.dir is not set; using {configured}", stacklevel=2)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


_scopes = threading.local()


def stage_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/riskweave/{app}/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside, once the block ends.

    For batches that write their results elsewhere: a long stream then leaves no staged
    tables behind.  Nothing lazy may leave the block.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            delete_path(spark, path)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage for inputs that several jobs read, keeps column pruning and
    filter pushdown, and outlives any executor.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return bool(hadoop_path.getFileSystem(conf).exists(hadoop_path))


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
