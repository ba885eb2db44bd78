"""Where intermediate tables go, and writing a costly result once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only in local mode, and when the session names none, a temporary folder is
    used; on a cluster a missing ``spark.checkpoint.dir`` is an error, as each
    executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to storage that the driver and all executors share")
    return tempfile.mkdtemp(prefix="plumbline-")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet and read it back; also where it lies, for :func:`discard`.

    Passes over it read only the columns they need, and Catalyst knows its size.
    """
    path = fresh_dir(df.sparkSession, "result")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own, wherever its file system is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
