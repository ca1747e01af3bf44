"""Shared storage: lineage is cut in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine, where that is unset, a folder made once for the session.

    Executors of a cluster don't see a folder of the driver's machine, so there
    the setting has to be made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="roadgrid_"))
    return sc.getCheckpointDir().rstrip("/")


_tables: list = []


def place(spark: SparkSession, label: str) -> str:
    """A new path in shared storage, which release() deletes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """The rows of df as a Parquet table in shared storage, read back."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._roadgrid_table = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once: later steps read them and lose nothing with an executor.

    A table, not checkpoint(): a checkpoint keeps the estimated size of its plan,
    which after some rounds of joins is a number of megabytes.
    """
    return written(df)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the tables of these frames of written() and cut(), or all that this process has written; frames that read them are then of no use."""
    for table in [f._roadgrid_table for f in frames] if frames else list(_tables):
        if table in _tables:
            _tables.remove(table)
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
