"""Written intermediate tables, which survive the loss of executors and cut lineage.

Tables go to the folder that the session names in ``spark.checkpoint.dir``.  Only a local
master without that setting gets a folder of its own, ``/tmp/checkpoints``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: A table has at most so many files for each core, and at least so many are allowed: with more, making files is most of the work.
WAVES, LEAST_PARTS = 4, 32


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.  Unset on a cluster: ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Table:
    """A DataFrame that was written, and the way to delete it."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        fs, p = _filesystem(self.df.sparkSession, self.path)
        fs.delete(p, True)


def write(df: DataFrame, name: str) -> Table:
    """Writes ``df`` as Parquet and reads it again; the files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.coalesce(max(LEAST_PARTS, WAVES * spark.sparkContext.defaultParallelism)).write.parquet(path)
    fs, p = _filesystem(spark, path)
    fs.deleteOnExit(p)
    return Table(spark.read.schema(df.schema).parquet(path), path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return write(df, name).df
