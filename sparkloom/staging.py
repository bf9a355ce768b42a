"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that nothing refers to any more.

    Spark frees them when the driver collects its garbage, which a driver with little to do
    may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Stage:
    """Written tables that cut the lineage.

    A lost executor then costs the tasks that were running, not the steps before.
    Tables go when dropped, the rest when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = self._filesystem(self.root)
        fs.deleteOnExit(path)

    def _filesystem(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        fs, path = self._filesystem(f"{self.root}/{name}")
        fs.delete(path, True)

    def only(self, *names: str) -> None:
        """Drop every table but these, once nothing to come reads the others."""
        fs, root = self._filesystem(self.root)
        for status in fs.listStatus(root) if fs.exists(root) else ():
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)
