"""Rounds of an iterative operator as written tables, so that each round's plan is short and a lost executor costs one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strataspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Rounds:
    """Writes each round's table and removes the one before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{_shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self.round, self.last = 0, None

    def write(self, df: DataFrame, group_bytes: int | None = None) -> DataFrame:
        """``group_bytes`` bounds the row groups: for wide rows, as a reader's batch is up to 4,096 rows of one group."""
        self.round += 1
        path = f"{self.base}/{self.round}"
        (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
        if self.last:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)
