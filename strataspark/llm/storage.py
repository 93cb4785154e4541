"""Intermediate tables in the folder that driver and executors share.

An iterative or multi-pass operator writes what it needs again as Parquet below ``spark.checkpoint.dir``. Such a
table cuts the lineage, is compressed and column-pruned, and survives a lost executor. A loop discards each round's tables
when the next one is written; what is left can be removed with ``clear`` once an application's results are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where it is unset on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strataspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strataspark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other job uses, in a folder of the application's own, which can go when its results are written."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Remove a table that ``materialise`` gave; nothing may read it, or what was derived from it unwritten, any more."""
    for path in getattr(table, "_written_at", ()):
        _remove(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results must have been written before."""
    _remove(spark, _own_dir(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with its schema given so that no files are sampled."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = (path,)
    return table
