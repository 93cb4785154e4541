"""Probing of files as they arrive. Probing keeps no state, so a stream of new files goes through the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.probe import Signature, probe_best
from strataspark.sources.blobs import HEAD_BYTES

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, signatures: list[Signature], files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame: each new file below ``path`` once, with its best match or nulls.

    Signatures are compared with the head as Latin-1 text, one character a byte.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).load(path)
    head = F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1")
    return probe_best(files.select(F.col("path").alias("logical_path"), F.col("length").alias("size"), head.alias("head")), signatures)
