"""Byte sources as tables: whole small files, heads and tails for probing, and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that probing may look at, from either end.
HEAD_BYTES, TAIL_BYTES = 65_536, 4_096
#: Places of four bytes beyond the head that probes look at.
FAR = (65_536 + 0x21C, 262_144 + 0x21C, 0x200000)


def blob_sources(spark: SparkSession, path: str) -> DataFrame:
    """(logical_path, parent_path, entry_name, extension, size, bytes) of the files below ``path``, each at most 2 GB.

    Spark's reader leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    extension = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    parent = F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    return files.select(F.col("path").alias("logical_path"), parent.alias("parent_path"), name.alias("entry_name"), extension.alias("extension"), F.col("length").alias("size"), F.col("content").alias("bytes"))


def heads(sources: DataFrame) -> DataFrame:
    """Head, tail and ``far`` (offset to four bytes) in place of the bytes: what probes read, materialised once per source."""
    rest = [c for c in sources.columns if c != "bytes"]
    tail = F.expr(f"substring(bytes, greatest(length(bytes) - {TAIL_BYTES}, 0) + 1, {TAIL_BYTES})")
    far = F.create_map(*(x for at in FAR for x in (F.lit(at), F.substring("bytes", at + 1, 4))))
    return sources.select(*rest, F.substring("bytes", 1, HEAD_BYTES).alias("head"), tail.alias("tail"), far.alias("far"))


def slices(sources: DataFrame, ranges: DataFrame, key: str = "source_id") -> DataFrame:
    """(the ranges' columns, bytes, n_read, complete): each range's bytes, clipped to the source. A read past the end gives no
    bytes; ``complete`` tells whether all that was asked for is there. Ranges have (key, offset, length)."""
    # Sources that compress well look small once shuffled: a stated number of partitions keeps them from being put in one.
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = sources.select(F.col(key).alias("_key"), F.col("bytes").alias("_bytes")).repartition(parts, "_key")
    inside = (F.col("offset") >= 0) & (F.col("offset") < F.length("_bytes"))
    piece = F.when(inside, F.substring("_bytes", (F.col("offset") + 1).cast("int"), F.greatest(F.col("length"), F.lit(0)).cast("int"))).otherwise(F.lit(b""))
    joined = ranges.join(whole, F.col(key) == F.col("_key"))
    return joined.select(*ranges.columns, piece.alias("bytes")).withColumn("n_read", F.length("bytes").cast("long")).withColumn("complete", F.col("n_read") == F.col("length"))


def segment_windows(segments: DataFrame, margin: int) -> DataFrame:
    """(set_id, ordinal, logical_offset, length, complete_set): segments of a set behind each other without their first
    ``margin`` bytes. A set is complete if its ordinals are 1 to the count that each segment declares.
    Segments have (set_id, ordinal, declared, size)."""
    w = Window.partitionBy("set_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # a set has few segments
    whole = segments.groupBy("set_id").agg(
        ((F.count("*") == F.max("declared")) & (F.min("declared") == F.max("declared")) & (F.min("ordinal") == 1) & (F.max("ordinal") == F.count("*")) & (F.count_distinct("ordinal") == F.count("*"))).alias("complete_set")
    )
    length = F.greatest(F.col("size") - margin, F.lit(0))
    placed = segments.withColumn("length", length).withColumn("logical_offset", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return placed.join(whole, "set_id").select("set_id", "ordinal", "logical_offset", "length", "complete_set")


def windows(sources: DataFrame, key: str, size: int) -> DataFrame:
    """(key, window_offset, length, bytes): the bytes in windows; an empty source has none."""
    starts = F.explode(F.when(F.length("bytes") > 0, F.sequence(F.lit(0), F.length("bytes") - 1, F.lit(size))).otherwise(F.array().cast("array<int>")))
    cut = sources.select(key, "bytes", starts.alias("window_offset"))
    piece = F.substring("bytes", F.col("window_offset") + 1, F.lit(size))
    return cut.select(key, F.col("window_offset").cast("long").alias("window_offset"), F.length(piece).alias("length"), piece.alias("bytes"))


def related_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Each request (request_id, purpose, parent_path, relative_path) with the path of the source found: the relative path
    below the parent, else a sibling with its last component; null if neither is there."""
    known = sources.select(F.col("logical_path").alias("found")).distinct()
    first = F.concat_ws("/", "parent_path", "relative_path")
    second = F.concat_ws("/", "parent_path", F.substring_index("relative_path", "/", -1))
    tries = requests.select("*", F.explode(F.array(F.struct(F.lit(0).alias("rank"), first.alias("path")), F.struct(F.lit(1).alias("rank"), second.alias("path")))).alias("try"))
    hits = tries.join(known, F.col("try.path") == F.col("found")).groupBy("request_id").agg(F.min(F.struct("try.rank", "found"))["found"].alias("resolved"))
    return requests.join(hits, "request_id", "left")
