"""File streams and read traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.checksums import folded_crc32

def grouped_streams(attributes: DataFrame, node: str, name: str, size: str) -> DataFrame:
    """(node, name, n_parts, size): null is a name of its own, the unnamed stream; the size is the largest seen."""
    return attributes.groupBy(node, name).agg(F.count("*").alias("n_parts"), F.max(size).alias("size"))


def run_gaps(runs: DataFrame, keys: list[str], first: str, following: str) -> DataFrame:
    """The runs that do not start where the one before ended, or not at 0 if first."""
    w = Window.partitionBy(*keys).orderBy(first, following)
    return runs.withColumn("expected", F.coalesce(F.lag(following).over(w), F.lit(0).cast("long"))).filter(F.col(first) != F.col("expected"))


def segment_checks(segments: DataFrame, key: str, ordinal: str, size: str) -> DataFrame:
    """(key, n_segments, full_size, last_size, equal_but_last, contiguous): fixed-size sets, by aggregates alone."""
    last = F.max(F.struct(ordinal, size))
    all_ = segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.min(F.struct(ordinal, size)).alias("lo"), last.alias("hi"))
    joined = segments.join(all_, key)
    others = joined.filter(F.col(ordinal) != F.col(f"hi.{ordinal}")).groupBy(key).agg(F.min(size).alias("least"), F.max(size).alias("most"))
    out = all_.join(others, key, "left")
    return out.select(
        key, "n_segments", F.col(f"lo.{size}").alias("full_size"), F.col(f"hi.{size}").alias("last_size"),
        ((F.col("n_segments") > 1) & (F.col("least") == F.col("most"))).alias("equal_but_last"),
        (F.col(f"hi.{ordinal}") - F.col(f"lo.{ordinal}") + 1 == F.col("n_segments")).alias("contiguous"),
    )


def read_statistics(trace: DataFrame, key: str, sequence: str, offset: str, length: str, split: Column | None = None) -> DataFrame:
    """Counts, bytes and seek distances per source; averages are integer floors, the gap average over n - 1 reads.

    ``split``, a non-decreasing function of the sequence, cuts a source's trace into parts: only each part's last read passes
    a window over the whole source."""
    end = F.col(offset) + F.col(length)
    if split is None:
        before = F.lag(end).over(Window.partitionBy(key).orderBy(sequence))
    else:
        trace = trace.withColumn("_part", split)
        lasts = trace.groupBy(key, "_part").agg(F.max_by(end, sequence).alias("_end"))
        carried = lasts.select(key, "_part", F.lag("_end").over(Window.partitionBy(key).orderBy("_part")).alias("_carried"))
        trace = trace.join(carried, [key, "_part"])
        before = F.coalesce(F.lag(end).over(Window.partitionBy(key, "_part").orderBy(sequence)), F.col("_carried"))
    gap = F.abs(F.col(offset) - before)
    n = F.count("*")
    return (
        trace.withColumn("_gap", gap)
        .groupBy(key)
        .agg(n.alias("reads"), F.sum(length).alias("bytes"), F.max(length).alias("max_bytes"), F.coalesce(F.sum("_gap"), F.lit(0).cast("long")).alias("gap_sum"), F.coalesce(F.max("_gap"), F.lit(0).cast("long")).alias("gap_max"))
        .withColumn("avg_bytes", F.expr("bytes div reads"))
        .withColumn("gap_avg", F.expr("CASE WHEN reads > 1 THEN gap_sum div (reads - 1) ELSE 0 END"))
    )


def stream_checks(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_parts, size, valid_size, mixed, gap_free, ok): one row for each stream. Parts must be all resident or none,
    and follow each other from 0. ``attributes`` has (keys, resident, first, following, size, valid_size)."""
    w = Window.partitionBy(*keys).orderBy("first", "following")
    gap = (F.col("first") != F.coalesce(F.lag("following").over(w), F.lit(0))) & ~F.col("resident")
    found = attributes.withColumn("_gap", gap).groupBy(*keys).agg(
        F.count("*").alias("n_parts"), F.max("size").alias("size"), F.max("valid_size").alias("valid_size"), (F.bool_or("resident") & ~F.bool_and("resident")).alias("mixed"), (~F.bool_or("_gap")).alias("gap_free")
    )
    return found.withColumn("ok", F.col("gap_free") & ~F.col("mixed"))


def default_streams(nodes: DataFrame) -> DataFrame:
    """(node_id, stream_kind, stream_name, size): files and symbolic links have one data stream, others none."""
    return nodes.filter(F.col("kind").isin("File", "Symlink")).select("node_id", F.lit("Data").alias("stream_kind"), F.lit(None).cast("string").alias("stream_name"), "size")


def named_streams(nodes: DataFrame, attributes: DataFrame, fork: str) -> DataFrame:
    """(node_id, stream_kind, stream_name, size): the data stream of each file and a stream for each extended attribute
    (node_id, name, size); the one called ``fork`` is the resource fork."""
    kind = F.when(F.col("name") == fork, "ResourceFork").otherwise("ExtendedAttribute")
    extra = attributes.select("node_id", kind.alias("stream_kind"), F.when(kind != "ResourceFork", F.col("name")).alias("stream_name"), "size")
    return default_streams(nodes).union(extra)


def opened_streams(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """Each request (request_id, node_id, stream_kind, stream_name) with its stream's size and ``status``, Ok or NotFound."""
    same = (F.col("r.node_id") == F.col("s.node_id")) & (F.col("r.stream_kind") == F.col("s.stream_kind")) & F.col("r.stream_name").eqNullSafe(F.col("s.stream_name"))
    joined = requests.alias("r").join(streams.alias("s"), same, "left")
    return joined.select("r.*", F.col("s.size").alias("size"), F.when(F.col("s.node_id").isNull(), "NotFound").otherwise("Ok").alias("status"))


#: The kinds of a mode's upper bits.
MODE_KINDS = {0x4000: "Directory", 0x8000: "File", 0xA000: "Symlink"}


def node_kind(mode: Column, reparse: Column | None = None) -> Column:
    """File, Directory, Symlink or Special, from the mode; a reparse point that is a link makes any node a symbolic link."""
    table = F.create_map(*(F.lit(x) for kv in MODE_KINDS.items() for x in kv))
    kind = F.coalesce(F.try_element_at(table, mode.bitwiseAND(F.lit(0xF000)).cast("int")), F.lit("Special"))
    return kind if reparse is None else F.when(reparse.isin("MountPoint", "SymbolicLink"), "Symlink").otherwise(kind)


def node_details(inodes: DataFrame) -> DataFrame:
    """(node_id, kind, permissions, set_uid, set_gid, sticky, owner, group, flags, created, modified, accessed); raw times."""
    bit = lambda n: F.getbit("mode", F.lit(n)) == 1
    return inodes.select(
        "node_id", node_kind(F.col("mode")).alias("kind"), F.lpad(F.conv(F.col("mode").bitwiseAND(F.lit(0o777)).cast("string"), 10, 8), 3, "0").alias("permissions"), bit(11).alias("set_uid"), bit(10).alias("set_gid"),
        bit(9).alias("sticky"), "owner", "group", "flags", "created", "modified", "accessed",
    )


def object_sizes(extents: DataFrame, key: str, start: str, length: str) -> DataFrame:
    """(key, size): where each object's last extent ends."""
    return extents.groupBy(key).agg(F.max(F.col(start) + F.col(length)).alias("size"))


def folded_checksums(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, crc32, length): the CRC-32 of each object's chunks laid end to end. Chunks are reduced to a checksum and a length
    where they are; only those, 16 bytes a chunk, are brought together in order and combined."""
    parts = chunks.select(key, F.col(order).alias("_o"), F.crc32(data).alias("crc"), F.length(data).cast("long").alias("length"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_o", "crc", "length"))), lambda x: F.struct(x["crc"].alias("crc"), x["length"].alias("length")))
    held = parts.groupBy(key).agg(ordered.alias("_parts"), F.sum("length").alias("length"))
    return held.select(key, folded_crc32("_parts").alias("crc32"), "length")


def recognised(volumes: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(key, n_volumes, n_recognised): how many of a source's volumes (key, index) some probe matched (key, index)."""
    hit = matches.select(key, "index").distinct().withColumn("_hit", F.lit(True))
    return volumes.join(hit, [key, "index"], "left").groupBy(key).agg(F.count("*").alias("n_volumes"), F.count_if(F.col("_hit").isNotNull()).alias("n_recognised"))


def covered_sizes(blocks: DataFrame, declared: DataFrame, key: str, start: str, length: str, size: str) -> DataFrame:
    """(key, covered, declared, ok): the lengths of the blocks that lie within the declared size, against that size."""
    inside = blocks.join(declared.select(key, F.col(size).alias("declared")), key)
    total = F.sum(F.when(F.col(start) + F.col(length) <= F.col("declared"), F.col(length)).otherwise(0))
    return inside.groupBy(key, "declared").agg(total.alias("covered")).select(key, "covered", "declared", (F.col("covered") == F.col("declared")).alias("ok"))
