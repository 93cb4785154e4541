"""On-disk structures as columns: byte fields are expressions on a BINARY column, so decoding stays in generated code.

A malformed structure gives ``ok = false`` rows in the checks and no volumes; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.checksums import byte_sum
from strataspark.functions.text import utf16_text

#: Fixed values of the partition tables.
MBR_SIGNATURE = "55AA"
MBR_PROTECTIVE = "EE"
MBR_EXTENDED = ("05", "0F", "85")
GPT_SIGNATURE = "EFI PART"
UNUSED_GUID = "00000000-0000-0000-0000-000000000000"
FAT_BOUNDS = (4085, 65525)


def field(data: Column, offset: int | Column, size: int) -> Column:
    """``size`` bytes from ``offset``; shorter at the end of the data."""
    start = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(data, start + 1, F.lit(size))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated once for each row: a generator of one row stands between them and their uses, so the
    optimiser does not copy long expressions into every use or filter. No shuffle."""
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return made.select(*(f"`{c}`" for c in df.columns), *(F.col("_once").getField(n).alias(n) for n in columns))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, wherever it stands: inside lambdas too, where ``once`` cannot be."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def uint(data: Column, offset: int | Column, size: int, big: bool = False) -> Column:
    """An unsigned integer of up to 8 bytes as DECIMAL(20,0), up to 7 bytes as BIGINT; null past the end of the data."""
    raw = F.hex(field(data, offset, size))
    order = range(size) if big else range(size - 1, -1, -1)
    digits = F.conv(reduce(F.concat, (F.substring(raw, 2 * i + 1, 2) for i in order)) if size > 1 else raw, 16, 10)
    return F.when(F.length(raw) == 2 * size, digits.cast("decimal(20,0)" if size == 8 else "long"))


def guid(data: Column, offset: int | Column) -> Column:
    """Canonical text of a GUID whose first three fields are little-endian."""
    h = F.lower(F.hex(field(data, offset, 16)))
    part = lambda *at: F.concat(*(F.substring(h, 2 * i + 1, 2) for i in at))
    return F.concat_ws("-", part(3, 2, 1, 0), part(5, 4), part(7, 6), part(8, 9), part(10, 11, 12, 13, 14, 15))


def mbr_partitions(sources: DataFrame, key: str = "source_id", head: str = "head", sector: int = 512) -> DataFrame:
    """(key, index, byte_offset, byte_size, type_code, role) of the four primary entries in use; needs the boot signature."""
    data = F.col(head)
    entries = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index")
    at = F.lit(446) + F.col("index") * 16
    rows = sources.filter(F.hex(field(data, 510, 2)) == MBR_SIGNATURE).select(key, head, entries)
    decoded = rows.select(
        key, "index", (uint(data, at + 8, 4) * sector).alias("byte_offset"), (uint(data, at + 12, 4) * sector).alias("byte_size"), F.hex(field(data, at + 4, 1)).alias("type_code")
    ).filter("type_code <> '00' AND byte_size > 0")
    role = F.when(F.col("type_code") == MBR_PROTECTIVE, "Protective").when(F.col("type_code").isin(*MBR_EXTENDED), "Extended").otherwise("Primary")
    return decoded.withColumn("role", role)


def gpt_header(sources: DataFrame, key: str = "source_id", head: str = "head", block: int = 512) -> DataFrame:
    """One row per source with the header's fields at block 1, ``crc_ok`` and ``ok``."""
    data = F.col(head)
    header_size = uint(data, block + 12, 4)
    sane = header_size.between(92, block)
    zeroed = F.concat(field(data, block, 16), F.to_binary(F.lit("00000000"), F.lit("hex")), F.substring(data, F.lit(block + 21), (F.when(sane, header_size).otherwise(92) - 20).cast("int")))
    fields = {
        "signature": F.decode(field(data, block, 8), "ISO-8859-1"), "header_size": header_size, "header_crc": uint(data, block + 16, 4), "first_usable": uint(data, block + 40, 8),
        "last_usable": uint(data, block + 48, 8), "disk_guid": guid(data, block + 56), "entries_lba": uint(data, block + 72, 8), "n_entries": uint(data, block + 80, 4),
        "entry_size": uint(data, block + 84, 4), "entries_crc": uint(data, block + 88, 4),
    }
    decoded = sources.select(key, head, *(c.alias(n) for n, c in fields.items()), (F.crc32(zeroed) == uint(data, block + 16, 4)).alias("crc_ok"))
    entries = F.substring(data, (F.col("entries_lba") * block + 1).cast("int"), (F.col("n_entries") * F.col("entry_size")).cast("int"))
    bounded = (F.col("entries_lba") < 2**20) & (F.col("n_entries") <= 4096) & F.col("entry_size").between(128, 4096)
    checked = decoded.withColumn("entries_ok", F.when(bounded, F.crc32(entries) == F.col("entries_crc")).otherwise(F.lit(False)))
    ok = (F.col("signature") == GPT_SIGNATURE) & F.coalesce("crc_ok", F.lit(False)) & F.coalesce("entries_ok", F.lit(False))
    return checked.withColumn("ok", F.coalesce(ok, F.lit(False)))


def gpt_partitions(sources: DataFrame, key: str = "source_id", head: str = "head", block: int = 512) -> DataFrame:
    """(key, index, byte_offset, byte_size, type_code, unique_guid, name) of the entries in use, from valid primary headers."""
    data = F.col(head)
    header = gpt_header(sources, key, head, block).filter("ok")
    rows = header.select(key, head, "entries_lba", "entry_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_entries") - 1)).alias("index"))
    at = (F.col("entries_lba") * block + F.col("index") * F.col("entry_size")).cast("int")
    first, last = uint(data, at + 32, 8).cast("long"), uint(data, at + 40, 8).cast("long")
    name = utf16_text(field(data, at + 56, 72))
    decoded = rows.select(key, F.col("index").cast("int").alias("index"), (first * block).alias("byte_offset"), ((last - first + 1) * block).alias("byte_size"), guid(data, at).alias("type_code"), guid(data, at + 16).alias("unique_guid"), name.alias("name"))
    return decoded.filter(F.col("type_code") != UNUSED_GUID)


def fat_boot_sector(sources: DataFrame, key: str = "source_id", head: str = "head") -> DataFrame:
    """(key, variant, cluster_size, n_clusters, ok): the variant follows from the number of clusters."""
    data = F.col(head)
    sector, per_cluster, reserved, fats, roots = uint(data, 11, 2), uint(data, 13, 1), uint(data, 14, 2), uint(data, 16, 1), uint(data, 17, 2)
    total = F.when(uint(data, 19, 2) > 0, uint(data, 19, 2)).otherwise(uint(data, 32, 4))
    fat_size = F.when(uint(data, 22, 2) > 0, uint(data, 22, 2)).otherwise(uint(data, 36, 4))
    sane = sector.isin(512, 1024, 2048, 4096) & per_cluster.isin(1, 2, 4, 8, 16, 32, 64, 128) & (reserved > 0) & fats.between(1, 2)
    root_sectors = F.ceil(roots * 32 / F.when(sane, sector)).cast("long")
    clusters = F.floor((total - reserved - fats * fat_size - root_sectors) / F.when(sane, per_cluster)).cast("long")
    variant = F.when(clusters < FAT_BOUNDS[0], "FAT12").when(clusters < FAT_BOUNDS[1], "FAT16").otherwise("FAT32")
    ok = F.coalesce(sane & (clusters > 0) & (F.hex(field(data, 510, 2)) == MBR_SIGNATURE), F.lit(False))
    return sources.select(key, F.when(ok, variant).alias("variant"), F.when(ok, sector * per_cluster).alias("cluster_size"), F.when(ok, clusters).alias("n_clusters"), ok.alias("ok"))


def ones_complement_ok(data: Column, size: int, at: int) -> Column:
    """Whether the 4 big-endian bytes at ``at`` are the inverted sum of the structure's other bytes."""
    others = F.concat(field(data, 0, at), field(data, at + 4, size - at - 4))
    total = byte_sum(F.when(F.length(data) >= size, others))
    return F.coalesce((F.lit(0xFFFFFFFF) - total) == uint(data, at, 4, big=True), F.lit(False))
