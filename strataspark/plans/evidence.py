"""Queries over bytes built from the driver's tables: probing by the catalogue, headers, partition tables, address maps,
namespaces and streams. What was written into the bytes is what the SQL expects back, so a query is green only if decoding
gives the numbers that went in and the rules agree.
"""

from __future__ import annotations

import bz2
import lzma
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import checksums, descriptors, text
from strataspark.operators import chains, decode, extents, headers, namespace, partitions, probe, signatures, streams, versions, volumes
from strataspark.plans.registry import query, table
from strataspark.plans.samples import RELATED, SAMPLES, be, blob, le, mbr_entry, padded
from strataspark.sources import blobs
from strataspark.sources.tables import Rounds

_long = lambda c: F.col(c).cast("long")



def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows from which bytes are built, over all cores: a table of few megabytes is read by one task, whatever its rows become."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def stored(df: DataFrame) -> DataFrame:
    """Sources as they would lie in a store: the bytes are built once, not in every expression that reads them."""
    return Rounds(df.sparkSession).write(df, 1 << 20)


# --- probing -------------------------------------------------------------------------------------------------------

_SAMPLE_ROWS = ", ".join(f"({i}, '{f}', '{k}', '{c}')" for i, (f, k, c, *_) in enumerate(SAMPLES))
_SAMPLE_SQL = f"WITH s(i, format_id, kind, confidence) AS (VALUES {_SAMPLE_ROWS}) SELECT p_partkey AS source_id, format_id, kind, confidence FROM part JOIN s ON p_partkey % {len(SAMPLES)} = i"


def sample_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each part: one of the samples, in a folder of its own kind, and the files that the samples name."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(SAMPLES) + 1).cast("int"))
    part = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("source_id"), pick([x[3] for x in SAMPLES]).alias("head"), pick([x[4] or b"" for x in SAMPLES]).alias("tail"), pick([x[5] for x in SAMPLES]).alias("name"))
    related = spark.createDataFrame([(None, bytearray(), bytearray(), x) for x in RELATED], "source_id long, head binary, tail binary, name string")
    both = part.withColumn("source_id", _long("source_id")).union(related).withColumn("logical_path", F.concat(F.lit("/e/"), "name"))
    parent = F.regexp_replace("logical_path", "/[^/]*$", "")
    entry = F.substring_index("name", "/", -1)
    extension = F.when(entry.contains("."), F.substring_index(entry, ".", -1)).otherwise("")
    size = F.when(F.length("tail") > 0, F.lit(4096)).otherwise(F.length("head")).cast("long")
    return stored(both.select("source_id", "logical_path", parent.alias("parent_path"), entry.alias("entry_name"), extension.alias("extension"), size.alias("size"), "head", "tail", F.map_from_arrays(F.array(F.lit(0)), F.array(F.lit(b""))).alias("far")))


@query(_SAMPLE_SQL)
def q_signature_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which real format each source is: every rule of the catalogue has a sample."""
    found = probe.probe_best(signatures.probe_sources(sample_sources(spark, sf_dir)), signatures.SIGNATURES)
    return found.filter("source_id IS NOT NULL").select("source_id", "format_id", "kind", "confidence")


@query(_SAMPLE_SQL + " WHERE kind = 'FileSystem'")
def q_signature_filesystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probe.probe_all(signatures.probe_sources(sample_sources(spark, sf_dir)), signatures.SIGNATURES, kind="FileSystem")
    return found.filter("source_id IS NOT NULL").select("source_id", "format_id", "kind", "confidence")


@query(_SAMPLE_SQL.replace("SELECT p_partkey AS source_id, format_id, kind, confidence", "SELECT kind, count(*) AS n_volumes, count(*) FILTER (kind = 'FileSystem') AS n_recognised") + " GROUP BY kind")
def q_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each kind's sources a file system's rule recognises."""
    sources = signatures.probe_sources(sample_sources(spark, sf_dir)).filter("source_id IS NOT NULL")
    best = probe.probe_best(sources, signatures.SIGNATURES).select("kind", F.col("source_id").alias("index"))
    known = probe.probe_all(sources, signatures.SIGNATURES, kind="FileSystem").select("kind", F.col("source_id").alias("index"))
    return streams.recognised(best, known, "kind")


# --- headers -------------------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_orderkey AS source_id, o_orderkey % 4 AS version, 9 + o_custkey % 15 AS cluster_bits, o_orderkey * 512 AS virtual_size, o_custkey % 3 AS snapshots FROM orders),
f AS (SELECT *, version BETWEEN 1 AND 3 AND cluster_bits <= 21 AND virtual_size > 0 AS ok FROM o)
SELECT source_id, version, cluster_bits, CAST(virtual_size AS BIGINT) AS virtual_size, CASE WHEN version = 1 THEN 0 ELSE snapshots END AS snapshots, ok FROM f
""")
def q_header_qcow(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") % 4).alias("v"), (F.col("o_custkey") % 15 + 9).alias("b"), (F.col("o_orderkey") * 512).alias("vs"), (F.col("o_custkey") % 3).alias("sn"))
    one = blob(112, {0: (b"QFI\xfb", 4), 4: (be(F.col("v"), 4), 4), 24: (be(F.col("vs"), 8), 8), 32: (be(F.col("b"), 1), 1), 33: (be(9, 1), 1), 40: (be(1024, 8), 8)})
    many = blob(112, {0: (b"QFI\xfb", 4), 4: (be(F.col("v"), 4), 4), 20: (be(F.col("b"), 4), 4), 24: (be(F.col("vs"), 8), 8), 36: (be(7, 4), 4), 40: (be(1024, 8), 8), 56: (be(1, 4), 4), 60: (be(F.col("sn"), 4), 4), 64: (be(4096, 8), 8), 96: (be(4, 4), 4), 100: (be(104, 4), 4)})
    sources = o.select("source_id", F.when(F.col("v") == 1, one).otherwise(many).alias("head"), F.lit(1 << 30).alias("size"))
    return headers.decode_header(sources, headers.QCOW).select("source_id", "version", "cluster_bits", F.col("virtual_size").cast("long").alias("virtual_size"), "snapshots", "ok")


@query("""
WITH o AS (SELECT o_orderkey AS source_id, o_custkey % 4 AS version FROM orders),
r(check_name) AS (VALUES ('image.qcow.magic'), ('image.qcow.version'), ('image.qcow.header_size'), ('image.qcow.cluster_bits'), ('image.qcow.encryption'), ('image.qcow.compression'), ('image.qcow.refcount_order'),
  ('image.qcow.l1_entries'), ('image.qcow.virtual_size'), ('image.qcow.l1_range'), ('image.qcow.backing'), ('image.qcow.refcounts'), ('image.qcow.snapshots'))
SELECT source_id, check_name, CASE check_name WHEN 'image.qcow.version' THEN version = 2 WHEN 'image.qcow.refcounts' THEN source_id % 2 = 0
  WHEN 'image.qcow.backing' THEN source_id % 5 <> 0 WHEN 'image.qcow.header_size' THEN version = 2 ELSE true END AS ok FROM o, r WHERE version IN (2)
""")
def q_header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each rule: some tables are not aligned and some names overlap the header."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 4 = 2").select(F.col("o_orderkey").alias("source_id"))
    at = F.when(F.col("source_id") % 2 == 0, F.lit(1 << 16)).otherwise(F.lit((1 << 16) + 8))
    backing = F.when(F.col("source_id") % 5 == 0, F.lit(16)).otherwise(F.lit(2048))
    head = blob(104, {0: (b"QFI\xfb", 4), 4: (be(2, 4), 4), 8: (be(backing, 8), 8), 16: (be(9, 4), 4), 20: (be(16, 4), 4), 24: (be(1 << 20, 8), 8), 36: (be(1, 4), 4), 40: (be(1024, 8), 8), 48: (be(at, 8), 8), 56: (be(1, 4), 4)})
    return headers.header_checks(o.select("source_id", head.alias("head"), F.lit(1 << 30).alias("size")), headers.QCOW)


@query("""
SELECT p_partkey AS source_id, CASE p_size % 4 WHEN 2 THEN 'Fixed' WHEN 3 THEN 'Dynamic' END AS disk_type, CAST(p_partkey * 512 AS BIGINT) AS current_size, p_size AS heads, p_size % 4 IN (2, 3) AND p_partkey % 7 <> 0 AS ok FROM part
""")
def q_header_vhd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum is the inverted sum of the other bytes, which is taken here from the numbers that go in."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("source_id"), F.col("p_size").cast("long").alias("s"))
    bytes_of = lambda c, n: sum((F.shiftright(c, 8 * i).bitwiseAND(F.lit(255)) for i in range(1, n)), c.bitwiseAND(F.lit(255)))
    size, kind = F.col("source_id").cast("long") * 512, F.col("s") % 4
    total = sum(b"conectix") + 1 + bytes_of(size, 8) + F.col("s") + kind
    crc = F.lit(0xFFFFFFFF) - total - F.when(F.col("source_id") % 7 == 0, 1).otherwise(0)
    tail = blob(512, {0: (b"conectix", 8), 12: (be(0x10000, 4), 4), 48: (be(size, 8), 8), 58: (be(F.col("s"), 1), 1), 60: (be(kind, 4), 4), 64: (be(crc, 4), 4)})
    found = headers.decode_header(p.select("source_id", tail.alias("tail")), headers.VHD_FOOTER, headers.last_bytes("tail", 512))
    return found.select("source_id", "disk_type", F.col("current_size").cast("long").alias("current_size"), F.col("heads").cast("int").alias("heads"), "ok")


@query("""
SELECT p_partkey AS source_id, p_name AS parent_name, CAST(p_partkey % 5 * 2097152 AS BIGINT) AS block_size, CAST(p_partkey % 5 * 512 AS BIGINT) AS bitmap_size, p_partkey % 5 > 0 AS sized FROM part
""")
def q_header_vhd_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("source_id"), "p_name", (F.col("p_partkey") % 5 * (1 << 21)).alias("b"))
    head = blob(1024, {0: (b"cxsparse", 8), 24: (be(0x10000, 4), 4), 28: (be(10, 4), 4), 32: (be(F.col("b"), 4), 4), 64: (padded(F.encode("p_name", "UTF-16BE"), 512), 512)})
    found = headers.decode_header(p.select("source_id", head.alias("head")), headers.VHD_DYNAMIC)
    return found.select("source_id", "parent_name", "block_size", "bitmap_size", (~F.array_contains("failed", "block_size")).alias("sized"))


@query("""
WITH h AS (SELECT p_partkey AS source_id, i AS copy, p_size % 3 + i AS sequence, (p_partkey + i) % 4 > 0 AS ok FROM part, (VALUES (0), (1)) c(i))
SELECT source_id, arg_max(copy, sequence * 2 - copy) AS copy, max(sequence) AS sequence FROM h WHERE ok GROUP BY source_id
""")
def q_header_vhdx_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of a header, some with a wrong log length: the valid one with the larger sequence, the first on a tie."""
    o = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("source_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "p_size")
    length = F.when((F.col("source_id") + F.col("copy")) % 4 > 0, F.lit(1 << 20)).otherwise(F.lit(5))
    head = blob(4096, {0: (b"head", 4), 8: (le(F.col("p_size") % 3 + F.col("copy"), 8), 8), 66: (le(1, 2), 2), 68: (le(length, 4), 4), 72: (le(1 << 20, 8), 8)})
    summed = o.select("source_id", "copy", head.alias("plain")).withColumn("crc", checksums.crc32c("plain"))
    stored = F.concat(F.substring("plain", 1, 4), le(F.col("crc"), 4), F.expr("substring(plain, 9)"))
    found = headers.decode_header(summed.select("source_id", "copy", stored.alias("head")), headers.VHDX_HEADER, keys=("source_id", "copy")).filter("ok")
    best = versions.best_copy(found, ["source_id"], [F.col("sequence"), -F.col("copy")], ["copy", "sequence"])
    return best.select("source_id", "copy", F.col("sequence").cast("long").alias("sequence"))


_VMDK = "SELECT p_partkey AS source_id, CAST(p_partkey * 128 AS BIGINT) AS capacity_sectors, CAST(p_size AS BIGINT) AS grain_sectors, p_size IN (8, 16, 32) AND p_partkey % 6 <> 0 AS ok FROM part"


def _vmdk(p: Column | str, directory: Column | int, flags: int = 1) -> Column:
    del p
    return blob(512, {0: (b"KDMV", 4), 4: (le(1, 4), 4), 8: (le(flags, 4), 4), 12: (le(F.col("p_partkey") * 128, 8), 8), 20: (le(_long("p_size"), 8), 8), 44: (le(512, 4), 4), 56: (directory if isinstance(directory, Column) else le(directory, 8), 8), 73: (b"\n \r\n", 4)})


@query(_VMDK)
def q_header_vmdk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    head = _vmdk("", le(F.when(F.col("p_partkey") % 6 == 0, 0).otherwise(21), 8))
    found = headers.decode_header(p.select(F.col("p_partkey").alias("source_id"), head.alias("head")), headers.VMDK_SPARSE)
    return found.select("source_id", F.col("capacity_sectors").cast("long").alias("capacity_sectors"), F.col("grain_sectors").cast("long").alias("grain_sectors"), "ok")


@query("""
SELECT p_partkey AS source_id, CASE WHEN p_partkey % 3 = 0 THEN 77 ELSE 21 END AS primary_directory, p_partkey % 3 = 0 AS from_footer, p_size IN (8, 16, 32) AS ok FROM part WHERE p_size IN (8, 16, 32) OR p_partkey % 3 <> 0
""")
def q_footer_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory at the end is named by the footer, which agrees with the header here."""
    p = table(spark, sf_dir, "part")
    head = _vmdk("", F.when(F.col("p_partkey") % 3 == 0, F.lit(b"\xff" * 8)).otherwise(le(21, 8)))
    header = headers.decode_header(p.select(F.col("p_partkey").alias("source_id"), head.alias("head")), headers.VMDK_SPARSE)
    footer = headers.decode_header(p.select(F.col("p_partkey").alias("source_id"), _vmdk("", 77).alias("head")), headers.VMDK_SPARSE)
    found = headers.footer_override(header, footer).select("source_id", F.col("primary_directory").cast("int").alias("primary_directory"), "from_footer", "ok")
    return found.filter("primary_directory IS NOT NULL")


@query("SELECT s_suppkey AS source_id, s_name AS parent_path, CAST(s_nationkey AS BIGINT) AS generation, s_suppkey % 2 = 1 AS is_dirty, s_suppkey % 4 < 2 AS ok FROM supplier")
def q_header_cowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    head = blob(2048, {0: (b"COWD", 4), 4: (le(1, 4), 4), 8: (le(3, 4), 4), 12: (le(100, 4), 4), 16: (le(F.when(F.col("s_suppkey") % 4 < 2, 1).otherwise(3), 4), 4), 20: (le(4, 4), 4), 24: (le(1, 4), 4),
                        32: (padded(F.col("s_name"), 1024), 1024), 1060: (le(F.col("s_nationkey"), 4), 4), 1648: (le(F.col("s_suppkey") % 2, 4), 4)})
    return headers.decode_header(s.select(F.col("s_suppkey").alias("source_id"), head.alias("head")), headers.VMDK_COWD).select("source_id", "parent_path", "generation", "is_dirty", "ok")


@query("""
SELECT o_orderkey AS source_id, CAST(o_orderkey % 1000 AS BIGINT) AS plist_offset, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 9 > 0 THEN o_orderkey % 9 END AS data_crc32, o_orderkey % 1000 + 500 <= 1200 - 512 AS ok FROM orders
""")
def q_header_udif(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_custkey") % 2 == 0, 2).otherwise(1)
    tail = blob(512, {0: (b"koly", 4), 4: (be(4, 4), 4), 8: (be(512, 4), 4), 32: (be(100, 8), 8), 80: (be(kind, 4), 4), 88: (be(F.col("o_orderkey") % 9, 4), 4), 216: (be(F.col("o_orderkey") % 1000, 8), 8), 224: (be(500, 8), 8)})
    found = headers.decode_header(o.select(F.col("o_orderkey").alias("source_id"), tail.alias("tail"), F.lit(1200).alias("size")), headers.UDIF_TRAILER, headers.last_bytes("tail", 512))
    return found.select("source_id", F.col("plist_offset").cast("long").alias("plist_offset"), "data_crc32", "ok")


@query("""
WITH s AS (SELECT s_suppkey AS source_id, 1 + s_suppkey % 3 AS one, 1 + s_suppkey % 2 AS two FROM supplier),
b AS (SELECT source_id, one - 1 AS band, 4096 AS file_offset, one = two AS twice FROM s UNION ALL SELECT source_id, two - 1, 4096 + 2 * 1024, one = two FROM s)
SELECT source_id, band, file_offset, NOT twice AS "unique", band < 3 AS in_range, file_offset + 1024 <= 7000 AS in_source FROM b
""")
def q_band_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands of two sectors, the middle one sparse: guest numbers may occur twice or lie past the end."""
    s = table(spark, sf_dir, "supplier")
    head = blob(4096, {0: (b"sprs", 4), 4: (be(3, 4), 4), 8: (be(2, 4), 4), 16: (be(6, 4), 4), 64: (be(F.col("s_suppkey") % 3 + 1, 4), 4), 72: (be(F.col("s_suppkey") % 2 + 1, 4), 4)})
    return headers.band_map(s.select(F.col("s_suppkey").alias("source_id"), head.alias("head"), F.lit(7000).alias("size")))


@query("""
WITH s AS (SELECT s_suppkey AS source_id, CAST(100 + s_suppkey AS BIGINT) AS first FROM supplier)
SELECT source_id, 0 AS ordinal, 'zlib' AS kind, first * 512 AS logical_offset, CAST(4096 AS BIGINT) AS length, CAST(1010 AS BIGINT) AS physical_offset, CAST(77 AS BIGINT) AS stored_length FROM s
UNION ALL SELECT source_id, 1, 'zero', (first + 8) * 512, 1024, NULL, NULL FROM s UNION ALL SELECT source_id, 3, CASE source_id % 2 WHEN 0 THEN 'bzip2' ELSE 'zlib' END, (first + 10) * 512, 512, 1087, 5 FROM s
""")
def q_udif_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of four blocks and its end; the third is a comment."""
    s = table(spark, sf_dir, "supplier")
    entry = lambda kind, sector, count, at, size: F.concat(be(kind, 4), F.lit(bytes(4)), be(sector, 8), be(count, 8), be(at, 8), be(size, 8))
    last = F.when(F.col("s_suppkey") % 2 == 0, F.lit(0x80000006)).otherwise(F.lit(0x80000005))
    rows = F.concat(entry(0x80000005, 0, 8, 10, 77), entry(2, 8, 2, 0, 0), entry(0x7FFFFFFE, 10, 0, 0, 0), entry(last, 10, 1, 87, 5), entry(0xFFFFFFFF, 11, 0, 0, 0))
    data = blob(204 + 200, {0: (b"mish", 4), 4: (be(1, 4), 4), 8: (be(F.col("s_suppkey") + 100, 8), 8), 24: (be(1000, 8), 8), 200: (be(5, 4), 4), 204: (rows, 200)})
    found = headers.udif_blocks(s.select(F.col("s_suppkey").alias("source_id"), data.alias("block_map")))
    return found.select("source_id", F.col("ordinal").cast("int").alias("ordinal"), "kind", *(F.col(c).cast("long").alias(c) for c in ("logical_offset", "length", "physical_offset", "stored_length")))


@query("SELECT s_suppkey AS source_id, 10 AS block_count, CAST(2 + s_suppkey % 20 AS BIGINT) AS block_sectors, 10 * (2 + s_suppkey % 20) >= 100 AS ok FROM supplier")
def q_header_pdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    head = blob(64, {28: (le(F.col("s_suppkey") % 20 + 2, 4), 4), 32: (le(10, 4), 4), 36: (le(100, 8), 8), 48: (le(1, 4), 4)})
    found = headers.decode_header(s.select(F.col("s_suppkey").alias("source_id"), head.alias("head"), F.lit(100_000).alias("size"), F.lit(100).alias("extent_sectors")), headers.PDI_SPARSE)
    return found.select("source_id", F.col("block_count").cast("int").alias("block_count"), "block_sectors", "ok")


@query("""
SELECT s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'EVF' WHEN 1 THEN 'LVF' END AS signature, s_suppkey % 5000 AS segment_number, s_suppkey % 3 < 2 AS ok FROM supplier
""")
def q_header_ewf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    magic = F.when(F.col("s_suppkey") % 3 == 0, F.lit(b"EVF\t\r\n\xff\0")).when(F.col("s_suppkey") % 3 == 1, F.lit(b"LVF\t\r\n\xff\0")).otherwise(F.lit(b"XVF\t\r\n\xff\0"))
    head = blob(13, {0: (magic, 8), 8: (le(1, 1), 1), 9: (le(F.col("s_suppkey") % 5000, 2), 2)})
    return headers.decode_header(s.select(F.col("s_suppkey").alias("source_id"), head.alias("head")), headers.EWF_FILE).select("source_id", "signature", "segment_number", "ok")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'table' WHEN 2 THEN 'sectors' ELSE 'other' END AS type,
  CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey END AS stored, l_suppkey AS following, 50 AS here FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, type, type <> 'other' AS known, CAST(CASE WHEN stored > 0 THEN stored WHEN type = 'done' THEN 76 WHEN following > here THEN following - here END AS BIGINT) AS size FROM l
""")
def q_ewf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("done", "table", "sectors", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    head = blob(76, {0: (padded(kind, 16), 16), 16: (le(F.col("l_suppkey"), 8), 8), 24: (le(F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_partkey")), 8), 8)})
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    found = headers.decode_header(lines.select(*keys, head.alias("head"), F.lit(50).cast("long").alias("file_offset")), headers.EWF_SECTION, keys=keys)
    return found.select(*keys, "type", "known", F.col("size").cast("long").alias("size"))


@query("""
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS idx FROM lineitem),
e AS (SELECT l_orderkey, idx, CASE WHEN idx < 3 THEN 2147480000 + idx * 1000 + (idx % 2) * 2147483648 ELSE 2147483648 + idx * 1000 END AS raw FROM l)
SELECT l_orderkey, idx, CASE WHEN idx < 3 THEN 2147480000 + idx * 1000 ELSE raw END AS "offset", idx < 3 AND idx % 2 = 1 AS compressed, true AS ok FROM e
""")
def q_chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the fourth chunk on, offsets need 32 bits."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).cast("long").alias("idx"))
    raw = F.when(F.col("idx") < 3, F.lit(2147480000) + F.col("idx") * 1000 + F.col("idx") % 2 * (1 << 31)).otherwise(F.lit(1 << 31) + F.col("idx") * 1000)
    return headers.chunk_offsets(lines.withColumn("raw", raw), "l_orderkey", "idx", "raw").select("l_orderkey", "idx", "offset", "compressed", "ok")


@query("""
SELECT s_suppkey AS source_id, s_name AS pv_id, CAST(s_suppkey % 4 * 512 AS BIGINT) AS pv_offset, s_suppkey % 5 > 0 AS ok FROM supplier
""")
def q_header_lvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in sector 1 of volumes that begin later; the checksum starts from a value of its own; some are wrong."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name")
    plain = blob(512, {0: (b"LABELONE", 8), 8: (le(1, 8), 8), 24: (b"LVM2 001", 8), 32: (padded(F.col("s_name"), 32), 32)})
    summed = s.select("source_id", plain.alias("plain"), ((F.col("source_id") % 4 + 1) * 512).alias("label_offset")).withColumn("crc", checksums.weak_crc32(headers.LVM_CHECKSUM_START)(F.expr("substring(plain, 21)")))
    stored = F.concat(F.substring("plain", 1, 16), le(F.col("crc").bitwiseXOR(F.when(F.col("source_id") % 5 > 0, 0).otherwise(1)), 4), F.expr("substring(plain, 21)"))
    found = headers.decode_header(summed.select("source_id", "label_offset", stored.alias("head")), headers.LVM_LABEL)
    return found.select("source_id", "pv_id", F.col("pv_offset").cast("long").alias("pv_offset"), "ok")


@query("""
WITH s AS (SELECT s_suppkey AS source_id, s_suppkey * 512 AS base, s_nationkey AS n FROM supplier)
SELECT source_id, 'data' AS kind, 0 AS ordinal, CAST(base + 1048576 AS BIGINT) AS "offset", CAST(n AS BIGINT) AS size FROM s WHERE n > 0
UNION ALL SELECT source_id, 'metadata', 0, base + 4096, 1000 FROM s UNION ALL SELECT source_id, 'metadata', 1, base + 9000, 1000 FROM s
""")
def q_lvm_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_nationkey > 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("n"))
    none = table(spark, sf_dir, "supplier").filter("s_nationkey = 0").select(F.col("s_suppkey").alias("source_id"))
    tail = lambda at: {at: (le(4096, 8), 8), at + 8: (le(1000, 8), 8), at + 16: (le(9000, 8), 8), at + 24: (le(1000, 8), 8)}
    full = s.select("source_id", (F.col("source_id") * 512).alias("pv_offset"), blob(512, {72: (le(1 << 20, 8), 8), 80: (le(F.col("n"), 8), 8), **tail(104)}).alias("label"))
    empty = none.select("source_id", (F.col("source_id") * 512).alias("pv_offset"), blob(512, tail(88)).alias("label"))
    return headers.lvm_areas(full.union(empty)).select("source_id", "kind", "ordinal", F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))


@query("""
SELECT p_partkey AS source_id, CASE p_partkey % 3 WHEN 0 THEN 'Fixed' WHEN 1 THEN 'ToGo' END AS flavor, CASE p_partkey % 3 WHEN 1 THEN 84 ELSE CASE WHEN p_size % 2 = 0 THEN 7 ELSE 6 END END AS version,
  CAST(CASE WHEN p_partkey % 3 = 1 THEN 111 WHEN p_size % 2 = 0 THEN p_partkey + 1 ELSE p_size * 4096 END AS BIGINT) AS first_offset FROM part WHERE p_partkey % 3 < 2
""")
def q_header_bitlocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_partkey % 3 < 2")
    oem = F.when(F.col("p_partkey") % 3 == 0, F.lit(b"-FVE-FS-")).otherwise(F.lit(b"MSWIN4.1"))
    head = blob(512, {3: (oem, 8), 11: (le(512, 2), 2), 13: (le(8, 1), 1), 32: (le(1000, 4), 4), 56: (le(F.col("p_size"), 8), 8), 176: (le(F.when(F.col("p_size") % 2 == 0, F.col("p_partkey") + 1).otherwise(0), 8), 8), 440: (le(111, 8), 8), 510: (b"\x55\xaa", 2)})
    found = headers.decode_header(p.select(F.col("p_partkey").alias("source_id"), head.alias("head")), headers.BITLOCKER).filter("ok")
    return found.select("source_id", "flavor", "version", F.col("metadata_offsets")[0].cast("long").alias("first_offset"))


@query("""
SELECT p_partkey AS source_id, CASE p_partkey % 3 WHEN 0 THEN 'ext4' WHEN 1 THEN 'ext3' ELSE 'ext2' END AS variant, CAST(1024 << CAST(p_partkey % 4 AS INTEGER) AS BIGINT) AS block_size,
  CAST(p_partkey AS BIGINT) AS blocks, CAST(ceil(p_partkey / 100.0) AS BIGINT) AS groups, p_size >= 10 AND p_partkey > 0 AS ok FROM part
""")
def q_header_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    head = blob(1024, {4: (le(F.col("p_partkey"), 4), 4), 24: (le(F.col("p_partkey") % 4, 4), 4), 32: (le(100, 4), 4), 40: (le(50, 4), 4), 56: (b"\x53\xef", 2), 88: (le(F.when(F.col("p_size") >= 10, 256).otherwise(64), 2), 2),
                        92: (le(F.when(k < 2, 4).otherwise(0), 4), 4), 96: (le(F.when(k == 0, 64).otherwise(0), 4), 4)})
    found = headers.decode_header(p.select(F.col("p_partkey").alias("source_id"), head.alias("head")), headers.EXT)
    return found.select("source_id", "variant", "block_size", "blocks", "groups", "ok")


@query("""
SELECT p_partkey AS source_id, CAST(4096 AS BIGINT) AS cluster_size, CAST(p_partkey * 512 AS BIGINT) AS total_size, CAST(CASE WHEN p_size < 20 THEN p_size * 4096 ELSE 1024 END AS BIGINT) AS record_size, p_partkey % 4 > 0 AS ok FROM part
""")
def q_header_ntfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    record = F.when(F.col("p_size") < 20, F.col("p_size")).otherwise(246)
    head = blob(512, {0: (b"\xeb\x52\x90NTFS    ", 11), 11: (le(512, 2), 2), 13: (le(8, 1), 1), 14: (le(F.when(F.col("p_partkey") % 4 > 0, 0).otherwise(1), 2), 2), 40: (le(F.col("p_partkey"), 8), 8), 48: (le(4, 8), 8), 56: (le(2, 8), 8), 64: (le(record, 1), 1), 68: (le(1, 1), 1), 510: (b"\x55\xaa", 2)})
    found = headers.decode_header(p.select(F.col("p_partkey").alias("source_id"), head.alias("head")), headers.NTFS)
    return found.select("source_id", "cluster_size", F.col("total_size").cast("long").alias("total_size"), "record_size", "ok")


@query("""
SELECT p_partkey AS source_id, CAST(p_size AS BIGINT) AS group_blocks, CAST(4096 << CAST(p_partkey % 3 AS INTEGER) AS BIGINT) AS directory_block, p_size >= 5 AND p_partkey % 5 > 0 AS ok FROM part
""")
def q_header_xfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    head = blob(512, {0: (b"XFSB", 4), 4: (be(4096, 4), 4), 84: (be(F.col("p_size"), 4), 4), 88: (be(4, 4), 4), 100: (be(5, 2), 2), 102: (be(512, 2), 2), 104: (be(512, 2), 2), 106: (be(F.when(F.col("p_partkey") % 5 > 0, 8).otherwise(9), 2), 2), 123: (be(3, 1), 1), 124: (be(10, 1), 1), 192: (be(F.col("p_partkey") % 3, 1), 1)})
    found = headers.decode_header(p.select(F.col("p_partkey").alias("source_id"), head.alias("head")), headers.XFS)
    return found.select("source_id", "group_blocks", "directory_block", "ok")


_GUID = "00000000-0000-0000-0000-0000000000{:02x}"


@query(f"""
SELECT s_suppkey AS source_id, 0 AS "index", '{_GUID.format(1)}' AS type_guid, CAST(1048576 * (s_suppkey % 3) AS BIGINT) AS file_offset, s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 AS ok FROM supplier
UNION ALL SELECT s_suppkey, 1, CASE WHEN s_suppkey % 4 = 0 THEN '{_GUID.format(1)}' ELSE '{_GUID.format(2)}' END, 2097152, s_suppkey % 4 > 0 FROM supplier
""")
def q_region_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some types occur twice and some offsets lie in the header."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    data = blob(1024, {0: (b"regi", 4), 8: (le(2, 4), 4), 16: (bytes(15) + b"\x01", 16), 32: (le(k % 3 * (1 << 20), 8), 8), 40: (le(1 << 20, 4), 4), 44: (le(1, 4), 4), 48: (F.when(k % 4 == 0, F.lit(bytes(15) + b"\x01")).otherwise(F.lit(bytes(15) + b"\x02")), 16), 64: (le(1 << 21, 8), 8), 72: (le(1 << 20, 4), 4)})
    return headers.region_entries(s.select(k.alias("source_id"), data.alias("region_table"))).select("source_id", F.col("index").cast("int").alias("index"), "type_guid", F.col("file_offset").cast("long").alias("file_offset"), "ok")


@query(f"""
SELECT s_suppkey AS source_id, '{_GUID.format(5)}' AS item_guid, true AS is_required, s_name AS value, true AS ok FROM supplier
UNION ALL SELECT s_suppkey, '{_GUID.format(6)}', false, '', false FROM supplier
""")
def q_metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item behind the table and one that would lie inside it."""
    s = table(spark, sf_dir, "supplier")
    data = blob(65_536 + 100, {0: (b"metadata", 8), 10: (le(2, 2), 2), 32: (bytes(15) + b"\x05", 16), 48: (le(65_536, 4), 4), 52: (le(F.length("s_name"), 4), 4), 56: (le(4, 4), 4), 64: (bytes(15) + b"\x06", 16), 80: (le(100, 4), 4), 84: (le(4, 4), 4), 65_536: (padded(F.col("s_name"), 100), 100)})
    found = headers.metadata_items(s.select(F.col("s_suppkey").alias("source_id"), data.alias("metadata")))
    return found.select("source_id", "item_guid", "is_required", F.when(F.col("ok"), F.decode("value", "UTF-8")).otherwise("").alias("value"), "ok")


@query("SELECT s_suppkey AS source_id, s_name AS relative_path, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'C:\\disk' END AS first_candidate, 1 + s_suppkey % 2 AS n FROM supplier")
def q_parent_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values in UTF-16; paths are tried in a fixed order, whatever order they are stored in."""
    s = table(spark, sf_dir, "supplier")
    utf = lambda x: x.encode("utf-16-le")
    key1, key2, path = utf("relative_path"), utf("absolute_win32_path"), utf("C:\\disk")
    odd = F.col("s_suppkey") % 2
    name = F.encode("s_name", "UTF-16LE")
    data = blob(600, {18: (le(odd + 1, 2), 2), 20: (le(100, 4), 4), 24: (le(200, 4), 4), 28: (le(F.when(odd == 1, len(key2)).otherwise(len(key1)), 2), 2), 30: (le(F.when(odd == 1, len(path)).otherwise(F.length(name)), 2), 2),
                       32: (le(300, 4), 4), 36: (le(400, 4), 4), 40: (le(len(utf("volume_path")), 2), 2), 42: (le(F.length(name), 2), 2),
                       100: (F.when(odd == 1, padded(F.lit(key2), 100)).otherwise(padded(F.lit(key1), 100)), 100), 200: (F.when(odd == 1, padded(F.lit(path), 100)).otherwise(padded(name, 100)), 100), 300: (utf("volume_path"), len(utf("volume_path"))), 400: (padded(name, 100), 100)})
    found = headers.parent_locator(s.select(F.col("s_suppkey").alias("source_id"), data.alias("locator"), "s_name"))
    joined = found.select("source_id", F.coalesce(F.try_element_at("entries", F.lit("relative_path")), F.try_element_at("entries", F.lit("volume_path"))).alias("relative_path"), F.col("candidates")[0].alias("first_candidate"), F.size("candidates").cast("long").alias("n"))
    return joined


@query("""
SELECT s_suppkey AS source_id, 0 AS ordinal, CAST(3799591626 AS BIGINT) AS type, 'raw' AS value FROM supplier
UNION ALL SELECT s_suppkey, 1, 1145132097, s_name FROM supplier
""")
def q_qcow_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    data = F.concat(F.lit(bytes(104)), be(3799591626, 4), be(3, 4), F.lit(b"raw" + bytes(5)), be(1145132097, 4), be(F.length("s_name"), 4), padded(F.col("s_name"), 24), F.lit(bytes(16)))
    found = headers.qcow_extensions(s.select(F.col("s_suppkey").alias("source_id"), data.alias("head"), F.lit(104).alias("header_size")))
    return found.select("source_id", "ordinal", "type", F.decode("value", "UTF-8").alias("value"))


@query("""
SELECT s_suppkey AS source_id, 0 AS ordinal, '1' AS snapshot_id, s_name AS name, CAST(s_suppkey * 8 AS BIGINT) AS l1_offset, CAST(5000 AS BIGINT) AS disk_size FROM supplier
UNION ALL SELECT s_suppkey, 1, '22', 'second', 64, 777 FROM supplier
""")
def q_qcow_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of varying length; the first has no size of its own."""
    s = table(spark, sf_dir, "supplier")
    one = F.concat(be(F.col("s_suppkey") * 8, 8), be(1, 4), be(1, 2), be(F.length("s_name"), 2), F.lit(bytes(20)), be(0, 4), F.lit(b"1"), F.col("s_name").cast("binary"))
    first = F.concat(one, F.substring(F.lit(bytes(8)), 1, ((8 - F.length(one) % 8) % 8).cast("int")))
    second = F.concat(be(64, 8), be(1, 4), be(2, 2), be(6, 2), F.lit(bytes(20)), be(16, 4), F.lit(bytes(8)), be(777, 8), F.lit(b"22second"))
    rows = s.select(F.col("s_suppkey").alias("source_id"), F.concat(first, second).alias("snapshot_table"), F.lit(2).alias("snapshots"), F.lit(5000).alias("virtual_size"))
    return headers.qcow_snapshots(rows).select("source_id", "ordinal", "snapshot_id", "name", "l1_offset", "disk_size")


@query("""
SELECT o_orderkey AS node_id, CASE o_orderkey % 3 WHEN 0 THEN 'MountPoint' WHEN 1 THEN 'SymbolicLink' ELSE 'Other' END AS kind,
  CASE WHEN o_orderkey % 3 < 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'clerk' || o_custkey ELSE 'C:\\x' END END AS target, true AS ok FROM orders
""")
def q_reparse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The print name if there is one, else the substitute name without its prefix."""
    o = table(spark, sf_dir, "orders")
    substitute = "\\??\\C:\\x".encode("utf-16-le")
    k = F.col("o_orderkey") % 3
    printed = F.when(F.col("o_custkey") % 2 == 0, F.encode(F.concat(F.lit("clerk"), F.col("o_custkey").cast("string")), "UTF-16LE")).otherwise(F.lit(b""))
    names = F.concat(le(0, 2), le(len(substitute), 2), le(len(substitute), 2), le(F.length(printed), 2), F.when(k == 1, F.lit(bytes(4))).otherwise(F.lit(b"")), F.lit(substitute), printed)
    tag = F.when(k == 0, headers.REPARSE_MOUNT).when(k == 1, headers.REPARSE_SYMLINK).otherwise(5)
    data = F.concat(le(tag, 4), le(F.length(names), 2), F.lit(bytes(2)), names)
    return headers.reparse_points(o.select(F.col("o_orderkey").alias("node_id"), data.alias("reparse"))).select("node_id", "kind", "target", "ok")


@query("""
SELECT c_custkey, p IS NOT NULL AS found, p = c_custkey AS is_self, p IS NOT NULL AND p <> c_custkey AND 'id' || p = 'id' || (c_custkey - c_custkey % 2 - 1) AS ok
FROM (SELECT c.c_custkey, p.c_custkey AS p FROM customer c LEFT JOIN customer p ON p.c_custkey = CASE WHEN c.c_custkey % 7 = 0 THEN c.c_custkey ELSE c.c_custkey - 1 END WHERE c.c_custkey > 2)
""")
def q_parent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own = F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") - 1)
    images = c.select("c_custkey", F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("content"), F.concat(F.lit("id"), (F.col("c_custkey") - F.col("c_custkey") % 2 - 1).cast("string")).alias("expected"), F.when(F.col("c_custkey") > 2, own).alias("parent"))
    return headers.parent_checks(images, "c_custkey", "content", "expected", "parent")


# --- partition tables ----------------------------------------------------------------------------------------------


def _mbr_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disk of 200 sectors for each supplier: an Ext partition with its magic, an extended one with a chain of two tables, and
    for some a loop in the chain."""
    s = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("n")), "source_id")
    entry = lambda kind, first, count: F.concat(F.lit(bytes(4)), le(kind, 1), F.lit(bytes(3)), le(first, 4), le(count, 4))
    link = F.when(F.col("source_id") % 5 == 0, 0).otherwise(40)
    record = lambda *entries: blob(512, {446 + 16 * i: (e, 16) for i, e in enumerate(entries)} | {510: (b"\x55\xaa", 2)})
    disk = blob(200 * 512, {0: (record(entry(0x83, 4, 10 + F.col("n")), entry(5, 60, 130)), 512), 4 * 512 + 1024 + 56: (b"\x53\xef", 2), 60 * 512: (record(entry(7, 1, 20), entry(5, link, 60)), 512), 100 * 512: (record(entry(0x83, 2, 20)), 512)})
    return stored(s.select("source_id", disk.alias("bytes")).withColumn("size", F.length("bytes").cast("long")))


_MBR = """
WITH s AS (SELECT s_suppkey AS source_id, s_nationkey AS n FROM supplier WHERE s_suppkey % 5 <> 0),
v AS (SELECT source_id, 0 AS "index", 4 * 512 AS byte_offset, (10 + n) * 512 AS byte_size, 'Primary' AS role, '83' AS type_code FROM s UNION ALL SELECT source_id, 1, 60 * 512, 130 * 512, 'Extended', '05' FROM s
  UNION ALL SELECT source_id, 2, 61 * 512, 20 * 512, 'Logical', '07' FROM s UNION ALL SELECT source_id, 3, 102 * 512, 20 * 512, 'Logical', '83' FROM s)
"""


@query(_MBR + 'SELECT source_id, "index", CAST(byte_offset AS BIGINT) AS byte_offset, CAST(byte_size AS BIGINT) AS byte_size, role, type_code FROM v')
def q_mbr_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector size is found out; disks whose chain loops have no layout."""
    found = partitions.mbr_volumes(partitions.mbr_layout(partitions.mbr_candidates(_mbr_disks(spark, sf_dir))))
    return found.select("source_id", "index", "byte_offset", "byte_size", "role", "type_code")


@query(_MBR + """
SELECT source_id, CAST("index" AS BIGINT) AS view_id, CASE WHEN role IN ('Primary', 'Logical') THEN 'Volume' ELSE 'Partition' END AS kind, lower(role) AS role_tag FROM v
""")
def q_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = partitions.views(partitions.mbr_volumes(partitions.mbr_layout(partitions.mbr_candidates(_mbr_disks(spark, sf_dir)))))
    return found.select("source_id", "view_id", "kind", F.col("tags")["role"].alias("role_tag"))


@query(_MBR + "SELECT source_id, CAST(2 AS BIGINT) AS view_id, CAST(byte_offset AS BIGINT) AS \"offset\", CAST(byte_size AS BIGINT) AS length, CAST(byte_size AS BIGINT) AS n_read, true AS complete FROM v WHERE \"index\" = 2")
def q_open_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first logical volume of each disk, opened and read."""
    disks = _mbr_disks(spark, sf_dir)
    rows = partitions.views(partitions.mbr_volumes(partitions.mbr_layout(partitions.mbr_candidates(disks))))
    opened = partitions.open_view(partitions.selected(rows, "tag", "logical", "role"))
    return blobs.slices(disks, opened).drop("bytes")


def _gpt_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disk of 40 blocks for each supplier, blocks of 512 or 1,024 bytes: two partitions; some primary headers are damaged, some
    backups name another disk."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name")
    kind = b"\xaf\x3d\xc6\x0f\x83\x84\x72\x47\x8e\x79\x3d\x69\xd8\x47\x7d\xe4"
    part = lambda i, first, last, name: F.concat(F.lit(kind), F.lit(bytes(15) + bytes([i])), le(first, 8), le(last, 8), F.lit(bytes(8)), padded(F.encode(name, "UTF-16LE"), 72))
    rows = s.select("source_id", F.concat(part(1, 6, 9, F.col("s_name")), part(2, 10, F.col("source_id") % 20 + 12, F.lit("two")), F.lit(bytes(256))).alias("rows"))

    def header(current: int, backup: int, at: int, disk: Column) -> Column:
        front = F.concat(F.lit(b"EFI PART"), le(0x10000, 4), le(92, 4))
        back = F.concat(F.lit(bytes(4)), le(current, 8), le(backup, 8), le(6, 8), le(35, 8), F.lit(bytes(15)), le(disk, 1), le(at, 8), le(4, 4), le(128, 4), le(F.crc32("rows"), 4))
        return F.concat(front, le(F.crc32(F.concat(front, F.lit(bytes(4)), back)), 4), back)

    one = header(1, 39, 2, F.lit(7))
    broken = F.when(F.col("source_id") % 3 == 0, F.concat(F.substring(one, 1, 60), F.lit(b"\x99"), F.expr("substring(_one, 62)"))).otherwise(F.col("_one"))
    both = rows.withColumn("_one", one).withColumn("first", broken).withColumn("second", header(39, 1, 37, F.when(F.col("source_id") % 7 == 0, 8).otherwise(7)))

    def disk(block: int) -> Column:
        return blob(40 * block, {446: (mbr_entry(0xEE, 1, 39), 16), 510: (b"\x55\xaa", 2), block: (F.col("first"), 92), 2 * block: (F.col("rows"), 512), 37 * block: (F.col("rows"), 512), 39 * block: (F.col("second"), 92)})

    return stored(stored(both).select("source_id", F.when(F.col("source_id") % 2 == 0, disk(512)).otherwise(disk(1024)).alias("bytes")).withColumn("size", F.length("bytes").cast("long")))


@query("""
WITH s AS (SELECT s_suppkey AS source_id, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 512 ELSE 1024 END AS block, CASE WHEN s_suppkey % 3 = 0 THEN 'Backup' ELSE 'Primary' END AS location FROM supplier)
SELECT source_id, block, location, 0 AS "index", CAST(6 * block AS BIGINT) AS byte_offset, CAST(4 * block AS BIGINT) AS byte_size, s_name AS name FROM s
UNION ALL SELECT source_id, block, location, 1, 10 * block, (source_id % 20 + 3) * block, 'two' FROM s
""")
def q_gpt_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block size is found out, and where the primary header is damaged the backup counts."""
    found = partitions.gpt_volumes(partitions.gpt_headers(_gpt_disks(spark, sf_dir)))
    return found.select("source_id", "block", "location", "index", "byte_offset", "byte_size", "name")


@query("""
WITH c(check_name) AS (VALUES ('current_is_backup'), ('backup_is_current'), ('header_size'), ('disk_guid'), ('usable_range'), ('entry_layout'), ('entries_crc'))
SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 512 ELSE 1024 END AS block, check_name, check_name <> 'disk_guid' OR s_suppkey % 7 <> 0 AS ok FROM supplier, c WHERE s_suppkey % 3 <> 0
""")
def q_gpt_pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.gpt_pair_checks(partitions.gpt_headers(_gpt_disks(spark, sf_dir)))


def _apm_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name")
    entry = lambda count, start, blocks, name, kind: blob(512, {0: (b"PM", 2), 4: (be(count, 4), 4), 8: (be(start, 4), 4), 12: (be(blocks, 4), 4), 16: (padded(name, 32), 32), 48: (padded(F.lit(kind), 32), 32)})
    second = F.when(F.col("source_id") % 4 == 0, 3).otherwise(2)
    disk = blob(64 * 512, {0: (b"ER", 2), 2: (be(512, 2), 2), 4: (be(64, 4), 4), 512: (entry(2, 1, 2, F.lit("map"), "Apple_partition_map"), 512), 1024: (entry(second, 3, F.col("source_id") % 80 + 1, F.col("s_name"), "Apple_HFS"), 512)})
    return stored(s.select("source_id", disk.alias("bytes")).withColumn("size", F.length("bytes").cast("long")))


@query("""
SELECT s_suppkey AS source_id, 0 AS "index", 'map' AS name, CAST(512 AS BIGINT) AS byte_offset, CAST(1024 AS BIGINT) AS byte_size, 'Metadata' AS role FROM supplier
UNION ALL SELECT s_suppkey, 1, s_name, 1536, (s_suppkey % 80 + 1) * 512, 'Primary' FROM supplier
""")
def q_apm_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.apm_entries(_apm_disks(spark, sf_dir)).select("source_id", F.col("index").cast("int").alias("index"), "name", "byte_offset", "byte_size", "role")


@query("""
SELECT s_suppkey AS source_id, true AS first_is_map, s_suppkey % 4 <> 0 AS counts_agree, true AS count_is_parsed, s_suppkey % 80 + 4 <= 64 AS in_device, s_suppkey % 80 + 4 <= 64 AS in_source,
  s_suppkey % 4 <> 0 AND s_suppkey % 80 + 4 <= 64 AS ok FROM supplier
""")
def q_apm_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.apm_checks(partitions.apm_entries(_apm_disks(spark, sf_dir)))


@query("""
WITH p AS (SELECT o_custkey AS disk, o_orderkey AS part, o_orderkey % 100 * 10 AS "start", o_orderkey % 100 * 10 + o_orderkey % 300 + 1 AS "end",
  CASE o_orderkey % 5 WHEN 0 THEN 'Extended' WHEN 1 THEN 'Protective' WHEN 2 THEN 'Primary' ELSE 'Logical' END AS role FROM orders)
SELECT x.disk, x.part AS a, y.part AS b FROM p x JOIN p y ON x.disk = y.disk AND x.part < y.part AND x."start" < y."end" AND y."start" < x."end"
WHERE x.role <> 'Protective' AND y.role <> 'Protective' AND NOT (x.role = 'Extended' AND y.role = 'Logical') AND NOT (y.role = 'Extended' AND x.role = 'Logical')
""")
def q_partition_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    role = F.element_at(F.array(*map(F.lit, ("Extended", "Protective", "Primary", "Logical", "Logical"))), (k % 5 + 1).cast("int"))
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("disk"), k.alias("part"), (k % 100 * 10).alias("start"), (k % 100 * 10 + k % 300 + 1).alias("end"), role.alias("role"))
    return volumes.overlapping_pairs(spans, "disk", "part", volumes.partition_exempt)


@query("""
SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS members, min(s_suppkey) FILTER (s_suppkey % 4 IN (1, 3)) AS system_slot, min(s_suppkey) FILTER (s_suppkey % 4 IN (2, 3)) AS data_slot,
  s_suppkey % 2 AS grp FROM supplier GROUP BY s_nationkey, s_suppkey % 2
""")
def q_volume_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 2).alias("grp"), (F.col("s_suppkey") % 4).alias("bits"))
    found = volumes.grouped_volumes(s, "s_nationkey", "grp", "s_suppkey", "bits", 1, 2)
    return found.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("""
WITH w AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'SUPPLIER-' || lpad(CAST(c_custkey % 40 AS VARCHAR), 9, '0') ELSE 'nothing' END AS wanted FROM customer),
n AS (SELECT s_nationkey, count(*) AS n, min(s_name) AS sole FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, coalesce(s_name, CASE WHEN n = 1 THEN sole END) AS pv FROM w
LEFT JOIN supplier ON s_nationkey = c_nationkey AND lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(wanted, '[^A-Za-z0-9]', '', 'g')) LEFT JOIN n ON n.s_nationkey = c_nationkey
""")
def q_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("SUPPLIER-"), F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0"))).otherwise("nothing")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    return volumes.resolved_names(c, s, "k", wanted, "s_name").select("c_custkey", "pv")


# --- address maps --------------------------------------------------------------------------------------------------

_RUNS = """
WITH e AS (SELECT DISTINCT l_orderkey, CAST(l_partkey % 100 AS BIGINT) AS logical_offset, CAST(l_suppkey % 30 + 1 AS BIGINT) AS length FROM lineitem)
"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents that overlap and lie within each other."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).cast("long").alias("logical_offset"), (F.col("l_suppkey") % 30 + 1).cast("long").alias("length")).distinct()


_REACH = _RUNS + ", r AS (SELECT *, max(logical_offset + length) OVER (PARTITION BY l_orderkey ORDER BY logical_offset, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reaches FROM e)\n"


@query(_REACH + """, t AS (SELECT l_orderkey, max(logical_offset + length) AS covered FROM e GROUP BY l_orderkey)
SELECT l_orderkey, logical_offset, length, false AS is_hole FROM e
UNION ALL SELECT l_orderkey, coalesce(reaches, 0), logical_offset - coalesce(reaches, 0), true FROM r WHERE logical_offset > coalesce(reaches, 0)
UNION ALL SELECT l_orderkey, covered, 192 - covered, true FROM t WHERE covered < 192
""")
def q_nested_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no extent covers, though extents nest, up to the size in whole blocks of 64."""
    e = _nested(spark, sf_dir)
    sizes = e.select("l_orderkey").distinct().withColumn("size", F.lit(150))
    return extents.normal_extents(e, sizes, "l_orderkey", 64)


@query(_REACH + "SELECT l_orderkey, logical_offset, length, reaches FROM r WHERE logical_offset < reaches")
def q_overlap_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents.overlap_errors(_nested(spark, sf_dir), "l_orderkey")


@query("""
WITH e AS (SELECT l_orderkey, min(l_suppkey) AS ordinal, CAST(l_partkey % 100 AS BIGINT) AS s, CAST(l_linenumber * 20 AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_partkey % 100, l_linenumber),
f AS (SELECT o_orderkey, o_custkey % 150 AS point, ordinal, s, row_number() OVER (PARTITION BY o_orderkey ORDER BY ordinal, s, n) AS k FROM orders LEFT JOIN e ON l_orderkey = o_orderkey AND o_custkey % 150 >= s AND o_custkey % 150 < s + n)
SELECT o_orderkey, point, ordinal FROM f WHERE k = 1
""")
def q_first_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several extents that cover a point the first by ordinal."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).cast("long").alias("logical_offset"), (F.col("l_linenumber") * 20).cast("long").alias("length"), "l_suppkey")
    e = line.groupBy("l_orderkey", "logical_offset", "length").agg(F.min("l_suppkey").alias("ordinal"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 150).alias("point"))
    return extents.first_covering(points, e, "l_orderkey", "point", "ordinal", []).select("o_orderkey", "point", "ordinal")


@query("""
SELECT o_orderkey, o_custkey // 64 // 8 AS level1, o_custkey // 64 % 8 AS level2, l2.entry FROM orders
LEFT JOIN (SELECT n_nationkey AS level1, n_regionkey AS table_id FROM nation) l1 ON o_custkey // 64 // 8 = l1.level1
LEFT JOIN (SELECT DISTINCT s_nationkey % 5 AS table_id, s_suppkey % 8 AS level2, s_nationkey % 5 * 100 + s_suppkey % 8 AS entry FROM supplier) l2 ON l1.table_id = l2.table_id AND o_custkey // 64 % 8 = l2.level2
""")
def q_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "orders").withColumns(extents.block_address(F.col("o_custkey"), 64, 8)).select("o_orderkey", F.lit(1).alias("image"), "level1", "level2")
    l1 = table(spark, sf_dir, "nation").select(F.lit(1).alias("image"), _long("n_nationkey").alias("level1"), F.col("n_regionkey").alias("table_id"))
    l2 = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("table_id"), _long("s_suppkey").alias("s")).select("table_id", (F.col("s") % 8).alias("level2"), (F.col("table_id") * 100 + F.col("s") % 8).alias("entry")).distinct()
    return extents.two_level_lookup(blocks, l1, l2, "image").select("o_orderkey", "level1", "level2", "entry")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'Sparse' WHEN 1 THEN 'Zero' WHEN 2 THEN 'Standard' ELSE 'Compressed' END AS state,
  CASE l_partkey % 4 WHEN 2 THEN (l_suppkey + 1) * 65536 WHEN 3 THEN l_suppkey * 100 END AS host_offset, CASE WHEN l_partkey % 4 = 3 THEN (l_linenumber + 1) * 512 END AS stored_size FROM lineitem
""")
def q_qcow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of 64-KiB clusters: sizes in sectors stand above bit 54."""
    line, k = F.col("l_linenumber").cast("long"), F.col("l_partkey") % 4
    packed = _long("l_suppkey") * 100 + line * (1 << 54) + (1 << 62)
    entry = F.when(k == 0, F.lit(0).cast("long")).when(k == 1, F.lit(1).cast("long")).when(k == 2, (_long("l_suppkey") + 1) * 65536).otherwise(packed)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", extents.qcow_state(entry, F.lit(16), F.lit(3)).alias("s"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.*")


@query("""
WITH e AS (SELECT p_partkey AS "index", p_size % 8 AS bits, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END AS mb, CASE p_partkey % 2 WHEN 0 THEN 'Dynamic' ELSE 'Fixed' END AS t FROM part),
s AS (SELECT *, CASE bits WHEN 0 THEN 'NotPresent' WHEN 1 THEN 'Undefined' WHEN 2 THEN 'Zero' WHEN 3 THEN 'Unmapped' WHEN 5 THEN 'Unmapped' WHEN 6 THEN 'FullyPresent' WHEN 7 THEN 'PartiallyPresent' END AS state, mb * 1048576 AS here FROM e),
r AS (SELECT *, CASE WHEN state IS NULL THEN 'unknown state' WHEN t = 'Fixed' AND state <> 'FullyPresent' THEN 'fixed image with a block that is not stored' WHEN t = 'Dynamic' AND state = 'PartiallyPresent' THEN 'dynamic image with a partial block'
  WHEN bits IN (6, 7) AND mb < 1 THEN 'offset in the header' WHEN bits IN (6, 7) AND here + 2097152 > 104857600 THEN 'block past the end' WHEN bits NOT IN (6, 7) AND here <> 0 THEN 'offset of a block that is not stored' END AS reason FROM s)
SELECT 1 AS image, "index", state, CAST(here AS BIGINT) AS file_offset, reason FROM r WHERE reason IS NOT NULL
""")
def q_bat_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mb = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(_long("p_partkey"))
    e = table(spark, sf_dir, "part").select(F.lit(1).alias("image"), F.col("p_partkey").alias("index"), (mb * (1 << 20) + F.col("p_size") % 8).alias("entry"), F.when(F.col("p_partkey") % 2 == 0, "Dynamic").otherwise("Fixed").alias("disk_type"), F.lit(104857600).alias("size"))
    return extents.bat_checks(e, "image", 2097152)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_suppkey % 256) >> CAST(7 - l_linenumber % 8 AS INTEGER)) & 1 = 1 AS msb, ((l_suppkey % 256) >> CAST(l_linenumber % 8 AS INTEGER)) & 1 = 1 AS lsb FROM lineitem
""")
def q_sub_block_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second byte of a bitmap, counted from either end."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit(b"\0"), be(F.col("l_suppkey") % 256, 1)).alias("bitmap"))
    at = F.col("l_linenumber") % 8 + 8
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", extents.sub_block_bit(F.col("bitmap"), at, msb_first=True).alias("msb"), extents.sub_block_bit(F.col("bitmap"), at).alias("lsb"))


@query("""
WITH e AS (SELECT user_id, event_id * 10 AS o, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id * 10 + event_id // 7 * 5 END AS p FROM events),
j AS (SELECT *, CASE WHEN lag(o + 10) OVER w = o AND ((p IS NULL AND lag(p) OVER w IS NULL) OR lag(p + 10) OVER w = p) AND lag(o) OVER w IS NOT NULL THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY o)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY o) AS run FROM j)
SELECT user_id, min(o) AS logical_offset, CAST(count(*) * 10 AS BIGINT) AS length, min(p) AS physical_offset FROM g GROUP BY user_id, run
""")
def q_coalesce_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = F.when(F.col("event_id") % 4 != 3, F.col("event_id") * 10 + F.expr("event_id div 7") * 5)
    return extents.coalesce_extents(e.select("user_id", (F.col("event_id") * 10).alias("logical_offset"), F.lit(10).cast("long").alias("length"), p.alias("physical_offset")), ["user_id"])


@query("""
SELECT o_orderkey, 0 AS ordinal, CAST(0 AS BIGINT) AS logical_offset, CAST((o_custkey % 200 + 1) * 4096 AS BIGINT) AS length, CAST((o_custkey + 100) * 4096 AS BIGINT) AS physical_offset, true AS ok FROM orders
UNION ALL SELECT o_orderkey, 1, (o_custkey % 200 + 1) * 4096, 5 * 4096, NULL, true FROM orders
UNION ALL SELECT o_orderkey, 2, (o_custkey % 200 + 6) * 4096, 300 * 4096, (o_custkey + 100 - 50) * 4096, true FROM orders
""")
def q_runlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, a hole, and a run that lies 50 clusters before the first."""
    o = table(spark, sf_dir, "orders")
    data = F.concat(F.lit(b"\x41"), le(F.col("o_custkey") % 200 + 1, 1), le(F.col("o_custkey") + 100, 4), F.lit(b"\x01\x05"), F.lit(b"\x12"), le(300, 2), F.lit(b"\xce\x00"))
    return extents.decode_runlists(o.select("o_orderkey", data.alias("runs")), "o_orderkey", "runs", 4096)


@query("""
WITH RECURSIVE n AS (SELECT c_nationkey AS d, c_custkey AS cluster, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS following FROM customer),
h AS (SELECT d, min(cluster) AS first FROM n GROUP BY d),
w AS (SELECT h.d, first AS cluster, 0 AS ordinal FROM h UNION ALL SELECT n.d, n.following, w.ordinal + 1 FROM w JOIN n ON n.d = w.d AND n.cluster = w.cluster WHERE n.following IS NOT NULL)
SELECT d, d + 1000 AS file_id, CAST(ordinal AS BIGINT) AS ordinal, cluster, CAST(ordinal * 512 AS BIGINT) AS logical_offset,
  (SELECT count(*) FROM n WHERE n.d = w.d) >= 10 AS ok FROM w WHERE ordinal < 10
""")
def q_cluster_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ten clusters: each nation's customers are a chain; nations with fewer give a file that ends early."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    following = F.coalesce(F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")), F.lit(0x0FFFFFFF))
    links = chains.fat_links(c.select(F.col("c_nationkey").alias("d"), F.col("c_custkey").alias("cluster"), following.alias("entry")), "d", "FAT32")
    files = c.groupBy(F.col("c_nationkey").alias("d")).agg(F.min("c_custkey").alias("first_cluster")).select("d", (F.col("d") + 1000).alias("file_id"), "first_cluster", F.lit(5120).alias("size"))
    return chains.cluster_chains(files, links, "d", 512)


@query("""
SELECT o_orderkey, o_custkey % 400 AS at, CASE WHEN o_custkey % 400 < 100 THEN 0 WHEN o_custkey % 400 < 150 THEN 1 ELSE 2 END AS area_ordinal,
  CASE WHEN o_custkey % 400 < 100 THEN 1000 + o_custkey % 400 WHEN o_custkey % 400 < 150 THEN 5000 + o_custkey % 400 - 100 ELSE 9000 + o_custkey % 400 - 150 END AS area_offset FROM orders
""")
def q_area_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three areas end to end, the last without an end."""
    asked = table(spark, sf_dir, "orders").select(F.lit(1).alias("pv"), "o_orderkey", (F.col("o_custkey") % 400).alias("at"))
    areas = spark.createDataFrame([(1, 0, 1000, 100), (1, 1, 5000, 50), (1, 2, 9000, 0)], "pv int, ordinal int, offset long, size long")
    return extents.area_offsets(asked, areas, "pv", "at", extents.range_parts(asked, "at")).drop("pv")


@query("""
WITH e AS (SELECT user_id, event_id, event_id - event_id % 3 AS start, CASE WHEN event_id % 2 = 0 THEN event_id - event_id % 3 ELSE 0 END AS tail FROM events),
h AS (SELECT user_id, start, max(event_id) AS head, arg_max(tail, event_id) AS tail FROM e GROUP BY user_id, start),
a AS (SELECT user_id, arg_max(start, head) AS active FROM h WHERE tail = start GROUP BY user_id)
SELECT a.user_id, greatest(1000, max(e.event_id + 8)) AS size FROM a JOIN e ON e.user_id = a.user_id AND e.start = a.active GROUP BY a.user_id
""")
def q_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequence of a log is active, and how large the image is after its patches."""
    start = F.col("event_id") - F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("sequence"), start.alias("sequence_start"), F.when(F.col("event_id") % 2 == 0, start).otherwise(0).alias("tail"))
    active = extents.active_log(e, "user_id")
    sizes = active.select("user_id").distinct().withColumn("size", F.lit(1000).cast("long"))
    return extents.replayed_size(sizes, active.withColumn("n", F.lit(8)), "user_id", "sequence", "n")


@query("""
SELECT o_orderkey, o_custkey AS at, CASE WHEN o_custkey < 50 THEN o_custkey + 100000 ELSE o_custkey END AS physical_offset, (o_custkey >= 200 AND o_custkey < 300) OR (o_custkey >= 500 AND o_custkey < 510) AS masked FROM orders
""")
def q_masked_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2).alias("v"), "o_orderkey", F.col("o_custkey").alias("at"))
    protected = spark.createDataFrame([(v, at, n) for v in (0, 1) for at, n in ((200, 100), (500, 10))], "v long, offset long, length long")
    return extents.masked_offsets(reads, protected, "v", "at", 50, 100_000).drop("v")


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem),
e AS (SELECT l_orderkey, k * 20 AS s, k * 20 + 15 AS t, k * 1000 AS p FROM m),
r AS (SELECT o_orderkey AS id, o_custkey % 60 AS a, o_custkey % 60 + o_custkey % 45 + 1 AS b FROM orders),
x AS (SELECT id, b, a AS cut FROM r UNION SELECT id, b, s FROM r JOIN e ON l_orderkey = id AND s > a AND s < b UNION SELECT id, b, t FROM r JOIN e ON l_orderkey = id AND t > a AND t < b),
c AS (SELECT id, cut, coalesce(lead(cut) OVER (PARTITION BY id ORDER BY cut), b) - cut AS length FROM x)
SELECT c.id AS request_id, cut AS piece_offset, length, p + cut - s AS physical_offset FROM c LEFT JOIN e ON l_orderkey = c.id AND cut >= s AND cut < t
""")
def q_request_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that cross extents of 15 bytes with holes of five."""
    from pyspark.sql import Window

    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = extents.task_parts(lines, orders)
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long") - 1
    e = lines.repartition(parts, "l_orderkey").select("l_orderkey", k.alias("k")).select("l_orderkey", (F.col("k") * 20).alias("logical_offset"), F.lit(15).cast("long").alias("length"), (F.col("k") * 1000).alias("physical_offset"))
    r = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 60).alias("offset"), (F.col("o_custkey") % 45 + 1).alias("length"))
    return extents.request_pieces(r, e, "l_orderkey", dealt=parts)


@query("""
SELECT o_orderkey, o_orderkey >> 13 AS "group", (o_orderkey >> 3) & 1023 AS block, o_orderkey & 7 AS place, ((o_orderkey >> 13) * 1000 + ((o_orderkey >> 3) & 1023)) * 4096 + (o_orderkey & 7) * 512 AS byte_offset,
  EXISTS (SELECT 1 FROM part WHERE p_partkey % 3 = 0 AND o_orderkey >= p_partkey * 64 AND o_orderkey < p_partkey * 64 + 64) AS "exists" FROM orders
""")
def q_inode_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit(1).alias("fs"), "o_orderkey").withColumns(extents.inode_addresses(F.col("o_orderkey"), 3, 10, 1000, 4096, 512))
    chunks = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.lit(1).alias("fs"), (_long("p_partkey") * 64).alias("chunk_start"))
    return extents.inodes_in_chunks(o, chunks, "fs", "o_orderkey").drop("fs")


# --- versions ------------------------------------------------------------------------------------------------------


@query("""
SELECT user_id, max(event_id) FILTER (event_type <> 'error') AS event_id, string_agg(DISTINCT CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) AS seen FROM events GROUP BY user_id
""")
def q_newest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest superblock that is valid; those that are not are still listed."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("valid"))
    found = versions.newest_valid(e, ["user_id"], "event_id", "valid", ["event_id"])
    return found.select("user_id", "event_id", F.array_join(F.sort_array(F.transform("versions", lambda x: x.cast("string"))), ",").alias("seen"))


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, 'name' || o_orderkey AS name, CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS r FROM orders)
SELECT o_custkey, arg_min(name, r * 10000000 + o_orderkey) AS name FROM n GROUP BY o_custkey
""")
def q_preferred_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("name"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 4).alias("space"))
    return versions.preferred_names(o, ["o_custkey"], "space", "o_orderkey", "name")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'F' GROUP BY o_custkey")
def q_first_that_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("at"), (F.col("o_orderstatus") == "F").alias("parses"))
    return versions.first_that_parses(o, ["o_custkey"], "o_orderkey", "at", "parses", ["o_orderkey"])


@query("""
WITH RECURSIVE n AS (SELECT c_nationkey AS image, c_custkey AS node, CASE WHEN c_custkey > 10 THEN c_custkey // 3 END AS up FROM customer),
t AS (SELECT x.image, x.node, CASE WHEN y.node IS NOT NULL THEN x.up END AS parent FROM n x LEFT JOIN n y ON y.node = x.up AND y.image = x.image),
d AS (SELECT image, node, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.image, t.node, d.depth + 1 FROM t JOIN d ON t.parent = d.node),
l AS (SELECT * FROM d WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
m AS (SELECT image, depth, count(*) AS n, min(node) AS node FROM l GROUP BY image, depth)
SELECT image, CASE WHEN arg_max(n, depth) = 1 THEN arg_max(node, depth) END AS active, arg_max(n, depth) > 1 AS ambiguous FROM m GROUP BY image
""")
def q_active_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image"), F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 10, F.expr("c_custkey div 3")).alias("up"))
    same = n.select(F.col("image").alias("_i"), F.col("node").alias("_n"))
    t = n.join(same, (F.col("up") == F.col("_n")) & (F.col("image") == F.col("_i")), "left").select("image", "node", F.when(F.col("_n").isNotNull(), F.col("up")).alias("parent"))
    return versions.active_snapshots(t, namespace.ancestors_doubled(t, "node", "parent"), ["image"], "node", "parent")


# --- namespaces ----------------------------------------------------------------------------------------------------

_NODES = """
WITH RECURSIVE n AS (SELECT r_regionkey + 1 AS node_id, 0 AS parent_id, r_name AS name, 'Directory' AS kind FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name, 'Directory' FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name, 'File' FROM customer),
p AS (SELECT node_id, '/' || name AS path FROM n WHERE parent_id = 0 UNION ALL SELECT n.node_id, p.path || '/' || n.name FROM n JOIN p ON n.parent_id = p.node_id)
"""


def _dirents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as folders and files below a root with id 0."""
    region = table(spark, sf_dir, "region").select((_long("r_regionkey") + 1).alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.lit("Directory").alias("kind"))
    nation = table(spark, sf_dir, "nation").select(_long("n_nationkey") + 100, _long("n_regionkey") + 1, "n_name", F.lit("Directory"))
    customer = table(spark, sf_dir, "customer").select(_long("c_custkey") + 1000, _long("c_nationkey") + 100, "c_name", F.lit("File"))
    return region.union(nation).union(customer)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.all_paths(_dirents(spark, sf_dir).select(F.col("parent_id").alias("parent"), "name", F.col("node_id").alias("node"), "kind"), 0)


@query(_NODES + "SELECT node_id AS node, path FROM p")
def q_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir)


@query(_NODES + "SELECT o_orderkey, n.kind, n.node_id IS NOT NULL AS found FROM orders LEFT JOIN n ON n.node_id = o_custkey")
def q_nodes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("node_id"))
    return namespace.nodes_by_id(asked, _dirents(spark, sf_dir).select("node_id", "kind")).select("o_orderkey", "kind", "found")


@query(_NODES + """, r AS (SELECT p_partkey AS request_id, p_size * 20 AS node_id FROM part),
s AS (SELECT request_id, r.node_id, CASE WHEN n.node_id IS NULL THEN 'NotFound' WHEN kind <> 'Directory' THEN 'InvalidFormat' ELSE 'Ok' END AS status FROM r LEFT JOIN n ON n.node_id = r.node_id)
SELECT request_id, status, NULL AS name FROM s WHERE status <> 'Ok' UNION ALL SELECT request_id, status, n.name FROM s JOIN n ON n.parent_id = s.node_id WHERE status = 'Ok'
""")
def q_list_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dirents(spark, sf_dir)
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), (_long("p_size") * 20).alias("node_id"))
    return namespace.read_dir(asked, d, d).select("request_id", "status", "name")


@query("""
WITH d AS (SELECT n_regionkey AS parent_id, n_name AS name, n_nationkey AS node_id FROM nation)
SELECT c_custkey AS request_id, node_id FROM (SELECT c_custkey, c_custkey % 5 AS parent_id, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey) r LEFT JOIN d ON d.parent_id = r.parent_id AND d.name = r.name
""")
def q_lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are asked for in mixed case on a volume that folds them."""
    nation = table(spark, sf_dir, "nation")
    d = nation.select(F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("node_id"), F.col("n_nationkey").alias("ordinal"))
    asked = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 5).alias("parent_id"), F.initcap("n_name").alias("name"))
    return namespace.lookup_names(asked, d, folded=True).select("request_id", "node_id")


@query(_NODES + """, r AS (SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '/nowhere' ELSE p.path END AS path FROM customer JOIN p ON p.node_id = c_custkey + 1000)
SELECT request_id, p.node_id, CASE WHEN r.path IS NULL THEN 'Unsupported' WHEN p.node_id IS NULL THEN 'NotFound' ELSE 'Ok' END AS status FROM r LEFT JOIN p ON p.path = r.path
""")
def q_find_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with doubled slashes and dots; two dots are not supported."""
    every = _paths(spark, sf_dir)
    k = F.col("node") % 3
    asked = every.filter("node >= 1000").select((F.col("node") - 1000).alias("request_id"), F.when((F.col("node") - 1000) % 3 == 0, F.lit("/a/../b")).when((F.col("node") - 1000) % 3 == 1, F.lit("//./nowhere")).otherwise(F.regexp_replace("path", "/", "//./")).alias("path"))
    del k
    return namespace.find_paths(asked, every).select("request_id", "node_id", "status")


@query(_NODES + "SELECT node_id AS node, path, '/data' || path AS target FROM p WHERE node_id BETWEEN 100 AND 110")
def q_firmlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _paths(spark, sf_dir)
    attributes = every.select("node", F.when(F.col("node").between(100, 110), "link").otherwise("other").alias("name"), F.concat(F.lit("/data"), "path").alias("value"))
    return namespace.firmlinks(every, attributes, "link")


@query(_NODES + """, f AS (SELECT '/' || r_name AS src FROM region WHERE r_regionkey < 3 UNION ALL SELECT path FROM p WHERE node_id BETWEEN 100 AND 115)
SELECT node_id AS node, coalesce((SELECT max_by(src, length(src)) FROM f WHERE p.path = src OR starts_with(p.path, src || '/')), 'System') AS root FROM p
""")
def q_overlay_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of a table of sources that a path lies below."""
    every = _paths(spark, sf_dir)
    sources = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.concat(F.lit("/"), "r_name").alias("path")).union(every.filter("node BETWEEN 100 AND 115").select("path"))
    return namespace.overlay_roots(every, sources, "System").select("node", "root")


@query("""
WITH n AS (SELECT c_custkey AS node_id, c_nationkey AS parent_id, c_custkey * 10 AS size, CASE WHEN c_custkey % 4 = 0 THEN c_custkey // 2 END AS link_id FROM customer)
SELECT n.node_id, t.node_id AS target_id, coalesce(t.size, n.size) AS size FROM n LEFT JOIN n t ON t.node_id = n.link_id WHERE n.parent_id NOT IN (3, 4) AND n.node_id NOT IN (3, 4) AND n.node_id % 10 <> 7
""")
def q_hard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links have their target's size; hidden folders, their children and internal names are left out."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 10 == 7, F.lit("iNode7")).otherwise(F.col("c_name"))
    nodes = c.select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("parent_id"), name.alias("name"), (F.col("c_custkey") * 10).alias("size"), F.when(F.col("c_custkey") % 4 == 0, F.expr("c_custkey div 2")).alias("link_id"))
    return namespace.hard_links(nodes, spark.createDataFrame([(3,), (4,)], "node_id long"), "iNode")


@query("""
SELECT n_nationkey AS node_id, s_name AS name, n_nationkey % 2 = 0 AS from_index FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 1 OR s_suppkey % 3 > 0
""")
def q_children_by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without an index are answered from all records."""
    records = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("parent_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("child_id"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node_id"), (F.col("n_nationkey") % 2 == 0).alias("has_index"))
    return namespace.children_by_scan(asked, records.filter("child_id % 3 > 0"), records).select("node_id", "name", "from_index")


@query("""
WITH a AS (SELECT o_custkey AS node_id, o_orderstatus AS kind, CAST(o_orderkey % 7 AS VARCHAR) AS name, o_custkey AS record FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, o_orderstatus, CAST(o_orderkey % 7 AS VARCHAR), o_orderkey + 100000 FROM orders WHERE o_orderkey % 2 = 1)
SELECT node_id, kind, name, min(record) AS record FROM a GROUP BY node_id, kind, name
""")
def q_merged_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 7).cast("string").alias("name"), "o_orderkey")
    return namespace.merged_attributes(o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), o.filter("o_orderkey % 2 = 1").withColumn("record", F.col("o_orderkey") + 100_000))


@query("""
SELECT c_custkey AS node_id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'stored' || c_custkey WHEN 2 THEN 'attribute' END AS target FROM customer
""")
def q_symlink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    own = c.select(F.col("c_custkey").alias("node_id"), F.when(k == 0, F.concat(F.col("c_name").cast("binary"), F.lit(b"\0rest"))).alias("inline"))
    stored = c.filter(k == 1).select(F.col("c_custkey").alias("node_id"), F.concat(F.lit("stored"), F.col("c_custkey").cast("string")).cast("binary").alias("data"))
    attributes = c.filter(k >= 2).select(F.col("c_custkey").alias("node_id"), F.when(k == 2, "target").otherwise("other").alias("name"), F.lit(b"attribute").alias("value"))
    return namespace.symlink_targets(own, stored, attributes, "target")


# --- streams -------------------------------------------------------------------------------------------------------

_KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'File' WHEN 1 THEN 'Symlink' WHEN 2 THEN 'Directory' ELSE 'Special' END"
_STREAMS = f"""
WITH n AS (SELECT o_orderkey AS node_id, {_KIND} AS kind, o_custkey AS size FROM orders),
s AS (SELECT node_id, 'Data' AS stream_kind, NULL AS stream_name, size FROM n WHERE kind IN ('File', 'Symlink')
  UNION ALL SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'ResourceFork' ELSE 'ExtendedAttribute' END, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END, 5 FROM lineitem)
"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("File", "Symlink", "Directory", "Special"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), kind.alias("kind"), F.col("o_custkey").alias("size"))
    attributes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_returnflag").alias("name")).distinct().withColumn("size", F.lit(5).cast("long"))
    return streams.named_streams(nodes, attributes, "R")


@query(_STREAMS + "SELECT node_id, stream_kind, stream_name, CAST(size AS BIGINT) AS size FROM s")
def q_named_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streams(spark, sf_dir)


@query(_STREAMS + """, r AS (SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 2 = 0 THEN 'Data' ELSE 'ExtendedAttribute' END AS k, CASE WHEN o_custkey % 2 = 1 THEN 'N' END AS name FROM orders)
SELECT request_id, CAST(size AS BIGINT) AS size, CASE WHEN node_id IS NULL THEN 'NotFound' ELSE 'Ok' END AS status FROM r LEFT JOIN s ON node_id = request_id AND stream_kind = k AND stream_name IS NOT DISTINCT FROM name
""")
def q_opened_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("o_custkey") % 2 == 1
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("node_id"), F.when(odd, "ExtendedAttribute").otherwise("Data").alias("stream_kind"), F.when(odd, "N").alias("stream_name"))
    return streams.opened_streams(asked, _streams(spark, sf_dir)).select("request_id", "size", "status")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS f, CAST(l_linenumber AS BIGINT) AS t, l_linenumber % 7 = 0 AS resident, CAST(l_linenumber * 10 AS BIGINT) AS size FROM lineitem),
g AS (SELECT *, f <> coalesce(lag(t) OVER (PARTITION BY l_orderkey ORDER BY f, t), 0) AND NOT resident AS gap FROM a)
SELECT l_orderkey, count(*) AS n_parts, max(size) AS size, max(size - 3) AS valid_size, bool_or(resident) AND NOT bool_and(resident) AS mixed, NOT bool_or(gap) AS gap_free,
  NOT bool_or(gap) AND NOT (bool_or(resident) AND NOT bool_and(resident)) AS ok FROM g GROUP BY l_orderkey
""")
def q_stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _long("l_linenumber")
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", (line % 7 == 0).alias("resident"), (line - 1).alias("first"), line.alias("following"), (line * 10).alias("size"), (line * 10 - 3).alias("valid_size")).distinct()
    return streams.stream_checks(parts, ["l_orderkey"])


@query("""
WITH n AS (SELECT p_partkey AS node_id, CASE p_size % 4 WHEN 0 THEN 16384 WHEN 1 THEN 32768 WHEN 2 THEN 40960 ELSE 4096 END + p_partkey % 4096 AS mode FROM part)
SELECT node_id, CASE mode & 61440 WHEN 16384 THEN 'Directory' WHEN 32768 THEN 'File' WHEN 40960 THEN 'Symlink' ELSE 'Special' END AS kind,
  CAST((mode >> 6) & 7 AS VARCHAR) || CAST((mode >> 3) & 7 AS VARCHAR) || CAST(mode & 7 AS VARCHAR) AS permissions, mode & 2048 <> 0 AS set_uid, mode & 512 <> 0 AS sticky FROM n
""")
def q_node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, (16384, 32768, 40960, 4096))), (F.col("p_size") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (kind + F.col("p_partkey") % 4096).cast("long").alias("mode"), *(F.lit(0).alias(c) for c in ("owner", "group", "flags", "created", "modified", "accessed")))
    return streams.node_details(p).select("node_id", "kind", "permissions", "set_uid", "sticky")


@query("SELECT l_orderkey, CAST(max(l_partkey % 100 + l_suppkey % 30 + 1) AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey")
def q_object_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.object_sizes(_nested(spark, sf_dir), "l_orderkey", "logical_offset", "length")


@query("SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length, true AS same FROM documents WHERE coalesce(text, '') <> ''")
def q_folded_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole text's checksum from those of its pieces in order, against the text's own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("bytes")).filter("length(bytes) > 0")
    pieces = blobs.windows(docs, "doc_id", 700)
    own = docs.select("doc_id", F.crc32("bytes").alias("own"))
    return streams.folded_checksums(pieces, "doc_id", "window_offset", "bytes").join(own, "doc_id").select("doc_id", "length", (F.col("own") == F.col("crc32")).alias("same"))


# --- sources and scalars -------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), r AS (SELECT doc_id, b, doc_id % 700 AS "offset", doc_id % 90 AS length FROM d)
SELECT doc_id, "offset", length, greatest(0, least(length, octet_length(b) - "offset")) AS n_read, greatest(0, least(length, octet_length(b) - "offset")) = length AS complete FROM r WHERE "offset" < octet_length(b)
UNION ALL SELECT doc_id, "offset", length, 0, length = 0 FROM r WHERE "offset" >= octet_length(b)
""")
def q_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads past the end are short, not errors; whether all was there is a column."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    ranges = docs.select("source_id", (F.col("source_id") % 700).alias("offset"), (F.col("source_id") % 90).alias("length"))
    return blobs.slices(docs, ranges).select(F.col("source_id").alias("doc_id"), "offset", "length", "n_read", "complete")


@query("""
WITH s AS (SELECT o_custkey AS set_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, o_orderkey % 9000 AS size, count(*) OVER (PARTITION BY o_custkey) + CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS declared FROM orders),
l AS (SELECT *, greatest(size - 512, 0) AS length FROM s)
SELECT set_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(coalesce(sum(length) OVER (PARTITION BY set_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset, length, set_id % 4 <> 0 AS complete_set FROM l
""")
def q_segment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("ordinal"), (F.col("o_orderkey") % 9000).alias("size"), (F.count("*").over(w) + F.when(F.col("o_custkey") % 4 == 0, 1).otherwise(0)).alias("declared"))
    return blobs.segment_windows(o, 512)


@query("""
SELECT o_orderkey, o_orderkey % 65536 AS u16, o_custkey AS u32, CAST(o_orderkey * 4000000 AS BIGINT) AS u64, lpad(lower(to_hex(o_orderkey)), 8, '0') || '-0100-0200-0304-05060708090a' AS guid FROM orders
""")
def q_integer_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned numbers in both byte orders and an identifier, from the bytes that were made of them."""
    o = table(spark, sf_dir, "orders")
    data = F.concat(le(F.col("o_orderkey") % 65536, 2), be(F.col("o_custkey"), 4), le(F.col("o_orderkey") * 4_000_000, 8), le(F.col("o_orderkey"), 4), F.lit(bytes([0, 1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 10])))
    d = F.col("d")
    return o.select("o_orderkey", data.alias("d")).select("o_orderkey", decode.uint(d, 0, 2).alias("u16"), decode.uint(d, 2, 4, big=True).alias("u32"), decode.uint(d, 6, 8).cast("long").alias("u64"), decode.guid(d, 14).alias("guid"))


@query("""
SELECT o_orderkey, make_timestamp(CAST(1980 + o_custkey % 128 AS BIGINT), CAST(o_orderkey % 12 + 1 AS BIGINT), CAST(o_orderkey % 28 + 1 AS BIGINT), CAST(o_orderkey % 24 AS BIGINT), CAST(o_orderkey % 60 AS BIGINT), CAST(o_orderkey % 30 * 2 AS DOUBLE)) AS at FROM orders
""")
def q_dos_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    date = F.col("o_custkey") % 128 * 512 + (k % 12 + 1) * 32 + k % 28 + 1
    time = k % 24 * 2048 + k % 60 * 32 + k % 30
    return table(spark, sf_dir, "orders").select("o_orderkey", text.dos_timestamp(date, time).alias("at"))


#: Chunks of one text, packed in several ways.
_PACKED = [(k, f(b"packed text " * 9)) for k, f in (("zlib", zlib.compress), ("bzip2", bz2.compress), ("xz", lzma.compress), ("none", bytes))] + [("zlib", b"damaged")]


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 'packed text packed t' END AS text FROM part")
def q_decompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twenty bytes of each chunk; a damaged one gives nothing and fails nothing."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", pick([k for k, _ in _PACKED]).alias("kind"), pick([d for _, d in _PACKED]).alias("data"))
    return p.select("p_partkey", text.utf8_text(text.decompressed("kind", "data", F.lit(20))).alias("text"))


@query("SELECT n_nationkey, n_name || ' é€ß' AS back FROM nation")
def q_code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored_name = F.concat(F.col("n_name").cast("binary"), F.lit(" é€ß".encode("cp1252")))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.code_page("windows-1252")(stored_name).alias("back"))


@query("""
SELECT p_partkey, 'disk' || chr(CAST(97 + p_partkey % 676 // 26 AS INTEGER)) || chr(CAST(97 + p_partkey % 26 AS INTEGER)) AS name, p_partkey % 676 AS ordinal FROM part
""")
def q_segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphabetic names from numbers, and the numbers again from the names."""
    p = table(spark, sf_dir, "part").select("p_partkey", descriptors.segment_name(F.lit("disk"), F.col("p_partkey") % 676, 2).alias("name"))
    return p.select("p_partkey", "name", descriptors.segment_ordinal(F.concat(F.lit("x."), F.right("name", F.lit(2)))).alias("ordinal"))


@query("""
SELECT s_suppkey, 'monolithicSparse' AS createtype, s_suppkey * 2 AS sectors, s_name AS file_name, CAST(s_suppkey * 1024 AS BIGINT) AS second_offset FROM supplier
""")
def q_image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and extent lines of a text descriptor: the second extent begins where the first ends."""
    s = table(spark, sf_dir, "supplier")
    body = F.concat(F.lit('# Disk DescriptorFile\ncreateType="monolithicSparse"\nRW '), (F.col("s_suppkey") * 2).cast("string"), F.lit(' SPARSE "'), "s_name", F.lit('"\nRW 5 FLAT "b" 0\n'))
    d = s.select("s_suppkey", body.alias("body"))
    lines = descriptors.extent_lines(d, "s_suppkey", "body")
    one, two = lines.filter("ordinal = 0"), lines.filter("ordinal = 1").select("s_suppkey", F.col("logical_offset").alias("second_offset"))
    keys = d.select("s_suppkey", descriptors.pairs(F.col("body"))["createtype"].alias("createtype"))
    return one.join(two, "s_suppkey").join(keys, "s_suppkey").select("s_suppkey", "createtype", F.expr("length div 512").alias("sectors"), F.col("name").alias("file_name"), "second_offset")


@query("SELECT s_suppkey, s_name AS name, CAST(s_nationkey AS VARCHAR) AS size FROM supplier")
def q_property_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit("<plist><dict><key>other</key><string>x</string><key>size</key><integer>"), F.col("s_nationkey").cast("string"), F.lit("</integer></dict><name>"), "s_name", F.lit("</name></plist>"))
    x = F.col("x")
    return table(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("x")).select("s_suppkey", descriptors.element_text(x, "//name").alias("name"), descriptors.plist_value(x, "size").alias("size"))


@query("""
WITH s AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 3 WHEN 0 THEN '/e/with/bands/0' WHEN 1 THEN '/e/with/disk.hds' END AS resolved FROM supplier) SELECT request_id, resolved FROM s
""")
def q_related_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the relative path, else a sibling of the same name, else nothing."""
    path = F.element_at(F.array(*map(F.lit, ("bands/0", "elsewhere/disk.hds", "gone"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), F.lit("Extent").alias("purpose"), F.lit("/e/with").alias("parent_path"), path.alias("relative_path"))
    return blobs.related_sources(asked, sample_sources(spark, sf_dir)).select("request_id", "resolved")


@query("SELECT doc_id, CAST(least(octet_length(encode(text)), 65536) AS INTEGER) AS head, CAST(least(octet_length(encode(text)), 4096) AS INTEGER) AS tail FROM documents WHERE text IS NOT NULL")
def q_heads_and_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("bytes"))
    return blobs.heads(docs).select("doc_id", F.length("head").alias("head"), F.length("tail").alias("tail"))


@query("""
SELECT s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'FAT12' WHEN 1 THEN 'FAT16' ELSE 'FAT32' END AS variant, CAST(CASE s_suppkey % 3 WHEN 0 THEN 4000 - 1 - 24 - 32 WHEN 1 THEN 60000 - 1 - 400 - 32 ELSE 2000000 - 1 - 18000 - 32 END AS BIGINT) AS n_clusters, true AS ok FROM supplier
""")
def q_fat_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variant a volume is follows from its number of clusters."""
    k = F.col("s_suppkey") % 3
    total, fat = F.when(k == 0, 4000).when(k == 1, 60_000).otherwise(2_000_000), F.when(k == 0, 12).when(k == 1, 200).otherwise(9000)
    head = blob(512, {11: (le(512, 2), 2), 13: (le(1, 1), 1), 14: (le(1, 2), 2), 16: (le(2, 1), 1), 17: (le(512, 2), 2), 22: (le(fat, 2), 2), 32: (le(total, 4), 4), 510: (b"\x55\xaa", 2)})
    return decode.fat_boot_sector(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), head.alias("head"))).select("source_id", "variant", "n_clusters", "ok")
