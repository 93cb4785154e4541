"""Headers, trailers and superblocks as layouts: where each field stands, what follows from it, and what must hold.

A layout is data. ``decode_header`` turns it into columns and ``header_checks`` into one row for each rule, so a decoder is
a projection: no Python worker, no shuffle, and a source that breaks a rule gives rows, not a failed job. Fields past the
end of the bytes are null and fail the rules that need them. Unsigned 8-byte fields are DECIMAL(20,0).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions import checksums
from strataspark.functions.text import utf8_text, utf16_text
from strataspark.operators.decode import field as cut
from strataspark.operators.decode import guid, once, ones_complement_ok, uint

#: A field: its offset, its size in bytes and how to read it.
Field = tuple[int, int, str]
#: SQL, or what gives a column when there is a session.
Rule = str | Callable[[], Column]


@dataclass(frozen=True)
class Layout:
    """``fields`` are read from the bytes, ``derived`` from fields in the order given, ``rules`` must hold for both.

    Expressions of ``derived`` and ``rules`` may also use ``data``, the bytes, and columns of the sources named in ``needs``."""

    format_id: str
    fields: dict[str, Field]
    rules: dict[str, Rule]
    derived: dict[str, Rule] = field(default_factory=dict)
    needs: tuple[str, ...] = ()


def _read(data: Column, at: int, size: int, kind: str) -> Column:
    reads: dict[str, Callable[[], Column]] = {
        "le": lambda: uint(data, at, size),
        "be": lambda: uint(data, at, size, big=True),
        "hex": lambda: F.hex(cut(data, at, size)),
        "guid": lambda: F.when(F.length(data) >= at + 16, guid(data, at)),
        "ascii": lambda: c_string(cut(data, at, size)),
        "utf16be": lambda: utf16_text(cut(data, at, size), "BE"),
    }
    return reads[kind]()


def c_string(data: Column) -> Column:
    """Single-byte text up to the first NUL."""
    return F.get(F.split(F.decode(data, "ISO-8859-1"), "\u0000"), F.lit(0))


def _expr(x: Rule) -> Column:
    return F.expr(x) if isinstance(x, str) else x()


def decode_header(sources: DataFrame, layout: Layout, data: str | Column = "head", keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """(keys, fields, derived, failed, ok): ``failed`` names the rules that do not hold."""
    kept = [*keys, *(c for c in layout.needs if c not in keys)]
    bytes_ = F.col(data) if isinstance(data, str) else data
    out = sources.select(*kept, bytes_.alias("data"))
    out = once(out, {name: _read(F.col("data"), *spec) for name, spec in layout.fields.items()})
    for name, x in layout.derived.items():
        out = out.withColumn(name, _expr(x))
    broken = [F.when(~F.coalesce(_expr(x), F.lit(False)), F.lit(name)) for name, x in layout.rules.items()]
    out = out.withColumn("failed", F.array_compact(F.array(*broken)))
    return out.withColumn("ok", F.size("failed") == 0).drop("data", *(c for c in layout.needs if c not in keys))


def header_checks(sources: DataFrame, layout: Layout, data: str | Column = "head", keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """(keys, check_name, ok): one row for each rule of the layout."""
    names = F.explode(F.array(*(F.lit(f"{layout.format_id}.{x}") for x in layout.rules)))
    decoded = decode_header(sources, layout, data, keys).select(*keys, "failed", names.alias("check_name"))
    return decoded.select(*keys, "check_name", (~F.array_contains("failed", F.substring_index("check_name", ".", -1))).alias("ok"))


def last_bytes(tail: str, size: int) -> Column:
    """The last ``size`` bytes, null if there are fewer: where trailers stand."""
    return F.expr(f"CASE WHEN length({tail}) >= {size} THEN substring({tail}, length({tail}) - {size - 1}, {size}) END")


def power_of_two(x: str) -> str:
    return f"({x} > 0 AND ({x} & ({x} - 1)) = 0)"


def zeroed(data: Column, at: int, size: int = 4) -> Column:
    """The bytes with a field of zeros, as checksums of a structure that holds its own are taken."""
    return F.concat(F.expr(f"substring(data, 1, {at})") if at else F.lit(b""), F.lit(bytes(size)), F.expr(f"substring(data, {at + size + 1})"))


# --- disk images ---------------------------------------------------------------------------------------------------

QCOW_FEATURES = {1: "dirty", 2: "corrupt", 4: "external-data", 8: "compression", 16: "extended-l2"}

QCOW = Layout(
    "image.qcow",
    {
        "magic": (0, 4, "hex"), "version": (4, 4, "be"), "backing_offset": (8, 8, "be"), "backing_size": (16, 4, "be"), "_bits": (20, 4, "be"),
        "virtual_size": (24, 8, "be"), "_bits1": (32, 1, "be"), "_l2bits1": (33, 1, "be"), "_crypt": (32, 4, "be"), "_crypt1": (36, 4, "be"), "_l1": (36, 4, "be"),
        "l1_offset": (40, 8, "be"), "_refcounts": (48, 8, "be"), "_refclusters": (56, 4, "be"), "_snaps": (60, 4, "be"), "_snapat": (64, 8, "be"),
        "_features": (72, 8, "be"), "_order": (96, 4, "be"), "_header": (100, 4, "be"), "_compress": (104, 1, "be"),
    },
    {
        "magic": "magic = '514649FB'", "version": "version IN (1, 2, 3)", "header_size": "header_size <= length(data) AND (version < 3 OR header_size >= 104)",
        "cluster_bits": "cluster_bits BETWEEN 9 AND 21", "encryption": "encryption = 0", "compression": "compression IN (0, 1)", "refcount_order": "refcount_order = 4",
        "l1_entries": "l1_entries > 0", "virtual_size": "virtual_size > 0", "l1_range": "l1_offset + l1_entries * 8 <= size",
        "backing": "backing_size = 0 OR (backing_offset >= header_size AND backing_offset + backing_size <= size)",
        "refcounts": "version = 1 OR (refcount_clusters > 0 AND refcount_offset % cluster_size = 0 AND refcount_offset + refcount_clusters * cluster_size <= size)",
        "snapshots": "snapshots = 0 OR (snapshot_offset > 0 AND snapshot_offset + 40 <= size)",
    },
    {
        "header_size": "CASE version WHEN 1 THEN 48 WHEN 2 THEN 72 ELSE _header END", "cluster_bits": "IF(version = 1, _bits1, _bits)",
        "cluster_size": "CASE WHEN cluster_bits BETWEEN 0 AND 30 THEN shiftleft(1L, CAST(cluster_bits AS INT)) END",
        "l2_bits": "IF(version = 1, _l2bits1, cluster_bits - 3)", "encryption": "IF(version = 1, _crypt1, _crypt)",
        "compression": "IF(version = 3 AND header_size >= 112, _compress, 0)", "refcount_order": "IF(version = 3, _order, 4)",
        # Version 1 has no count of its own: as many entries as the virtual size needs.
        "l1_entries": "CASE WHEN version > 1 THEN _l1 WHEN l2_bits BETWEEN 0 AND 30 THEN CAST(ceil(virtual_size / (cluster_size * shiftleft(1L, CAST(l2_bits AS INT)))) AS BIGINT) END",
        "refcount_offset": "IF(version = 1, 0, _refcounts)", "refcount_clusters": "IF(version = 1, 0, _refclusters)",
        "snapshots": "IF(version = 1, 0, _snaps)", "snapshot_offset": "IF(version = 1, 0, _snapat)",
        "features": lambda: F.filter(
            F.array(*(F.when(F.expr(f"version = 3 AND (CAST(_features % 32 AS BIGINT) & {bit}) <> 0"), F.lit(name)) for bit, name in QCOW_FEATURES.items())), lambda x: x.isNotNull()
        ),
    },
    needs=("size",),
)

VHD_FOOTER = Layout(
    "image.vhd",
    {
        "cookie": (0, 8, "ascii"), "features": (8, 4, "be"), "format_version": (12, 4, "be"), "data_offset": (16, 8, "be"), "current_size": (48, 8, "be"),
        "cylinders": (56, 2, "be"), "heads": (58, 1, "be"), "sectors_per_track": (59, 1, "be"), "_type": (60, 4, "be"), "identifier": (68, 16, "hex"),
    },
    {
        "cookie": "cookie = 'conectix'", "format_version": "format_version = 65536", "disk_type": "disk_type IS NOT NULL", "checksum": lambda: ones_complement_ok(F.col("data"), 512, 64),
    },
    {"disk_type": "CASE _type WHEN 2 THEN 'Fixed' WHEN 3 THEN 'Dynamic' WHEN 4 THEN 'Differential' END", "has_dynamic_header": "data_offset <> 18446744073709551615BD"},
)

VHD_DYNAMIC = Layout(
    "image.vhd-dynamic",
    {
        "cookie": (0, 8, "ascii"), "bat_offset": (16, 8, "be"), "format_version": (24, 4, "be"), "block_count": (28, 4, "be"), "block_size": (32, 4, "be"),
        "parent_identifier": (40, 16, "hex"), "parent_name": (64, 512, "utf16be"),
    },
    {
        "cookie": "cookie = 'cxsparse'", "format_version": "format_version = 65536", "block_size": "block_size > 0 AND block_size % 512 = 0",
        "checksum": lambda: ones_complement_ok(F.col("data"), 1024, 36),
    },
    # One bit for each sector of a block, in whole sectors.
    {"bitmap_size": "CAST(ceil(ceil(block_size / 512 / 8) / 512) * 512 AS BIGINT)"},
)

VHDX_ALIGNMENT = 1 << 20
VHDX_HEADER = Layout(
    "image.vhdx",
    {
        "signature": (0, 4, "ascii"), "_checksum": (4, 4, "le"), "sequence": (8, 8, "le"), "file_write_guid": (16, 16, "guid"), "data_write_guid": (32, 16, "guid"),
        "log_guid": (48, 16, "guid"), "log_version": (64, 2, "le"), "format_version": (66, 2, "le"), "log_length": (68, 4, "le"), "log_offset": (72, 8, "le"),
    },
    {
        "signature": "signature = 'head'", "checksum": lambda: checksums.crc32c(zeroed(F.col("data"), 4)) == F.col("_checksum"), "format_version": "format_version = 1",
        "log_length": f"log_length > 0 AND log_length % {VHDX_ALIGNMENT} = 0", "log_offset": f"log_offset >= {VHDX_ALIGNMENT} AND log_offset % {VHDX_ALIGNMENT} = 0",
        "reserved": lambda: F.expr("substring(data, 81)") == F.lit(bytes(4096 - 80)),
    },
)

VMDK_FLAGS = 0x30007
VMDK_SPARSE = Layout(
    "image.vmdk",
    {
        "magic": (0, 4, "ascii"), "format_version": (4, 4, "le"), "flags": (8, 4, "le"), "capacity_sectors": (12, 8, "le"), "grain_sectors": (20, 8, "le"),
        "descriptor_sector": (28, 8, "le"), "descriptor_sectors": (36, 8, "le"), "table_entries": (44, 4, "le"), "secondary_directory": (48, 8, "le"),
        "primary_directory": (56, 8, "le"), "metadata_sectors": (64, 8, "le"), "_dirty": (72, 1, "le"), "_newlines": (73, 4, "hex"), "compression": (77, 2, "le"),
    },
    {
        "magic": "magic = 'KDMV'", "newlines": "_newlines = '0A200D0A'", "format_version": "format_version BETWEEN 1 AND 3", "flags": f"(flags & ~{VMDK_FLAGS}L) = 0 AND (flags & 1) = 1",
        "capacity": "capacity_sectors > 0", "grain_size": "grain_sectors >= 8 AND " + power_of_two("try_cast(grain_sectors AS BIGINT)"),
        "descriptor": "(descriptor_sector = 0) = (descriptor_sectors = 0)", "table_entries": "table_entries > 0 AND table_entries * 4 % 512 = 0",
        "primary_directory": "primary_directory > 0", "secondary_directory": "(flags & 2) = 0 OR secondary_directory > 0",
        "compression": "compression = 0 OR (compression = 1 AND (flags & 65536) <> 0)",
    },
    {
        "is_dirty": "_dirty <> 0", "virtual_size": "capacity_sectors * 512", "directory_at_end": "primary_directory = 18446744073709551615BD",
        "uses_secondary": "(flags & 2) <> 0", "has_compressed_grains": "(flags & 65536) <> 0",
    },
)

VMDK_COWD = Layout(
    "image.vmdk-cowd",
    {
        "magic": (0, 4, "ascii"), "format_version": (4, 4, "le"), "flags": (8, 4, "le"), "capacity_sectors": (12, 4, "le"), "grain_sectors": (16, 4, "le"),
        "directory_sector": (20, 4, "le"), "directory_entries": (24, 4, "le"), "next_free_sector": (28, 4, "le"), "parent_path": (32, 1024, "ascii"),
        "parent_generation": (1056, 4, "le"), "generation": (1060, 4, "le"), "saved_generation": (1636, 4, "le"), "_dirty": (1648, 4, "le"),
    },
    {
        "magic": "magic = 'COWD'", "format_version": "format_version = 1", "flags": "(flags & ~3L) = 0", "capacity": "capacity_sectors > 0", "grain_size": power_of_two("grain_sectors"),
        "directory": "directory_sector > 0 AND directory_entries > 0", "dirty": "_dirty IN (0, 1)",
    },
    {"is_dirty": "_dirty = 1"},
)

UDIF_TRAILER = Layout(
    "image.udif",
    {
        "magic": (0, 4, "ascii"), "trailer_size": (8, 4, "be"), "flags": (12, 4, "be"), "data_offset": (24, 8, "be"), "data_size": (32, 8, "be"), "data_checksum_type": (80, 4, "be"),
        "_data_checksum": (88, 4, "be"), "plist_offset": (216, 8, "be"), "plist_size": (224, 8, "be"), "master_checksum_type": (352, 4, "be"), "_master_checksum": (360, 4, "be"),
        "image_type": (488, 4, "be"), "sector_count": (492, 8, "be"),
    },
    {
        "magic": "magic = 'koly'", "trailer_size": "trailer_size >= 512", "data_range": "data_offset + data_size <= size",
        "plist_range": "plist_size = 0 OR plist_offset + plist_size <= size - 512",
    },
    # Checksums of other types, and zero, are not compared.
    {"data_crc32": "CASE WHEN data_checksum_type = 2 THEN nullif(_data_checksum, 0) END", "master_crc32": "CASE WHEN master_checksum_type = 2 THEN nullif(_master_checksum, 0) END"},
    needs=("size",),
)

SPARSEIMAGE_BLOCK = 4096
SPARSEIMAGE = Layout(
    "image.sparseimage",
    {"magic": (0, 4, "ascii"), "format_version": (4, 4, "be"), "band_sectors": (8, 4, "be"), "sector_count": (16, 4, "be")},
    {
        "magic": "magic = 'sprs'", "band_sectors": "band_sectors > 0", "sector_count": "sector_count > 0", "band_array": f"64 + band_count * 4 <= {SPARSEIMAGE_BLOCK}",
        "padding": lambda: F.expr("substring(data, CAST(65 + least(band_count, 1008) * 4 AS INT))") == F.substring(F.lit(bytes(SPARSEIMAGE_BLOCK)), F.lit(1), F.expr(f"CAST({SPARSEIMAGE_BLOCK} - 64 - least(band_count, 1008) * 4 AS INT)")),
    },
    {"band_count": "CAST(ceil(sector_count / nullif(band_sectors, 0)) AS BIGINT)", "media_size": "sector_count * 512"},
)

PDI_SPARSE = Layout(
    "image.pdi",
    {"block_sectors": (28, 4, "le"), "block_count": (32, 4, "le"), "sector_count": (36, 8, "le"), "data_sector": (48, 4, "le")},
    {
        "block_sectors": "block_sectors > 0", "sector_count": "sector_count = extent_sectors", "bat_range": "data_sector * 512 >= 64 + block_count * 4",
        "data_range": "data_sector * 512 <= size", "block_count": "block_count >= ceil(extent_sectors / nullif(block_sectors, 0))",
    },
    needs=("size", "extent_sectors"),
)

EWF_FILE = Layout(
    "image.ewf",
    {"_signature": (0, 8, "hex"), "_start": (8, 1, "le"), "segment_number": (9, 2, "le"), "_end": (11, 2, "le")},
    {"signature": "signature IS NOT NULL", "markers": "_start = 1 AND _end = 0"},
    {"signature": "CASE _signature WHEN '455646090D0AFF00' THEN 'EVF' WHEN '4C5646090D0AFF00' THEN 'LVF' END"},
)

#: The section types of a segment file.
EWF_SECTIONS = ("data", "digest", "disk", "done", "error2", "hash", "header", "header2", "next", "sectors", "table", "table2", "volume")
EWF_SECTION = Layout(
    "image.ewf-section",
    {"type": (0, 16, "ascii"), "next_offset": (16, 8, "le"), "_size": (24, 8, "le"), "_checksum": (72, 4, "le")},
    {"checksum": lambda: checksums.adler32(F.expr("substring(data, 1, 72)")) == F.col("_checksum"), "advances": "size IS NOT NULL"},
    {
        "known": f"type IN ({', '.join(repr(x) for x in EWF_SECTIONS)})",
        # A last section without a size is its descriptor alone; others reach to the next one.
        "size": "CASE WHEN _size > 0 THEN _size WHEN type IN ('done', 'next') THEN 76 WHEN next_offset > file_offset THEN next_offset - file_offset END",
    },
    needs=("file_offset",),
)

# --- volumes and file systems --------------------------------------------------------------------------------------

APM_DRIVER = Layout(
    "volume.apm",
    {"signature": (0, 2, "ascii"), "block_size": (2, 2, "be"), "block_count": (4, 4, "be"), "device_type": (8, 2, "be"), "device_identifier": (10, 2, "be"), "device_data": (12, 4, "be"), "drivers": (16, 2, "be")},
    {"signature": "signature = 'ER'", "drivers": "drivers <= 61"},
)

APM_ENTRY = Layout(
    "volume.apm-entry",
    {
        "signature": (0, 2, "ascii"), "map_entries": (4, 4, "be"), "start_block": (8, 4, "be"), "block_count": (12, 4, "be"), "name": (16, 32, "ascii"), "type_code": (48, 32, "ascii"),
        "data_start": (80, 4, "be"), "data_blocks": (84, 4, "be"), "status": (88, 4, "be"), "boot_start": (92, 4, "be"), "boot_blocks": (96, 4, "be"), "boot_address": (100, 4, "be"),
        "boot_entry": (108, 4, "be"), "boot_checksum": (116, 4, "be"), "processor": (120, 16, "ascii"),
    },
    {"signature": "signature = 'PM'", "block_count": "block_count > 0"},
)

#: Fixed value: what the label's checksum starts from.
LVM_CHECKSUM_START = 0xF597A6CF
LVM_LABEL = Layout(
    "volume.lvm",
    {"signature": (0, 8, "ascii"), "sector": (8, 8, "le"), "_checksum": (16, 4, "le"), "type": (24, 8, "ascii"), "pv_id": (32, 32, "ascii")},
    {
        "signature": "signature = 'LABELONE'", "type": "type = 'LVM2 001'", "sector": "sector * 512 <= label_offset",
        "checksum": lambda: (F.col("_checksum") == 0) | (checksums.weak_crc32(LVM_CHECKSUM_START)(F.expr("substring(data, 21, 492)")) == F.col("_checksum")),
    },
    {"pv_offset": "label_offset - sector * 512"},
    needs=("label_offset",),
)

_GEOMETRY = {"bytes_per_sector": (11, 2, "le"), "sectors_per_cluster": (13, 1, "le")}
BITLOCKER_SIGNATURES = {"2D4656452D46532D": "Fixed", "4D5357494E342E31": "ToGo"}
BITLOCKER = Layout(
    "volume.bitlocker",
    {
        **_GEOMETRY, "_oem": (3, 8, "hex"), "_total16": (19, 2, "le"), "_total32": (32, 4, "le"), "_total64": (40, 8, "le"), "_lcn": (56, 8, "le"),
        **{f"_fixed{i}": (176 + 8 * i, 8, "le") for i in range(3)}, **{f"_togo{i}": (440 + 8 * i, 8, "le") for i in range(3)},
    },
    {"flavor": "flavor IS NOT NULL", "geometry": "bytes_per_sector > 0 AND sectors_per_cluster > 0", "metadata": "exists(metadata_offsets, x -> x > 0)"},
    {
        "flavor": "CASE _oem " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BITLOCKER_SIGNATURES.items()) + " END",
        "volume_size": "coalesce(nullif(_total16, 0), nullif(_total32, 0), _total64) * bytes_per_sector",
        "_direct": "IF(flavor = 'ToGo', array(_togo0, _togo1, _togo2), array(_fixed0, _fixed1, _fixed2))",
        # Older fixed volumes name the metadata's cluster instead.
        "metadata_offsets": "IF(flavor = 'Fixed' AND NOT exists(_direct, x -> x > 0), array(_lcn * bytes_per_sector * sectors_per_cluster, 0, 0), _direct)",
        "version": "CASE WHEN flavor = 'ToGo' THEN 84 WHEN exists(_direct, x -> x > 0) THEN 7 ELSE 6 END",
    },
)

EXT = Layout(
    "filesystem.ext",
    {
        "_low": (4, 4, "le"), "first_data_block": (20, 4, "le"), "_log": (24, 4, "le"), "blocks_per_group": (32, 4, "le"), "inodes_per_group": (40, 4, "le"), "_magic": (56, 2, "hex"),
        "inode_size": (88, 2, "le"), "compatible": (92, 4, "le"), "incompatible": (96, 4, "le"), "readonly": (100, 4, "le"), "_descriptor": (254, 2, "le"), "_high": (336, 4, "le"),
    },
    {
        "magic": "_magic = '53EF'", "block_size": "block_size >= 1024", "blocks": "blocks > 0", "groups": "blocks_per_group > 0 AND inodes_per_group > 0",
        "inode_size": "inode_size >= 128", "descriptor_size": "descriptor_size >= 32",
    },
    {
        "block_size": "CASE WHEN _log <= 21 THEN shiftleft(1024L, CAST(_log AS INT)) END", "blocks": "CAST(_low AS DECIMAL(20,0)) + IF((incompatible & 128) <> 0, _high, 0) * 4294967296BD",
        "variant": "CASE WHEN (incompatible & 64) <> 0 THEN 'ext4' WHEN (compatible & 4) <> 0 THEN 'ext3' ELSE 'ext2' END",
        "descriptor_size": "IF((incompatible & 128) <> 0, _descriptor, 32)", "groups": "try_cast(ceil(blocks / nullif(blocks_per_group, 0)) AS BIGINT)",
        "descriptors_offset": "IF(block_size = 1024, 2048, block_size)",
    },
)

NTFS = Layout(
    "filesystem.ntfs",
    {
        **_GEOMETRY, "_jump": (0, 3, "hex"), "oem": (3, 8, "ascii"), "_reserved": (14, 2, "le"), "total_sectors": (40, 8, "le"), "mft_cluster": (48, 8, "le"), "mirror_cluster": (56, 8, "le"),
        "_record": (64, 1, "le"), "_index": (68, 1, "le"), "serial": (72, 8, "le"), "_boot": (510, 2, "hex"),
    },
    {
        "jump": "_jump LIKE 'E9%' OR (_jump LIKE 'EB__90')", "boot": "_boot = '55AA'", "oem": "oem = 'NTFS    '", "sector_size": "bytes_per_sector IN (512, 1024, 2048, 4096)",
        "cluster": power_of_two("sectors_per_cluster"), "reserved": "_reserved = 0", "sizes": "total_sectors > 0 AND mft_cluster > 0 AND mirror_cluster > 0 AND _record > 0 AND _index > 0",
    },
    {
        "cluster_size": "bytes_per_sector * sectors_per_cluster", "total_size": "total_sectors * bytes_per_sector", "mft_offset": "mft_cluster * cluster_size",
        # Up to 127: that many clusters; above: two to the power of 256 less the value.
        "record_size": "IF(_record < 128, _record * cluster_size, CASE WHEN _record > 193 THEN shiftleft(1L, CAST(256 - _record AS INT)) END)",
        "index_size": "IF(_index < 128, _index * cluster_size, CASE WHEN _index > 193 THEN shiftleft(1L, CAST(256 - _index AS INT)) END)",
    },
)

XFS = Layout(
    "filesystem.xfs",
    {
        "magic": (0, 4, "ascii"), "block_size": (4, 4, "be"), "root_inode": (56, 8, "be"), "group_blocks": (84, 4, "be"), "group_count": (88, 4, "be"), "_version": (100, 2, "be"),
        "sector_size": (102, 2, "be"), "inode_size": (104, 2, "be"), "inodes_per_block": (106, 2, "be"), "inodes_log": (123, 1, "be"), "group_log": (124, 1, "be"), "_dirlog": (192, 1, "be"),
    },
    {
        "magic": "magic = 'XFSB'", "version": "format_version IN (4, 5)", "sector_size": "sector_size BETWEEN 512 AND 32768", "block_size": "block_size BETWEEN 512 AND 65536",
        "inode_size": "inode_size BETWEEN 256 AND 2048", "groups": "group_blocks >= 5 AND group_count > 0", "group_log": "group_log BETWEEN 1 AND 31",
        "inodes_log": "inodes_log BETWEEN 1 AND 32 - group_log AND group_log + inodes_log < 32", "inodes_per_block": "shiftleft(1L, CAST(least(inodes_log, 62) AS INT)) = inodes_per_block",
    },
    {"format_version": "_version & 15", "directory_block": "CASE WHEN _dirlog <= 31 THEN shiftleft(block_size, CAST(_dirlog AS INT)) END"},
)

LAYOUTS = {x.format_id: x for x in (QCOW, VHD_FOOTER, VHD_DYNAMIC, VHDX_HEADER, VMDK_SPARSE, VMDK_COWD, UDIF_TRAILER, SPARSEIMAGE, PDI_SPARSE, EWF_FILE, EWF_SECTION, APM_DRIVER, APM_ENTRY, LVM_LABEL, BITLOCKER, EXT, NTFS, XFS)}

# --- tables behind a header ----------------------------------------------------------------------------------------


def footer_override(headers: DataFrame, footers: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, primary_directory, from_footer, ok): a grain directory at the end is named by the footer, which must agree with
    the header in everything else that sizes the image; both sides are decoded sparse headers."""
    same = ("capacity_sectors", "grain_sectors", "table_entries", "flags")
    f = footers.filter("ok").select(F.col(key), *(F.col(c).alias(f"_{c}") for c in (*same, "primary_directory")))
    joined = headers.join(f, key, "left")
    agree = F.coalesce(*(F.lit(None),), F.expr(" AND ".join(f"{c} = _{c}" for c in same)), F.lit(False))
    end = F.col("directory_at_end")
    return joined.select(
        key, F.when(end, F.col("_primary_directory")).otherwise(F.col("primary_directory")).alias("primary_directory"), end.alias("from_footer"), (F.col("ok") & (~end | agree)).alias("ok")
    )


def parent_checks(images: DataFrame, key: str, content_id: str, parent_id: str, parent_key: str) -> DataFrame:
    """(key, found, is_self, ok): an image's parent must exist, be another image and have the content id that it expects."""
    p = images.select(F.col(key).alias("_parent"), F.col(content_id).alias("_content"))
    joined = images.filter(F.col(parent_key).isNotNull()).join(p, F.col(parent_key) == F.col("_parent"), "left")
    found, itself = F.col("_parent").isNotNull(), F.col(parent_key) == F.col(key)
    return joined.select(key, found.alias("found"), itself.alias("is_self"), F.coalesce(found & ~itself & (F.col("_content") == F.col(parent_id)), F.lit(False)).alias("ok"))


def table_entries(sources: DataFrame, keys: list[str], data: str, offset: str, count: str, size: int) -> DataFrame:
    """(keys, index, entry): a table of ``count`` entries of ``size`` bytes from ``offset``; entries past the end are short."""
    indexes = F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = sources.select(*dict.fromkeys([*keys, data]), F.col(offset).alias("_at"), F.explode(indexes).alias("index"))
    return rows.select(*keys, "index", F.substring(data, (F.col("_at") + F.col("index") * size + 1).cast("int"), F.lit(size)).alias("entry"))


def band_map(sources: DataFrame, key: str = "source_id", data: str = "head") -> DataFrame:
    """(key, band, file_offset, unique, in_range, in_source): the image's bands that are stored, from the header's array of
    guest numbers (1 based, 0 is sparse). Needs (key, data, size)."""
    image = sources.select(key, "size", F.col(data).alias("_image"))
    header = decode_header(image, SPARSEIMAGE, "_image", (key, "size", "_image")).filter("ok").select(key, "size", "_image", "band_count", (F.col("band_sectors") * 512).alias("band_size"), F.lit(64).alias("_start"))
    rows = table_entries(header, [key, "size", "band_count", "band_size"], "_image", "_start", "band_count", 4)
    placed = rows.select(key, "size", "band_count", "band_size", (uint(F.col("entry"), 0, 4, big=True) - 1).alias("band"), (F.lit(SPARSEIMAGE_BLOCK) + F.col("index") * F.col("band_size")).alias("file_offset"))
    placed = placed.filter("band >= 0")
    twice = placed.groupBy(key, "band").agg(F.count("*").alias("_n"))
    return placed.join(twice, [key, "band"]).select(
        key, "band", "file_offset", (F.col("_n") == 1).alias("unique"), (F.col("band") < F.col("band_count")).alias("in_range"), (F.col("file_offset") + F.col("band_size") <= F.col("size")).alias("in_source")
    )


#: Block types of a disk image's map; other types are comments, and one ends the map.
UDIF_KINDS = {0x00000000: "zero", 0x00000001: "none", 0x00000002: "zero", 0x80000004: "adc", 0x80000005: "zlib", 0x80000006: "bzip2", 0x80000007: "lzfse", 0x80000008: "lzma"}


def udif_blocks(sources: DataFrame, key: str = "source_id", data: str = "block_map") -> DataFrame:
    """(key, ordinal, kind, logical_offset, length, physical_offset, stored_length): the blocks of a map ("mish" table), in bytes;
    sectors are counted from the map's first one and offsets from its data."""
    d = F.col(data)
    head = sources.filter(F.decode(cut(d, 0, 4), "ISO-8859-1") == "mish").select(key, data, uint(d, 8, 8, big=True).alias("_first"), uint(d, 24, 8, big=True).alias("_base"), F.lit(204).alias("_start"), uint(d, 200, 4, big=True).alias("_n"))
    head = head.filter(F.col("_n") * 40 + 204 <= F.length(data))
    rows = table_entries(head, [key, "_first", "_base"], data, "_start", "_n", 40)
    e = F.col("entry")
    names = F.create_map(*(F.lit(x) for kv in UDIF_KINDS.items() for x in kv))
    block = rows.select(key, F.col("index").alias("ordinal"), "_first", "_base", F.try_element_at(names, uint(e, 0, 4, big=True)).alias("kind"), *(uint(e, at, 8, big=True).alias(f"_{at}") for at in (8, 16, 24, 32)))
    stored = F.when(F.col("kind") != "zero", F.col("_base") + F.col("_24"))
    return block.filter("kind IS NOT NULL").select(
        key, "ordinal", "kind", ((F.col("_first") + F.col("_8")) * 512).alias("logical_offset"), (F.col("_16") * 512).alias("length"), stored.alias("physical_offset"), F.when(F.col("kind") != "zero", F.col("_32")).alias("stored_length")
    )


def region_entries(sources: DataFrame, key: str = "source_id", data: str = "region_table") -> DataFrame:
    """(key, index, type_guid, file_offset, length, required, ok): a VHDX region table; a type that occurs twice is not ok."""
    counted = sources.select(key, data, F.lit(16).alias("_start"), F.when(F.decode(cut(F.col(data), 0, 4), "ISO-8859-1") == "regi", uint(F.col(data), 8, 4)).alias("_count"))
    rows = table_entries(counted.filter("_count <= 2047"), [key], data, "_start", "_count", 32)
    e = F.col("entry")
    entry = rows.select(key, "index", guid(e, 0).alias("type_guid"), uint(e, 16, 8).alias("file_offset"), uint(e, 24, 4).alias("length"), uint(e, 28, 4).alias("_required"))
    kinds = entry.groupBy(key, "type_guid").agg(F.count("*").alias("_n"))
    sane = F.expr(f"_n = 1 AND file_offset >= {VHDX_ALIGNMENT} AND file_offset % {VHDX_ALIGNMENT} = 0 AND length > 0 AND length % {VHDX_ALIGNMENT} = 0 AND _required IN (0, 1)")
    return entry.join(kinds, [key, "type_guid"]).select(key, "index", "type_guid", "file_offset", "length", (F.col("_required") == 1).alias("required"), F.coalesce(sane, F.lit(False)).alias("ok"))


def metadata_items(sources: DataFrame, key: str = "source_id", data: str = "metadata") -> DataFrame:
    """(key, index, item_guid, offset, length, is_user, is_virtual_disk, is_required, value, ok): a VHDX metadata table and
    each item's bytes; an item that occurs twice or lies in the table is not ok. An item's bytes are cut where its entry is
    read, so no table is joined or broadcast: only entries are, to count their ids."""
    counted = sources.select(key, data, F.lit(32).alias("_start"), F.when(F.decode(cut(F.col(data), 0, 8), "ISO-8859-1") == "metadata", uint(F.col(data), 10, 2)).alias("_count"))
    rows = table_entries(counted.filter("_count <= 2047"), [key, data], data, "_start", "_count", 32)
    e = F.col("entry")
    ids = rows.select(key, guid(e, 0).alias("item_guid"))
    kinds = ids.groupBy(key, "item_guid").agg(F.count("*").alias("_n"))
    placed = rows.select(key, "index", data, guid(e, 0).alias("item_guid"), uint(e, 16, 4).alias("offset"), uint(e, 20, 4).alias("length"), uint(e, 24, 4).alias("_flags"))
    value = F.substring(data, (F.col("offset") + 1).try_cast("int"), F.col("length").try_cast("int"))
    item = placed.select(key, "index", "item_guid", "offset", "length", "_flags", value.alias("value"), F.length(data).alias("_size"))
    bit = lambda i: (F.getbit("_flags", F.lit(i)) == 1)
    sane = F.expr("_n = 1 AND (length = 0 OR (offset >= 65536 AND offset + length <= _size))")
    return item.join(kinds, [key, "item_guid"]).select(
        key, "index", "item_guid", "offset", "length", bit(0).alias("is_user"), bit(1).alias("is_virtual_disk"), bit(2).alias("is_required"), "value", F.coalesce(sane, F.lit(False)).alias("ok")
    )


#: The keys of a parent locator in the order in which they are tried.
LOCATOR_ORDER = ("relative_path", "absolute_win32_path", "volume_path")


def parent_locator(sources: DataFrame, key: str = "source_id", data: str = "locator") -> DataFrame:
    """(key, entries, candidates): the locator's keys and values (UTF-16) as a map, and the paths to try in order."""
    count = uint(F.col(data), 18, 2)
    entry = lambda i, at, size: uint(F.col(data), (i * 12 + 20 + at).cast("int"), size)
    text = lambda i, at, size: utf16_text(F.substring(F.col(data), (entry(i, at, 4) + 1).cast("int"), entry(i, size, 2).cast("int")))
    indexes = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(indexes, lambda i: F.struct(text(i, 0, 8).alias("key"), text(i, 4, 10).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    entries = sources.select(key, F.map_from_entries(first).alias("entries"))
    return entries.select(key, "entries", F.array_compact(F.array(*(F.try_element_at("entries", F.lit(x)) for x in LOCATOR_ORDER))).alias("candidates"))


def walk_records(data: str, start: str, more: str, size: str) -> Column:
    """The offsets of records that follow each other, from ``start``: while ``more`` holds at the offset ``at``, the next one
    is ``size`` bytes on. Both are SQL on ``at`` and the row's columns; at most one step for each 8 bytes."""
    step = f"IF(s.going AND ({more.replace('at', 's.at')}), struct(s.at + ({size.replace('at', 's.at')}) AS at, array_append(s.found, s.at) AS found, true AS going), struct(s.at AS at, s.found AS found, false AS going))"
    return F.expr(f"aggregate(sequence(0, greatest(0, length({data}) div 8)), struct(CAST({start} AS BIGINT) AS at, CAST(array() AS ARRAY<BIGINT>) AS found, true AS going), (s, i) -> {step}, s -> s.found)")


def _be(data: str, at: str, size: int) -> str:
    return f"CAST(conv(hex(substring({data}, CAST({at} AS INT) + 1, {size})), 16, 10) AS BIGINT)"


def qcow_extensions(sources: DataFrame, key: str = "source_id", data: str = "head", header_size: str = "header_size") -> DataFrame:
    """(key, ordinal, type, length, value): the typed extensions behind a QCOW header, padded to 8 bytes, up to type 0."""
    kind, length = _be(data, "at", 4), _be(data, "at + 4", 4)
    offsets = walk_records(data, header_size, f"{kind} <> 0 AND at + 8 + {length} <= length({data})", f"8 + (({length} + 7) div 8) * 8")
    rows = sources.select(key, data, F.posexplode(offsets).alias("ordinal", "at"))
    value = F.expr(f"substring({data}, CAST(at + 9 AS INT), CAST({length} AS INT))")
    return rows.select(key, "ordinal", F.expr(kind).alias("type"), F.expr(length).alias("length"), value.alias("value"))


def qcow_snapshots(sources: DataFrame, key: str = "source_id", data: str = "snapshot_table", count: str = "snapshots", virtual_size: str = "virtual_size") -> DataFrame:
    """(key, ordinal, snapshot_id, name, l1_offset, l1_entries, seconds, vm_clock, state_size, disk_size): rows of varying
    length, padded to 8 bytes. A size of 0, or none, is the image's own."""
    id_size, name_size, extra = _be(data, "at + 12", 2), _be(data, "at + 14", 2), _be(data, "at + 36", 4)
    whole = f"((40 + {extra} + {id_size} + {name_size} + 7) div 8) * 8"
    offsets = walk_records(data, "0", f"size(s.found) < {count} AND at + 40 <= length({data})", whole)
    rows = sources.select(key, data, virtual_size, F.posexplode(offsets).alias("ordinal", "at"))
    text = lambda at, size: utf8_text(F.expr(f"substring({data}, CAST({at} AS INT) + 1, CAST({size} AS INT))"))
    stored = F.expr(f"CASE WHEN {extra} >= 16 THEN {_be(data, 'at + 48', 8)} END")
    return rows.select(
        key, "ordinal", text(f"at + 40 + {extra}", id_size).alias("snapshot_id"), text(f"at + 40 + {extra} + {id_size}", name_size).alias("name"), F.expr(_be(data, "at", 8)).alias("l1_offset"),
        F.expr(_be(data, "at + 8", 4)).alias("l1_entries"), F.expr(_be(data, "at + 16", 4)).alias("seconds"), F.expr(_be(data, "at + 24", 8)).alias("vm_clock"),
        F.expr(_be(data, "at + 32", 4)).alias("state_size"), F.coalesce(F.nullif(stored, F.lit(0)), F.col(virtual_size)).cast("long").alias("disk_size"),
    )


def lvm_areas(labels: DataFrame, key: str = "source_id", data: str = "label", base: str = "pv_offset") -> DataFrame:
    """(key, kind, ordinal, offset, size): data areas, then metadata areas of an LVM label; each list ends with a pair of zeros."""
    pair = lambda i: F.struct(uint(F.col(data), (i * 16 + 72).cast("int"), 8).alias("offset"), uint(F.col(data), (i * 16 + 80).cast("int"), 8).alias("size"))
    pairs = once(labels.select(key, F.col(base).alias("_base"), data), {"_pairs": F.transform(F.sequence(F.lit(0), F.lit(26)), pair)}).drop(data)
    end = lambda c: F.array_position(F.transform(c, lambda p: (p["offset"] == 0) & (p["size"] == 0)), True).cast("int")
    cut_ = once(pairs, {"_end": end("_pairs")}).filter("_end > 0")
    rest = once(cut_, {"_rest": F.slice("_pairs", F.col("_end") + 1, F.lit(27))})
    lists = once(rest, {"_end2": end("_rest")}).filter("_end2 > 0").select(
        key, "_base", F.explode(F.map_from_arrays(F.array(F.lit("data"), F.lit("metadata")), F.array(F.slice("_pairs", F.lit(1), F.col("_end") - 1), F.slice("_rest", F.lit(1), F.col("_end2") - 1)))).alias("kind", "_areas")
    )
    areas = lists.select(key, "_base", "kind", F.posexplode("_areas").alias("ordinal", "_area"))
    return areas.select(key, "kind", "ordinal", (F.col("_area.offset") + F.col("_base")).cast("decimal(20,0)").alias("offset"), F.col("_area.size").alias("size"))


#: The tags of reparse points that are links, and of compressed files.
REPARSE_MOUNT, REPARSE_SYMLINK, REPARSE_COMPRESSED = 0xA0000003, 0xA000000C, 0x80000017


def reparse_points(points: DataFrame, key: str = "node_id", data: str = "reparse") -> DataFrame:
    """(key, kind, target, compression, ok): an NTFS reparse point; a link's target is its print name, else its substitute
    name without the prefix of the object namespace."""
    d, tag, size = F.col(data), uint(F.col(data), 0, 4), uint(F.col(data), 4, 2)
    kind = F.when(tag == REPARSE_MOUNT, "MountPoint").when(tag == REPARSE_SYMLINK, "SymbolicLink").when(tag == REPARSE_COMPRESSED, "WofCompressed").otherwise("Other")
    base = F.when(tag == REPARSE_SYMLINK, 12).otherwise(8) + 8
    name = lambda at: utf16_text(F.substring(d, (uint(d, at, 2) + base + 1).cast("int"), uint(d, at + 2, 2).cast("int")))
    inside = lambda at: uint(d, at, 2) + uint(d, at + 2, 2) + base <= size + 8
    link = tag.isin(REPARSE_MOUNT, REPARSE_SYMLINK)
    whole = F.coalesce((size <= F.length(d) - 8) & (~link | (inside(8) & inside(12))) & ((tag != REPARSE_COMPRESSED) | (size >= 16)), F.lit(False))
    target = F.coalesce(F.nullif(name(12), F.lit("")), F.regexp_replace(name(8), r"^\\\?\?\\", ""))
    return points.select(key, F.when(tag.isNotNull(), kind).alias("kind"), F.when(whole & link, target).alias("target"), F.when(whole & (tag == REPARSE_COMPRESSED), uint(d, 20, 4)).alias("compression"), whole.alias("ok"))


def chunk_offsets(entries: DataFrame, key: str, index: str, raw: str) -> DataFrame:
    """Adds ``offset``, ``compressed`` and ``ok`` to the entries of EWF chunk tables (at most 16,375 each, so a table is one window).

    Offsets are 31 bits and the top bit says compressed, until they first seem to fall: if the raw value does not, the rest
    of the table has 32-bit offsets. Any other fall is an error of that entry."""
    w = Window.partitionBy(key).orderBy(index)
    low = F.col(raw).bitwiseAND(F.lit(0x7FFFFFFF))
    seen = entries.withColumn("_low", low).withColumn("_before", F.lag("_low").over(w)).withColumn("_raw_before", F.lag(raw).over(w))
    first = F.min(F.when(F.col("_low") < F.col("_before"), F.col(index))).over(Window.partitionBy(key))
    seen = seen.withColumn("_first", first).withColumn("_over", F.coalesce(F.col(index) >= F.col("_first"), F.lit(False)))
    previous = F.when(F.col(index) > F.col("_first"), F.col("_raw_before")).otherwise(F.col("_before"))
    return seen.select(
        *entries.columns, F.when(F.col("_over"), F.col(raw)).otherwise(F.col("_low")).alias("offset"), (~F.col("_over") & (F.col(raw) > F.col("_low"))).alias("compressed"),
        F.coalesce(~F.col("_over") | (F.col(raw) >= previous), F.lit(True)).alias("ok"),
    )
