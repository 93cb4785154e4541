"""The catalogue of signatures, and what probes need to know of a source besides its first and last bytes.

Sources have (source_id, logical_path, parent_path, entry_name, extension, size, head, tail, far), the bytes BINARY, as
``blobs.heads`` gives them. ``probe_sources`` adds what the rules test: header layouts as booleans, and whether related
sources exist, by semi joins on paths. Then probing is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.checksums import byte_sum
from strataspark.functions.descriptors import element_text, first_and_next_segment
from strataspark.operators import headers
from strataspark.operators.decode import MBR_PROTECTIVE, field, uint
from strataspark.operators.probe import Signature

#: Texts that descriptors start with and contain.
XML_START, PDI_ROOT, BUNDLE_TYPE = b"<?xml", b"<Parallels_disk_image", b"com.apple.diskimage.sparsebundle"
FIRST_BAND = "bands/0"
#: The types that a text descriptor of an image may have.
VMDK_TYPE = r'(?m)^\s*createType\s*=\s*"[^"]+"'
DESCRIPTOR_BYTES = 128 * 1024
GPT_BLOCKS = (512, 1024, 2048, 4096, 8192, 16384, 32768)


def _col(name: str):  # noqa: ANN202
    return lambda: F.col(name)


def _u(at: int, size: int, big: bool = False) -> Column:
    return uint(F.col("head"), at, size, big)


def _ffs() -> Column:
    near = [F.hex(field(F.col("head"), at + 0x21C, 4)) for at in (0, 8192)]
    far = [F.hex(F.try_element_at("far", F.lit(at + 0x21C))) for at in (65_536, 262_144)]
    return F.exists(F.array(*near, *far), lambda x: x.isin("54190100", "19015419"))


SIGNATURES = [
    *(Signature("archive.zip", "Archive", x, "Exact", variant=i > 0) for i, x in enumerate((b"PK\3\4", b"PK\5\6", b"PK\7\x08"))),
    *(Signature("archive.rar", "Archive", x, "Exact", variant=i > 0) for i, x in enumerate((b"Rar!\x1a\7\0", b"Rar!\x1a\7\1\0"))),
    Signature("archive.7z", "Archive", b"7z\xbc\xaf\x27\x1c", "Exact"),
    Signature("archive.tar", "Archive", b"", "Exact", test=lambda: F.col("is_tar") & (field(F.col("head"), 257, 5) == b"ustar")),
    Signature("archive.tar", "Archive", b"", "Likely", test=lambda: F.col("is_tar") & (field(F.col("head"), 257, 5) != b"ustar"), variant=True),
    Signature("archive.ad1", "Archive", b"", "Exact", test=lambda: (F.col("size") >= 528) & (field(F.col("head"), 0, 15) == b"ADSEGMENTEDFILE") & (field(F.col("head"), 512, 14) == b"ADLOGICALIMAGE")),
    *(Signature("image.ewf", "Image", x, "Exact", variant=i > 0) for i, x in enumerate((b"EVF\t\r\n\xff\0", b"LVF\t\r\n\xff\0"))),
    Signature("image.qcow", "Image", b"QFI\xfb", "Exact"),
    Signature("image.vhdx", "Image", b"vhdxfile", "Exact"),
    Signature("image.vmdk", "Image", b"KDMV", "Exact"),
    Signature("image.vmdk", "Image", b"COWD", "Exact"),
    Signature("image.vmdk", "Image", b"", "Exact", test=lambda: F.col("is_vmdk_text") & (F.lower("extension") == "vmdk")),
    Signature("image.vmdk", "Image", b"", "Likely", test=lambda: F.col("is_vmdk_text") & (F.coalesce(F.lower("extension"), F.lit("")) != "vmdk"), variant=True),
    Signature("image.vhd", "Image", b"conectix", "Exact", -512),
    Signature("image.udif", "Image", b"koly", "Exact", -512),
    Signature("image.sparseimage", "Image", b"sprs", "Exact"),
    Signature("image.sparsebundle", "Image", b"", "Exact", test=lambda: F.col("is_bundle") & F.col("has_related")),
    Signature("image.sparsebundle", "Image", b"", "Strong", test=lambda: F.col("is_bundle") & ~F.col("has_related"), variant=True),
    Signature("image.pdi", "Image", b"", "Exact", test=lambda: F.col("is_pdi") & F.col("has_related")),
    Signature("image.pdi", "Image", b"", "Likely", test=lambda: F.col("is_pdi") & ~F.col("has_related"), variant=True),
    Signature("image.splitraw", "Image", b"", "Exact", test=_col("has_next_segment")),
    Signature("volume.apm", "VolumeSystem", b"", "Exact", test=lambda: (field(F.col("head"), 0, 2) == b"ER") & (field(F.col("head"), 512, 2) == b"PM")),
    Signature("volume.gpt", "VolumeSystem", b"", "Exact", test=_col("is_gpt")),
    Signature("volume.mbr", "VolumeSystem", b"\x55\xaa", "Weak", 510),
    Signature("volume.lvm", "VolumeManager", b"", "Exact", test=_col("is_lvm")),
    Signature("volume.bitlocker", "VolumeManager", b"", "Exact", test=_col("is_bitlocker")),
    Signature("filesystem.fat", "FileSystem", b"", "Strong", test=_col("is_fat")),
    Signature("filesystem.refs", "FileSystem", b"", "Strong", test=_col("is_refs")),
    Signature("filesystem.ntfs", "FileSystem", b"", "Exact", test=_col("is_ntfs")),
    Signature("filesystem.ext", "FileSystem", b"", "Exact", test=_col("is_ext")),
    Signature("filesystem.xfs", "FileSystem", b"", "Exact", test=_col("is_xfs")),
    Signature("filesystem.apfs", "FileSystem", b"", "Exact", test=_col("is_apfs")),
    Signature("filesystem.hfs", "FileSystem", b"BD", "Exact", 1024),
    *(Signature("filesystem.hfsplus", "FileSystem", x, "Exact", 1024, variant=i > 0) for i, x in enumerate((b"H+", b"HX"))),
    # At either end: the one is where the superblock is, the other where probes of this kind also look.
    *(Signature("filesystem.squashfs", "FileSystem", b"hsqs", "Exact", at, variant=i > 0) for i, at in enumerate((0, -96))),
    Signature("filesystem.cramfs", "FileSystem", b"", "Exact", test=lambda: (_u(0, 4) == 0x28CD3D45) & (field(F.col("head"), 16, 16) == b"Compressed ROMFS")),
    Signature("filesystem.jffs2", "FileSystem", b"", "Exact", test=lambda: _u(0, 2, big=True).isin(0x1985, 0x1984)),
    Signature("filesystem.ffs", "FileSystem", b"", "Exact", test=_ffs),
    Signature("filesystem.qnxfs", "FileSystem", b"/" + bytes(15), "Exact", 512),
    Signature("filesystem.vmfs", "FileSystem", b"", "Exact", test=lambda: F.hex(F.try_element_at("far", F.lit(0x200000))).isin("5EF1AB2F", "5FF1AB2F", "60F1AB2F", "61F1AB2F")),
    Signature("filesystem.clfs", "FileSystem", b"", "Exact", test=lambda: _u(4, 2).between(4, 64) & (_u(4, 2) * 512 <= F.col("size")) & (F.hex(field(F.col("head"), 0x48, 8)) == "1C5F0000F5C1F5C1")),
]

REFS = headers.Layout(
    "filesystem.refs",
    {"_one": (3, 4, "ascii"), "_two": (16, 4, "ascii"), "sectors": (24, 8, "le"), "bytes_per_sector": (32, 4, "le"), "sectors_per_block": (36, 4, "le"), "major": (40, 1, "le")},
    {"signatures": "_one = 'ReFS' AND _two = 'FSRS'", "sector_size": "bytes_per_sector IN (256, 512, 1024, 2048, 4096)", "block_size": "bytes_per_sector * sectors_per_block IN (4096, 65536)", "version": "major IN (1, 3)"},
)
APFS = headers.Layout(
    "filesystem.apfs",
    {"_magic": (32, 4, "ascii"), "block_size": (36, 4, "le"), "blocks": (40, 8, "le")},
    {"magic": "_magic = 'NXSB'", "block_size": "block_size BETWEEN 4096 AND 65536 AND " + headers.power_of_two("block_size"), "blocks": "blocks > 0"},
)


def _flag(sources: DataFrame, layout: headers.Layout, data: Column, name: str) -> DataFrame:
    """Adds whether the layout holds: its fields come and go under names that no source has."""
    kept = [F.col(c).alias(f"source.{c}") for c in sources.columns]
    wide = sources.select(*kept, data.alias("head"), *(F.col(c) for c in layout.needs))
    out = headers.decode_header(wide, layout, "head", tuple(f"`source.{c}`" for c in sources.columns))
    return out.select(*(F.col(f"`source.{c}`").alias(c) for c in sources.columns), F.col("ok").alias(name))


def tar_header(head: Column) -> Column:
    """Whether the first 512 bytes are a tar header: the octal checksum is the sum of all bytes, its own field as spaces."""
    text = F.regexp_extract(F.decode(field(head, 148, 8), "ISO-8859-1"), r"^[ \x00]*([0-7]{1,7})[ \x00]", 1)
    asked = (F.length(head) >= 512) & (text != "")
    sums = byte_sum(F.when(asked, F.concat(field(head, 0, 148), F.lit(b" " * 8), field(head, 156, 356))))
    return F.coalesce(F.when(asked, sums == F.conv(text, 8, 10).cast("long")), F.lit(False))


def gpt_primary(head: Column) -> Column:
    """Whether there is a protective table and, at one of the block sizes, a header with its checksum."""
    protective = F.exists(F.array(*(F.hex(field(head, 446 + 16 * i + 4, 1)) for i in range(4))), lambda x: x == MBR_PROTECTIVE) & (F.hex(field(head, 510, 2)) == "55AA")

    def header(block: int) -> Column:
        size = uint(head, block + 12, 4)
        sane = size.between(92, block)
        body = F.concat(field(head, block, 16), F.lit(bytes(4)), F.substring(head, F.lit(block + 21), (F.when(sane, size).otherwise(92) - 20).cast("int")))
        return (field(head, block, 8) == b"EFI PART") & sane & (uint(head, block + 8, 4) == 0x10000) & (uint(head, block + 84, 4) >= 128) & (F.crc32(body) == uint(head, block + 16, 4))

    found = header(GPT_BLOCKS[0])
    for block in GPT_BLOCKS[1:]:
        found = F.coalesce(found, F.lit(False)) | F.coalesce(header(block), F.lit(False))
    return F.coalesce(protective & found, F.lit(False))


def with_related(sources: DataFrame, path: Column, name: str) -> DataFrame:
    """Adds whether a source stands at the path that each row names; null paths have none. One join on the path, in which rows
    that name none are dealt by their own path, with a mark that no path has, and not all to one task."""
    path = F.coalesce(path, F.concat(F.lit("\u0000"), F.col("logical_path")))
    known = sources.select(F.col("logical_path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    return sources.withColumn("_wanted", path).join(known, F.col("_wanted") == F.col("_path"), "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_wanted", "_path", "_there")


def probe_sources(sources: DataFrame) -> DataFrame:
    """The sources with what the catalogue's rules test."""
    head = F.col("head")
    text = F.when(F.col("size") <= DESCRIPTOR_BYTES, F.decode(head, "ISO-8859-1"))
    xml = F.startswith(head, F.lit(XML_START))
    out = sources.withColumns(
        {
            "is_bundle": F.coalesce(xml & F.contains(head, F.lit(BUNDLE_TYPE)), F.lit(False)),
            "is_pdi": F.coalesce(xml & F.contains(head, F.lit(PDI_ROOT)), F.lit(False)),
            "is_vmdk_text": F.coalesce(text.rlike(r"^\s*# Disk DescriptorFile") & text.rlike(VMDK_TYPE), F.lit(False)),
            "is_tar": tar_header(head),
            "is_gpt": gpt_primary(head),
        }
    )
    file = F.regexp_extract(F.decode(head, "ISO-8859-1"), r"<File>\s*([^<]*?)\s*</File>", 1)
    related = F.when(F.col("is_bundle"), F.lit(FIRST_BAND)).when(F.col("is_pdi") & (file != ""), file)
    for layout, data, name in (
        (headers.NTFS, head, "is_ntfs"), (headers.EXT, F.substring("head", 1025, 1024), "is_ext"), (headers.XFS, head, "is_xfs"), (headers.BITLOCKER, F.substring("head", 1, 512), "is_bitlocker"),
        (REFS, F.substring("head", 1, 512), "is_refs"), (APFS, head, "is_apfs"),
    ):
        out = _flag(out, layout, data, name)
    out = out.withColumn("is_fat", fat_geometry(head)).withColumn("is_lvm", lvm_label(head))
    following = first_and_next_segment(F.col("entry_name"))
    beside = lambda name: F.when(name.isNotNull(), F.concat_ws("/", F.col("parent_path"), name))
    return with_related(with_related(out, beside(related), "has_related"), beside(following), "has_next_segment")


def fat_geometry(head: Column) -> Column:
    sector, per_cluster, reserved, fats = (uint(head, at, n) for at, n in ((11, 2), (13, 1), (14, 2), (16, 1)))
    sane = sector.isin(512, 1024, 2048, 4096) & per_cluster.isin(1, 2, 4, 8, 16, 32, 64, 128) & (reserved > 0) & fats.between(1, 2) & (F.hex(field(head, 510, 2)) == "55AA")
    sectors = F.when(uint(head, 19, 2) > 0, uint(head, 19, 2)).otherwise(uint(head, 32, 4))
    fat_size = F.when(uint(head, 22, 2) > 0, uint(head, 22, 2)).otherwise(uint(head, 36, 4))
    return F.coalesce(sane & (fat_size > 0) & (sectors > reserved + fats * fat_size), F.lit(False))


def lvm_label(head: Column) -> Column:
    """Whether one of the first four sectors is a label; where labels are written."""
    return F.coalesce(F.exists(F.array(*(F.concat(field(head, 512 * i, 8), field(head, 512 * i + 24, 8)) for i in range(4))), lambda x: x == b"LABELONELVM2 001"), F.lit(False))


def descriptor_file(xml: Column) -> Column:
    """The image file that a disk descriptor names first."""
    return element_text(xml, "//File")
