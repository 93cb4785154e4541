"""Bytes for the queries: structures built from columns, and small constant heads of every format of the catalogue."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(value: Column | int, size: int) -> Column:
    """A number as big-endian bytes."""
    c = F.lit(value) if isinstance(value, int) else value
    return F.to_binary(F.lpad(F.hex(c.cast("long")), 2 * size, "0"), F.lit("hex"))


def le(value: Column | int, size: int) -> Column:
    """A number as little-endian bytes."""
    c = F.lit(value) if isinstance(value, int) else value
    h = F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    return F.to_binary(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1))), F.lit("hex"))


def padded(value: Column, size: int) -> Column:
    """Bytes or text with zeros behind."""
    return F.substring(F.concat(value.cast("binary"), F.lit(bytes(size))), 1, size)


def blob(total: int, fields: dict[int, tuple[Column | bytes, int]]) -> Column:
    """``total`` bytes with fields (bytes, size) at offsets and zeros between."""
    parts, at = [], 0
    for offset, (value, size) in sorted(fields.items()):
        if offset > at:
            parts.append(F.lit(bytes(offset - at)))
        parts.append(F.lit(value) if isinstance(value, bytes) else value)
        at = offset + size
    if total > at:
        parts.append(F.lit(bytes(total - at)))
    return F.concat(*parts)


def _put(total: int, fields: dict[int, bytes]) -> bytes:
    out = bytearray(total)
    for at, value in fields.items():
        out[at : at + len(value)] = value
    return bytes(out)


def mbr_entry(kind: int, first: int, sectors: int) -> bytes:
    return struct.pack("<B3xB3xII", 0, kind, first, sectors)


def _gpt(block: int) -> bytes:
    header = struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, 1, 99, 34, 90, uuid.UUID(int=7).bytes_le, 2, 8, 128, 0)
    header = header[:16] + struct.pack("<I", zlib.crc32(header)) + header[20:]
    return _put(2 * block, {446: mbr_entry(0xEE, 1, 99), 510: b"\x55\xaa", block: header})


def _tar(magic: bytes) -> bytes:
    head = _put(512, {0: b"name", 100: b"0000644\0", 124: b"00000000000\0", 148: b"        ", 257: magic})
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def _boot(fields: dict[int, bytes]) -> bytes:
    return _put(512, {510: b"\x55\xaa"} | fields)


#: (format, kind, confidence, head, tail, entry name): one for each rule of the catalogue, in its order.
SAMPLES: list[tuple[str, str, str, bytes, bytes, str]] = [
    ("archive.zip", "Archive", "Exact", b"PK\3\4", b"", "a.bin"),
    ("archive.rar", "Archive", "Exact", b"Rar!\x1a\7\1\0", b"", "a.bin"),
    ("archive.7z", "Archive", "Exact", b"7z\xbc\xaf\x27\x1c", b"", "a.bin"),
    ("archive.tar", "Archive", "Exact", _tar(b"ustar\x0000"), b"", "a.bin"),
    ("archive.tar", "Archive", "Likely", _tar(b""), b"", "a.bin"),
    ("archive.ad1", "Archive", "Exact", _put(528, {0: b"ADSEGMENTEDFILE", 512: b"ADLOGICALIMAGE"}), b"", "a.bin"),
    ("image.ewf", "Image", "Exact", b"EVF\t\r\n\xff\0", b"", "a.bin"),
    ("image.qcow", "Image", "Exact", b"QFI\xfb", b"", "a.bin"),
    ("image.vhdx", "Image", "Exact", b"vhdxfile", b"", "a.bin"),
    ("image.vmdk", "Image", "Exact", b"KDMV", b"", "a.bin"),
    ("image.vmdk", "Image", "Exact", b"COWD", b"", "a.bin"),
    ("image.vmdk", "Image", "Exact", b'# Disk DescriptorFile\nversion=1\ncreateType="monolithicFlat"\n', b"", "a.VMDK"),
    ("image.vmdk", "Image", "Likely", b'# Disk DescriptorFile\nversion=1\ncreateType="monolithicFlat"\n', b"", "a.bin"),
    ("image.vhd", "Image", "Exact", b"", _put(512, {0: b"conectix"}), "a.bin"),
    ("image.udif", "Image", "Exact", b"", _put(512, {0: b"koly"}), "a.bin"),
    ("image.sparseimage", "Image", "Exact", b"sprs", b"", "a.bin"),
    ("image.sparsebundle", "Image", "Exact", b'<?xml version="1.0"?><string>com.apple.diskimage.sparsebundle</string>', b"", "with/Info.plist"),
    ("image.sparsebundle", "Image", "Strong", b'<?xml version="1.0"?><string>com.apple.diskimage.sparsebundle</string>', b"", "Info.plist"),
    ("image.pdi", "Image", "Exact", b"<?xml?><Parallels_disk_image><File>disk.hds</File>", b"", "with/Descriptor.xml"),
    ("image.pdi", "Image", "Likely", b"<?xml?><Parallels_disk_image><File>gone.hds</File>", b"", "Descriptor.xml"),
    ("image.splitraw", "Image", "Exact", b"anything", b"", "with/disk.001"),
    ("volume.apm", "VolumeSystem", "Exact", _put(1024, {0: b"ER", 512: b"PM"}), b"", "a.bin"),
    ("volume.gpt", "VolumeSystem", "Exact", _gpt(512), b"", "a.bin"),
    ("volume.gpt", "VolumeSystem", "Exact", _gpt(4096), b"", "a.bin"),
    ("volume.mbr", "VolumeSystem", "Weak", _put(512, {510: b"\x55\xaa"}), b"", "a.bin"),
    ("volume.lvm", "VolumeManager", "Exact", _put(1024, {512: b"LABELONE", 536: b"LVM2 001"}), b"", "a.bin"),
    ("volume.bitlocker", "VolumeManager", "Exact", _boot({3: b"-FVE-FS-", 11: struct.pack("<HB", 512, 8), 176: struct.pack("<Q", 65536)}), b"", "a.bin"),
    ("filesystem.fat", "FileSystem", "Strong", _boot({11: struct.pack("<HBHBHHBHHHII", 512, 1, 1, 2, 512, 4000, 0xF8, 12, 0, 0, 0, 0)}), b"", "a.bin"),
    ("filesystem.refs", "FileSystem", "Strong", _put(512, {3: b"ReFS", 16: b"FSRS", 24: struct.pack("<QIIBB", 1000, 512, 128, 3, 4)}), b"", "a.bin"),
    ("filesystem.ntfs", "FileSystem", "Exact", _boot({0: b"\xeb\x52\x90NTFS    ", 11: struct.pack("<HB", 512, 8), 40: struct.pack("<QQQBxxxB", 10_000, 4, 2, 246, 1)}), b"", "a.bin"),
    ("filesystem.ext", "FileSystem", "Exact", _put(2048, {1024 + 4: struct.pack("<I", 4096), 1024 + 24: struct.pack("<I", 2), 1024 + 32: struct.pack("<III", 8192, 0, 2048), 1024 + 56: b"\x53\xef", 1024 + 88: struct.pack("<H", 256)}), b"", "a.bin"),
    ("filesystem.xfs", "FileSystem", "Exact", _put(512, {0: b"XFSB" + struct.pack(">I", 4096), 84: struct.pack(">II", 1000, 4), 100: struct.pack(">HHHH", 5, 512, 512, 8), 123: bytes([3, 10])}), b"", "a.bin"),
    ("filesystem.apfs", "FileSystem", "Exact", _put(512, {32: b"NXSB" + struct.pack("<IQ", 4096, 1000)}), b"", "a.bin"),
    ("filesystem.hfs", "FileSystem", "Exact", _put(1100, {1024: b"BD"}), b"", "a.bin"),
    ("filesystem.hfsplus", "FileSystem", "Exact", _put(1100, {1024: b"HX"}), b"", "a.bin"),
    ("filesystem.squashfs", "FileSystem", "Exact", b"hsqs" + bytes(92), b"", "a.bin"),
    ("filesystem.cramfs", "FileSystem", "Exact", _put(64, {0: struct.pack("<I", 0x28CD3D45), 16: b"Compressed ROMFS"}), b"", "a.bin"),
    ("filesystem.jffs2", "FileSystem", "Exact", b"\x19\x85", b"", "a.bin"),
    ("filesystem.ffs", "FileSystem", "Exact", _put(9000, {8192 + 0x21C: struct.pack("<I", 0x011954)}), b"", "a.bin"),
    ("filesystem.qnxfs", "FileSystem", "Exact", _put(600, {512: b"/"}), b"", "a.bin"),
    ("filesystem.clfs", "FileSystem", "Exact", _put(4096, {4: b"\x08\0", 0x48: struct.pack("<Q", 0xC1F5C1F500005F1C)}), b"", "a.bin"),
]
#: Files that the samples in folder ``with`` name.
RELATED = ("with/bands/0", "with/disk.hds", "with/disk.002")
