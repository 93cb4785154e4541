"""Decoders on structures built here."""

import struct
import uuid
import zlib

from strataspark.operators import decode, volumes
from strataspark.sources import blobs


def mbr(entries):
    table = b"".join(struct.pack("<B3xB3xII", 0x80 * (i == 0), kind, first, n) for i, (kind, first, n) in enumerate(entries)).ljust(64, b"\0")
    return bytes(446) + table + b"\x55\xaa"


def gpt(entries, damage=False):
    rows = b"".join(uuid.UUID(kind).bytes_le + uuid.UUID(int=i + 1).bytes_le + struct.pack("<QQQ", a, b, 0) + name.encode("utf-16-le").ljust(72, b"\0") for i, (kind, a, b, name) in enumerate(entries)).ljust(128 * 8, b"\0")
    def header(crc):
        return struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, crc, 0, 1, 99, 34, 90, uuid.UUID(int=7).bytes_le, 2, 8, 128, zlib.crc32(rows))
    head = header(zlib.crc32(header(0)) ^ damage)
    return mbr([(0xEE, 1, 99)]) + head.ljust(512, b"\0") + rows


def test_mbr_entries_and_roles(spark):
    d = spark.createDataFrame([(1, bytearray(mbr([(7, 63, 100), (5, 200, 50), (0, 9, 9)]))), (2, bytearray(b"\0" * 512)), (3, None), (4, bytearray(b"x"))], "source_id long, head binary")
    got = sorted(map(tuple, decode.mbr_partitions(d).collect()))
    assert got == [(1, 0, 63 * 512, 51_200, "07", "Primary"), (1, 1, 200 * 512, 25_600, "05", "Extended")]


def test_gpt_entries_need_both_checksums(spark):
    kind = "c12a7328-f81f-11d2-ba4b-00a0c93ec93b"
    parts = [(kind, 34, 40, "Größe"), (kind, 39, 50, "second")]
    d = spark.createDataFrame([(1, bytearray(gpt(parts))), (2, bytearray(gpt(parts, damage=True))), (3, bytearray(5)), (4, None)], "source_id long, head binary")
    got = decode.gpt_partitions(d).orderBy("index").collect()
    assert [(r["source_id"], r["index"], r["byte_offset"], r["byte_size"], r["type_code"], r["name"]) for r in got] == [
        (1, 0, 34 * 512, 7 * 512, kind, "Größe"), (1, 1, 39 * 512, 12 * 512, kind, "second")]
    assert {r["source_id"]: r["ok"] for r in decode.gpt_header(d).collect()} == {1: True, 2: False, 3: False, 4: False}
    spans = decode.gpt_partitions(d).selectExpr("source_id", "index", "byte_offset AS start", "byte_offset + byte_size AS end")
    assert [tuple(r) for r in volumes.overlapping_neighbours(spans, "source_id", "index").collect()] == [(1, 0, 1)]


def test_fat_variants_follow_from_clusters(spark):
    def boot(total, per_cluster, fat_size):
        return bytes(11) + struct.pack("<HBHBHHBHHHII", 512, per_cluster, 1, 2, 512, 0, 0xF8, fat_size, 0, 0, 0, total) + bytes(474) + b"\x55\xaa"
    rows = [(1, bytearray(boot(4000, 1, 12))), (2, bytearray(boot(60_000, 1, 200))), (3, bytearray(boot(2_000_000, 1, 9000))), (4, bytearray(512)), (5, None)]
    got = {r["source_id"]: (r["variant"], r["ok"]) for r in decode.fat_boot_sector(spark.createDataFrame(rows, "source_id long, head binary")).collect()}
    assert got == {1: ("FAT12", True), 2: ("FAT16", True), 3: ("FAT32", True), 4: (None, False), 5: (None, False)}


def test_ones_complement_sum(spark):
    body = bytes(range(64)) + bytes(4) + bytes(range(100, 128))
    good = body[:64] + struct.pack(">I", 0xFFFFFFFF - sum(body)) + body[68:]
    d = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(body))], "i int, b binary")
    assert [r[0] for r in d.orderBy("i").select(decode.ones_complement_ok(d["b"], 96, 64)).collect()] == [True, False]


def test_blobs_windows_and_siblings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/disk.001").write_bytes(bytes(range(10)))
    (tmp_path / "a/other").write_bytes(b"x")
    s = blobs.blob_sources(spark, str(tmp_path))
    assert sorted((r["entry_name"], r["extension"], r["size"]) for r in s.collect()) == [("disk.001", "001", 10), ("other", "", 1)]
    assert [(r["window_offset"], bytes(r["bytes"])) for r in blobs.windows(s.filter("size > 1"), "entry_name", 4).orderBy("window_offset").collect()] == [(0, bytes(range(4))), (4, bytes(range(4, 8))), (8, bytes([8, 9]))]
    assert {bytes(r["tail"]) for r in blobs.heads(s).collect()} == {bytes(range(10)), b"x"}
    parent = s.first()["parent_path"]
    asked = spark.createDataFrame([(1, "Backing", parent, "x/disk.001"), (2, "Backing", parent, "disk.001"), (3, "Extent", parent, "gone")], "request_id long, purpose string, parent_path string, relative_path string")
    got = {r["request_id"]: r["resolved"] and r["resolved"].rsplit("/", 1)[1] for r in blobs.related_sources(asked, s).collect()}
    assert got == {1: "disk.001", 2: "disk.001", 3: None}
