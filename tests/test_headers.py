"""Layouts, partition tables, chains and bytes functions on structures built here, on short and malformed bytes, and on nothing."""

import bz2
import datetime
import lzma
import struct
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import checksums, descriptors, text
from strataspark.operators import chains, extents, headers, namespace, partitions, probe, signatures, versions, volumes
from strataspark.plans.samples import SAMPLES, mbr_entry
from strataspark.sources import blobs

ODD = [bytearray(), bytearray(b"\xff" * 7), bytearray(b"\xff" * 3000), None]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sources(spark, *data):
    return spark.createDataFrame([(i, len(b or b""), b if b is None else bytearray(b)) for i, b in enumerate(data)], "source_id long, size long, bytes binary")


@pytest.mark.parametrize("name", sorted(headers.LAYOUTS))
def test_layouts_reject_short_and_odd_bytes(spark, name):
    layout = headers.LAYOUTS[name]
    d = spark.createDataFrame([(i, 10, x) for i, x in enumerate(ODD)], "source_id long, size long, head binary")
    d = d.withColumns({c: F.lit(1).cast("long") for c in layout.needs if c != "size"})
    got = headers.decode_header(d, layout).collect()
    assert len(got) == len(ODD) and not any(r["ok"] for r in got) and all(r["failed"] for r in got)
    assert headers.decode_header(d.limit(0), layout).count() == 0
    assert {r["check_name"].rsplit(".", 1)[1] for r in headers.header_checks(d, layout).collect()} == set(layout.rules)


def test_every_rule_of_the_catalogue_has_a_sample():
    assert {(s.format_id, s.kind) for s in signatures.SIGNATURES} - {(f, k) for f, k, *_ in SAMPLES} == {("filesystem.vmfs", "FileSystem")}
    indexes = [i for i, _ in probe.inventory(signatures.SIGNATURES)]
    assert indexes == sorted(indexes) and indexes[-1] + 1 == len(set(indexes))


def test_probing_of_files(spark, tmp_path):
    """Head, tail, far places and siblings of real files; what is nothing has no match."""
    (tmp_path / "d").mkdir()
    files = {"a.img": b"conectix".ljust(600, b"\0")[88:] + b"conectix".ljust(512, b"\0"), "b.001": b"x", "b.002": b"y", "vmfs": bytes(0x200000) + struct.pack("<I", 0x2FABF15E), "none": b"nothing", "zeros": bytes(2000), "bad.xml": b"<?xml \xff\xfe"}
    for name, data in files.items():
        (tmp_path / "d" / name).write_bytes(data)
    s = blobs.heads(blobs.blob_sources(spark, str(tmp_path)))
    got = {r["entry_name"]: r["format_id"] for r in probe.probe_best(signatures.probe_sources(s), signatures.SIGNATURES).collect()}
    assert got == {"a.img": "image.vhd", "b.001": "image.splitraw", "b.002": None, "vmfs": "filesystem.vmfs", "none": None, "zeros": None, "bad.xml": None}


def mbr(entries):
    return bytes(446) + b"".join(mbr_entry(*e) for e in entries).ljust(64, b"\0") + b"\x55\xaa"


def test_sector_sizes_chains_and_loops(spark):
    disk = bytearray(400 * 512)
    disk[0:512] = mbr([(0x83, 2, 10), (5, 100, 200)])
    disk[100 * 512 : 101 * 512] = mbr([(0x07, 1, 20), (5, 50, 60)])
    disk[150 * 512 : 151 * 512] = mbr([(0x83, 2, 20)])
    loop, two, missing = bytearray(disk), bytearray(disk), bytearray(disk)
    loop[150 * 512 : 151 * 512] = mbr([(0x83, 2, 20), (5, 0, 60)])
    two[150 * 512 : 151 * 512] = mbr([(0x83, 2, 20), (0x83, 30, 20)])
    missing[100 * 512 + 510] = 0
    big = bytearray(64 * 4096)
    big[0:512] = mbr([(0x83, 2, 60)])
    big[2 * 4096 + 1080 : 2 * 4096 + 1082] = b"\x53\xef"
    d = sources(spark, disk, loop, two, missing, big, *ODD)
    layouts = partitions.mbr_layout(partitions.mbr_candidates(d))
    assert {(r["source_id"], r["sector"]) for r in layouts.collect()} == {(0, 512), (4, 4096)}
    got = rows(partitions.mbr_volumes(layouts).filter("source_id = 0").select("index", "byte_offset", "byte_size", "role"))
    assert got == [(0, 1024, 5120, "Primary"), (1, 51200, 102400, "Extended"), (2, 51712, 10240, "Logical"), (3, 77824, 10240, "Logical")]
    views = partitions.views(partitions.mbr_volumes(layouts))
    assert rows(partitions.selected(views, "index", 2).select("source_id", "kind")) == [(0, "Volume")]
    assert partitions.selected(views, "name", "x").count() == 0 and partitions.selected(views, "id", 1).count() == 1


def gpt(block, damage=False, entries=((6, 9), (10, 20))):
    kind = uuid.UUID("0fc63daf-8483-4772-8e79-3d69d8477de4").bytes_le
    n = 40
    table = b"".join(kind + uuid.UUID(int=i + 1).bytes_le + struct.pack("<QQQ", a, b, 0) + f"p{i}".encode("utf-16-le").ljust(72, b"\0") for i, (a, b) in enumerate(entries)).ljust(512, b"\0")

    def header(*at):
        make = lambda crc: struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, crc, 0, at[0], at[1], 6, n - 4, uuid.UUID(int=7).bytes_le, at[2], 4, 128, zlib.crc32(table))
        return make(zlib.crc32(make(0)))

    out = bytearray(n * block)
    out[0:512] = mbr([(0xEE, 1, n - 1)])
    out[block : block + 92], out[2 * block : 2 * block + 512] = header(1, n - 1, 2), table
    out[(n - 1) * block : (n - 1) * block + 92], out[(n - 3) * block : (n - 3) * block + 512] = header(n - 1, 1, n - 3), table
    if damage:
        out[block + 60] ^= 1
    return out


def test_block_sizes_backups_and_pairs(spark):
    overlap, outside = gpt(512, entries=((6, 12), (10, 20))), gpt(512, entries=((3, 9),))
    d = sources(spark, gpt(512), gpt(4096), gpt(512, damage=True), overlap, outside, *ODD)
    found = partitions.gpt_headers(d)
    got = rows(partitions.gpt_volumes(found).select("source_id", "block", "location", "index", "byte_offset", "name"))
    assert got == [(i, b, place, k, (6, 10)[k] * b, f"p{k}") for i, b, place in ((0, 512, "Primary"), (1, 4096, "Primary"), (2, 512, "Backup")) for k in (0, 1)]
    assert rows(partitions.gpt_pair_checks(found).groupBy("source_id").agg(F.count("*"), F.min("ok"))) == [(0, 7, True), (1, 7, True), (3, 7, True), (4, 7, True)]


def test_partition_maps(spark):
    def entry(count, start, blocks, kind):
        return (b"PM\0\0" + struct.pack(">III", count, start, blocks)).ljust(16, b"\0") + b"n".ljust(32, b"\0") + kind.ljust(32, b"\0") + bytes(432)

    device = (b"ER" + struct.pack(">HI", 512, 64)).ljust(512, b"\0")
    good = device + entry(2, 1, 2, b"Apple_partition_map") + entry(2, 3, 10, b"Apple_HFS")
    d = sources(spark, good.ljust(64 * 512, b"\0"), good, (device + entry(3, 1, 2, b"Apple_partition_map") + entry(2, 3, 10, b"Apple_HFS")).ljust(64 * 512, b"\0"), *ODD)
    checks = {r["source_id"]: r for r in partitions.apm_checks(partitions.apm_entries(d)).collect()}
    assert checks[0]["ok"] and not checks[1]["in_source"] and not checks[2]["counts_agree"] and set(checks) == {0, 1, 2}


def test_chains_end_loop_and_branch_off(spark):
    links = spark.createDataFrame([(1, 2, 3), (1, 3, 7), (1, 7, None), (1, 9, 10), (1, 10, 9), (2, 2, 2), (4, 1, 99), *((5, i, i + 1) for i in range(100))], "d long, node long, following long")
    starts = spark.createDataFrame([(1, 2), (1, 9), (2, 2), (3, 5), (4, 1), (5, 0)], "d long, first long")
    got = chains.follow_chains(starts, links, "d", "first", "node", "following").collect()
    chain = lambda d, s: [r["node"] for r in sorted((r for r in got if (r["d"], r["first"]) == (d, s)), key=lambda r: r["ordinal"])]
    assert chain(1, 2) == [2, 3, 7] and chain(3, 5) == [5] and chain(4, 1) == [1, 99] and chain(5, 0) == list(range(101))
    assert {(r["d"], r["first"]) for r in got if r["looped"]} == {(1, 9), (2, 2)} and set(chain(1, 9)) == {9, 10}


def test_cluster_chains_tell_broken_files(spark):
    entries = spark.createDataFrame([(1, 2, 3), (1, 3, 0xFFFF), (1, 5, 6), (1, 6, 0), (1, 8, 9), (1, 9, 8)], "d long, cluster long, entry long")
    files = spark.createDataFrame([(1, 10, 2, 1000), (1, 11, 2, 5000), (1, 12, 5, 1000), (1, 13, 8, 700), (1, 14, 8, None), (1, 15, 2, None)], "d long, file_id long, first_cluster long, size long")
    got = chains.cluster_chains(files, chains.fat_links(entries, "d", "FAT16"), "d", 512).groupBy("file_id").agg(F.count("*").alias("n"), F.min("ok").alias("ok")).collect()
    assert {r["file_id"]: (r["n"], r["ok"]) for r in got if r["file_id"] != 14} == {10: (2, True), 11: (2, False), 12: (2, False), 13: (2, True), 15: (2, True)}
    assert not next(r["ok"] for r in got if r["file_id"] == 14)


def test_runlists_and_holes(spark):
    good = b"\x21\x10\x00\x01" + b"\x01\x05" + b"\x11\x03\xfe" + b"\x00\x77"
    d = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"\x11\x05\x03\x44\x01")), (3, bytearray(b"\x10\x05")), (4, bytearray()), (5, None), (6, bytearray(b"\x11\x01\x80"))], "k long, runs binary")
    got = rows(extents.decode_runlists(d, "k", "runs", 10))
    assert got == [(1, 0, 0, 160, 2560, True), (1, 1, 160, 50, None, True), (1, 2, 210, 30, 2540, True), (2, 0, 0, 50, 30, True), (2, 1, 50, None, None, False), (3, 0, 0, None, None, False), (6, 0, 0, None, None, False)]
    nested = spark.createDataFrame([(1, 0, 100), (1, 10, 5), (1, 50, 10), (1, 120, 5)], "k long, logical_offset long, length long")
    sizes = spark.createDataFrame([(1, 130), (2, 7)], "k long, size long")
    assert rows(extents.fill_holes(nested, sizes, "k").filter("is_hole").drop("is_hole")) == [(1, 100, 20), (1, 125, 5), (2, 0, 7)]
    assert rows(extents.overlap_errors(nested, "k").drop("reaches")) == [(1, 10, 5), (1, 50, 10)]


def test_floor_lookups_in_parts(spark):
    rng = np.random.default_rng(1)
    starts = spark.createDataFrame([(int(k), int(v), int(v) * 2) for k, v in {(a, b) for a, b in zip(rng.integers(0, 3, 300), rng.integers(0, 1000, 300), strict=True)}], "k long, s long, x long")
    points = spark.createDataFrame([(i, int(k), int(p)) for i, (k, p) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(-5, 1100, 200), strict=True))], "i long, k long, p long")
    plain = extents.floor_join(points, starts, "k", "p", "s", ["x"])
    split = extents.range_parts(starts, "s", 20)
    assert rows(extents.floor_join(points, starts, "k", "p", "s", ["x"], split)) == rows(plain)
    assert extents.range_parts(starts.limit(0), "s")(F.col("s")) is not None


def test_qcow_states_of_both_versions(spark):
    d = spark.createDataFrame([(1, (1 << 63) - (1 << 64) + (3 << 47) + 77), (2, 65536), (3, 1), (4, 0), (5, (1 << 63) - (1 << 64) + 65536)], "i long, e long")
    old = {r["i"]: tuple(r["s"]) for r in d.select("i", extents.qcow_state(F.col("e"), F.lit(16), F.lit(1)).alias("s")).collect()}
    assert old[1] == ("Compressed", 77, 3) and old[2] == ("Standard", 65536, None) and old[3][0] == "Zero" and old[4][0] == "Sparse"
    new = {r["i"]: tuple(r["s"]) for r in d.select("i", extents.qcow_state(F.col("e"), F.lit(16), F.lit(3), F.lit(True)).alias("s")).collect()}
    assert new[5] == ("Standard", 65536, None)


def test_checksums_are_the_libraries(spark):
    rng = np.random.default_rng(2)
    blocks = [b"", b"a", b"123456789", *(rng.bytes(int(n)) for n in (7, 8, 9, 1000, 70_001))]
    assert checksums.crc32c_of(b"123456789") == 0xE3069283
    for b in blocks:
        assert checksums.weak_crc32_of(b, 0xFFFFFFFF) ^ 0xFFFFFFFF == zlib.crc32(b)
        assert checksums.fold_crc32([(zlib.crc32(b[:3]), len(b[:3])), (zlib.crc32(b[3:]), len(b[3:]))]) == zlib.crc32(b)
        words = [int.from_bytes(b[i : i + 4], "little") for i in range(8, len(b) - len(b) % 4, 4)]
        low = high = 0
        for w in words:
            low = (low + w) % 0xFFFFFFFF
            high = (high + low) % 0xFFFFFFFF
        first = 0xFFFFFFFF - (low + high) % 0xFFFFFFFF
        assert checksums.fletcher64_of(b) == (0xFFFFFFFF - (low + first) % 0xFFFFFFFF) << 32 | first
    d = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blocks)] + [(99, None)], "i long, b binary")
    got = {r["i"]: r for r in d.select("i", F.crc32("b").alias("z"), checksums.crc32c("b").alias("c"), checksums.weak_crc32(5)("b").alias("w"), checksums.adler32("b").alias("a")).collect()}
    assert all(got[i]["z"] == zlib.crc32(b) and got[i]["a"] == zlib.adler32(b) and got[i]["c"] == checksums.crc32c_of(b) and got[i]["w"] == checksums.weak_crc32_of(b, 5) for i, b in enumerate(blocks))
    assert got[99]["c"] is None and got[99]["w"] is None


def test_unpacking_and_text(spark):
    body = b"some text " * 50
    squeeze = zlib.compressobj(wbits=-15)
    raw = squeeze.compress(body) + squeeze.flush()
    packed = [("zlib", zlib.compress(body)), ("deflate", raw), ("bzip2", bz2.compress(body)), ("xz", lzma.compress(body)), ("lzma", lzma.compress(body, lzma.FORMAT_ALONE)), ("none", body), ("zlib", b"junk"), ("adc", b"\x05\xff"), (None, body), ("zlib", None), ("adc", b"\x82abc\x04\x02\x40\x00\x00"), ("lznt1", b"\x05\xb0\x08abc\x02\x20" + b"\x01\x30xy"), ("lzfse", body)]
    d = spark.createDataFrame([(i, k, None if b is None else bytearray(b)) for i, (k, b) in enumerate(packed)], "i long, k string, b binary")
    got = {r["i"]: r["x"] for r in d.select("i", text.decompressed("k", "b", F.lit(500)).alias("x")).collect()}
    assert all(bytes(got[i]) == body for i in range(6)) and all(got[i] is None for i in (*range(6, 10), 12))
    assert bytes(got[10]) == b"abcabca" + b"aaaa" and bytes(got[11]) == b"abcabcab" [:8] + b"xy"
    lone, pair = b"a\0\x00\xd8b\0", "a😀\0b".encode("utf-16-le")
    d = spark.createDataFrame([(1, bytearray(lone)), (2, bytearray(pair)), (3, bytearray()), (4, None)], "i long, b binary")
    assert [r[1] for r in d.orderBy("i").select("i", text.utf16_text(F.col("b"))).collect()] == [None, "a😀", "", None]
    assert [r[1] for r in d.orderBy("i").select("i", text.utf8_text(F.col("b"))).collect()] == [None, None, "", None]
    assert spark.createDataFrame([(bytearray("ﾃｽﾄ".encode("shift_jis")),)], "b binary").select(text.code_page("shift_jis")("b")).first()[0] == "ﾃｽﾄ"
    stamp = spark.createDataFrame([((2026 - 1980) << 9 | 11 << 5 | 27, 19 << 11 | 18 << 5 | 15), (13 << 5 | 1, 0), (0, 0)], "d long, t long")
    assert [r[0] for r in stamp.select(text.dos_timestamp(F.col("d"), F.col("t"))).collect()] == [datetime.datetime(2026, 11, 27, 19, 18, 30), None, None]


def test_segment_grammar(spark):
    names = {"disk.001": "disk.002", "disk.000": "disk.001", "disk.002": None, "d1of3": "d2of3", "d2of3": None, "imageaa": "imageab", "image.aa": None, "imageab": None, "x": None, "001": None, "a0": "a1", None: None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", descriptors.first_and_next_segment(F.col("n"))).collect()}
    assert got == names


def test_folding_is_the_plain_version(spark):
    import unicodedata

    names = ["Straße", "STRASSE", "É", "É", "ﬁ", "İ", "Σς", "", None, "日本"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").orderBy("i").select(namespace.folded_name("n")).collect()]
    assert got == [None if n is None else unicodedata.normalize("NFD", unicodedata.normalize("NFD", n).casefold()) for n in names]
    assert got[0] == got[1] and got[2] == got[3]


def test_paths_of_deep_trees_cycles_and_orphans(spark):
    deep = [(str(i), str(i - 1) if i else None, str(i)) for i in range(40)]
    odd = [("a", "b", "A"), ("b", "a", "B"), ("c", "a", "C"), ("o", "gone", "O")]
    n = spark.createDataFrame(deep + odd, "node string, parent string, name string")
    got = dict(map(tuple, namespace.paths(n).collect()))
    assert got == {str(i): "".join(f"/{k}" for k in range(i + 1)) for i in range(40)}
    found = {r["node"]: (r["root"], r["depth"]) for r in namespace.ancestors_doubled(n, "node", "parent").collect()}
    assert found == {**{str(i): ("0", i) for i in range(40)}, **dict.fromkeys("abco", (None, None))}
    assert namespace.paths(n.limit(0)).count() == 0


def test_snapshots_that_tie_are_ambiguous(spark):
    s = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "a"), (2, "d", None), (2, "e", "d")], "i long, node string, parent string")
    got = rows(versions.active_snapshots(s, namespace.ancestors_doubled(s, "node", "parent"), ["i"], "node", "parent"))
    assert got == [(1, None, True), (2, "e", False)]


def test_windows_in_parts_are_whole_windows(spark):
    """Objects whose extents are sorted in ranges give what they give whole."""
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(int(k), int(o), int(n), i) for i, (k, o, n) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 5000, 300), rng.integers(1, 60, 300), strict=True))], "k long, logical_offset long, length long, id long")
    sizes = spark.createDataFrame([(k, 6000) for k in range(4)], "k long, size long")
    split = extents.range_parts(e, "logical_offset", 25)
    assert rows(extents.fill_holes(e, sizes, "k", split)) == rows(extents.fill_holes(e, sizes, "k"))
    assert rows(extents.overlap_errors(e, "k", split)) == rows(extents.overlap_errors(e, "k"))
    ends = e.withColumn("e", F.lit(6000))
    order = ["logical_offset", "id"]
    assert rows(extents.stored_sizes(ends, "k", order, "logical_offset", "e", split)) == rows(extents.stored_sizes(ends, "k", order, "logical_offset", "e"))
    spans = e.selectExpr("k", "id", "logical_offset AS start", "logical_offset + length AS end")
    assert rows(volumes.overlapping_neighbours(spans, "k", "id", split)) == rows(volumes.overlapping_neighbours(spans, "k", "id"))
    pairs = {(k, min(a, b), max(a, b)) for k, a, s, t in spans.collect() for q, b, u, v in spans.collect() if k == q and a != b and s < v and u < t}
    assert set(map(tuple, volumes.overlapping_pairs(spans, "k", "id").collect())) == pairs and volumes.overlapping_pairs(spans, "k", "id").count() == len(pairs)
