"""Descriptors, segment names and checksums."""

import zlib

from pyspark.sql import functions as F

from strataspark.functions import checksums, descriptors

TEXT = """# Disk DescriptorFile
version=1
CID=12ab
parentCID="ffffffff"
createType = "monolithicFlat"
CID=zz
RW 8192 FLAT "a b.raw" 0
RDONLY 16 SPARSE "c.vmdk"
RW 4 ZERO
"""


def test_descriptor_pairs_and_extents(spark):
    d = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "k long, t string")
    got = {r["k"]: r["p"] for r in d.select("k", descriptors.pairs(F.col("t")).alias("p")).collect()}
    assert got[1] == {"version": "1", "cid": "12ab", "parentcid": "ffffffff", "createtype": "monolithicFlat"} and got[2] == {} and got[3] is None
    rows = [tuple(r) for r in descriptors.extent_lines(d, "k", "t").orderBy("ordinal").collect()]
    assert rows == [
        (1, 0, "RW", 8192 * 512, "FLAT", "a b.raw", 0, 0), (1, 1, "RDONLY", 8192, "SPARSE", "c.vmdk", None, 8192 * 512), (1, 2, "RW", 2048, "ZERO", None, None, 8208 * 512)]


def test_xml_elements(spark):
    xml = "<Image><Size>65536</Size><Size>1</Size></Image>"
    plist = "<plist><dict><key>band-size</key><integer>8388608</integer><key>size</key><integer>4194304</integer></dict></plist>"
    r = spark.createDataFrame([(xml, plist)], "x string, p string").select(descriptors.element_text(F.col("x"), "/Image/Size"), descriptors.plist_value(F.col("p"), "size"), descriptors.plist_value(F.col("p"), "none")).first()
    assert tuple(r) == ("65536", "4194304", "")


def test_segment_names(spark):
    names = ["a.000", "a.017", "a.aa", "a.ab", "a.ba", "d3of5.raw", "plain", "a.099", "a.99"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(descriptors.segment_ordinal(F.col("n")), descriptors.following_segment(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 17, 0, 1, 26, 3, None, 99, 99]
    assert [r[1] for r in got] == ["a.001", "a.018", None, None, None, None, None, "a.100", None]


def test_checksums(spark):
    assert checksums.crc32c_of(b"123456789") == 0xE3069283
    block = bytes(8) + bytes(range(200)) * 5
    value = checksums.fletcher64_of(block)
    limit, low, high = (1 << 32) - 1, 0, 0
    for i in range(8, len(block), 4):
        low = (low + int.from_bytes(block[i : i + 4], "little")) % limit
        high = (high + low) % limit
    for word in (value & limit, value >> 32):  # with the checksum behind the words both sums vanish
        low = (low + word) % limit
        high = (high + low) % limit
    assert (low, high) == (0, 0)
    d = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "i int, b binary").orderBy("i")
    assert [r[0] for r in d.select(checksums.adler32("b")).collect()] == [zlib.adler32(b"abc"), None]
    assert [r[0] for r in d.select(checksums.crc32c("b")).collect()] == [checksums.crc32c_of(b"abc"), None]
    assert d.select(checksums.fletcher64("b")).count() == 2
