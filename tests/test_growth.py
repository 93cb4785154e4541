"""What grows with the input must grow no faster: no bytes in joins, no hot group in one task, no work a constant at a time."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from strataspark.functions import checksums
from strataspark.operators import chains, extents, headers, namespace, partitions, signatures
from strataspark.operators.decode import ones_complement_ok
from strataspark.plans.samples import mbr_entry
from strataspark.sources import blobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def moved(df):
    """The lines of the plan that say what is shuffled or broadcast."""
    df.collect()
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [m.group(0) for m in re.finditer(r"\) (Broadcast)?Exchange[^\n]*\nInput[^\n]*", plan)]


def test_metadata_bytes_are_not_joined_and_odd_offsets_do_not_fail(spark):
    entry = lambda i, at, n: bytes(15) + bytes([i]) + at.to_bytes(4, "little") + n.to_bytes(4, "little") + bytes(8)
    table = (b"metadata" + bytes(2) + b"\3\0").ljust(32, b"\0") + entry(1, 65_536, 3) + entry(2, 0xFFFFFFFF, 0xFFFFFFFF) + entry(3, 65_536, 4)
    d = spark.createDataFrame([(1, bytearray(table.ljust(65_536, b"\0") + b"abc"))], "source_id long, metadata binary")
    found = headers.metadata_items(d)
    assert rows(found.select("index", F.decode("value", "UTF-8"), "ok")) == [(0, "abc", True), (1, None, False), (2, "abc", False)]
    assert moved(found) and not any("metadata#" in x for x in moved(found))


def test_band_maps_do_not_join_images(spark):
    head = (b"sprs" + bytes([0, 0, 0, 3, 0, 0, 0, 2]) + bytes(7) + b"\6").ljust(64, b"\0") + bytes([0, 0, 0, 2])
    d = spark.createDataFrame([(1, 7000, bytearray(head.ljust(4096, b"\0")))], "source_id long, size long, head binary")
    found = headers.band_map(d)
    assert rows(found) == [(1, 1, 4096, True, True, True)]
    assert moved(found) and not any("head#" in x or "_image#" in x for x in moved(found))


def test_folders_are_listed_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(namespace, "BLOCK", 3)
    d = spark.range(0, 50).select((F.col("id") % 3).alias("parent_id"), (F.col("id") + 10).alias("node_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("File").alias("kind"))
    nodes = d.select("node_id", "kind").union(spark.createDataFrame([(i, "Directory") for i in (0, 1, 2, 9)], "node_id long, kind string"))
    asked = spark.range(0, 40).select(F.col("id").alias("request_id"), F.when(F.col("id") < 30, 1).when(F.col("id") < 35, 2).when(F.col("id") < 37, 9).when(F.col("id") < 39, 12).cast("long").alias("node_id"))
    found = namespace.read_dir(asked, nodes, d)
    got = rows(found.select("request_id", "status", "name"))
    want = [(r, "Ok", f"n{i}") for r in range(35) for i in range(50) if i % 3 == (1 if r < 30 else 2)] + [(37, "InvalidFormat", None), (38, "InvalidFormat", None), (39, "NotFound", None)]
    assert got == sorted(want, key=str)
    dealt = found.filter("status = 'Ok'").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 0.7 * len(want)


def test_listed_rows_are_made_last_in_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(namespace, "BLOCK", 3)
    monkeypatch.setattr(namespace, "TASK_PAIRS", 4, raising=False)
    nodes = spark.createDataFrame([(1, "Directory"), (2, "Directory"), (3, "File"), (4, "Directory")], "node_id long, kind string")
    names = [f"n{i}" for i in range(20)] + ["n0", None]
    d = spark.createDataFrame([(1, x, 100 + i % 20, "File") for i, x in enumerate(names)] + [(2, "one", 7, "File"), (3, "lost", 8, "File"), (None, "x", 9, "File")], "parent_id long, name string, node_id long, kind string")
    asked = [(i, 1) for i in range(30)] + [(5, 1), (None, 1), (40, 2), (41, 3), (42, 4), (43, 99), (44, None), (44, None)]
    found = namespace.read_dir(spark.createDataFrame(asked, "request_id long, node_id long"), nodes, d)
    want = [(r, "Ok", x, 100 + i % 20, "File") for r, n in asked if n == 1 for i, x in enumerate(names)]
    want += [(40, "Ok", "one", 7, "File"), (41, "InvalidFormat", None, None, None), *((r, "NotFound", None, None, None) for r in (43, 44, 44))]
    assert rows(found) == sorted(want, key=str)
    # 32 and 22 rows are 11 and 8 blocks: 88 pairs and the one of the small folder, four to a task.
    assert found.rdd.getNumPartitions() == 23
    above = found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert "Union" not in above


def test_chain_steps_are_bounded_by_the_sectors(spark):
    """A table that names itself, one whose chain goes on past the end, and a sound one, within a source of few sectors."""
    def disk(link):
        d = bytearray(8 * 512)
        for at, entries in ((0, [mbr_entry(5, 2, 6)]), (2, [mbr_entry(7, 1, 1), *([mbr_entry(5, link, 3)] if link is not None else [])]), (5, [mbr_entry(7, 1, 1)])):
            for i, e in enumerate(entries):
                d[at * 512 + 446 + 16 * i : at * 512 + 462 + 16 * i] = e
            d[at * 512 + 510 : at * 512 + 512] = b"\x55\xaa"
        return d

    d = spark.createDataFrame([(i, 8 * 512, disk(x)) for i, x in enumerate((None, 3, 0, 90))], "source_id long, size long, bytes binary")
    chain = partitions.extended_chain(F.col("bytes"), F.lit(2), F.lit(512))
    got = {r["source_id"]: (r["c"]["ok"], [tuple(x) for x in r["c"]["found"]]) for r in d.select("source_id", chain.alias("c")).collect()}
    assert got == {0: (True, [("07", 3, 1)]), 1: (True, [("07", 3, 1), ("07", 6, 1)]), 2: (False, [("07", 3, 1)]), 3: (False, [("07", 3, 1)])}
    # What a step reads of a source is one record, cut once.
    assert str(chain._jc).count("bytes") <= 4


def test_slices_keep_compressible_sources_in_several_partitions(spark):
    d = spark.range(0, 64).select(F.col("id").alias("source_id"), F.lit(bytes(100_000)).alias("bytes"))
    ranges = spark.range(0, 64).select(F.col("id").alias("source_id"), F.lit(5).alias("offset"), F.lit(7).alias("length"))
    found = blobs.slices(d, ranges.union(ranges.filter("source_id < 0")))
    assert found.filter("complete").count() == 64
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lvm_pairs_are_decoded_once(spark):
    label = bytearray(512)
    for i, (at, n) in enumerate(((1 << 20, 7), (0, 0), (4096, 10), (9000, 10))):
        label[72 + 16 * i : 88 + 16 * i] = at.to_bytes(8, "little") + n.to_bytes(8, "little")
    d = spark.createDataFrame([(1, 512, label)], "source_id long, pv_offset long, label binary")
    found = headers.lvm_areas(d)
    assert [tuple(map(str, r)) for r in rows(found)] == [("1", "data", "0", str((1 << 20) + 512), "7"), ("1", "metadata", "0", "4608", "10"), ("1", "metadata", "1", "9512", "10")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(0, 26") + plan.count("[0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22,23,24,25,26]") <= 1


def test_byte_sums_take_no_step_for_each_byte(spark):
    data = bytearray(range(256)) * 2
    data[64:68] = (0xFFFFFFFF - (sum(data) - sum(data[64:68]))).to_bytes(4, "big")
    bad = bytearray(data)
    bad[511] ^= 1
    d = spark.createDataFrame([(0, data), (1, bad), (2, data[:511]), (3, None)], "i long, b binary").select("i", ones_complement_ok(F.col("b"), 512, 64).alias("ok"))
    assert rows(d) == [(0, True), (1, False), (2, False), (3, False)]
    assert "aggregate(" not in d._jdf.queryExecution().optimizedPlan().toString().lower()


def test_registers_pass_zeros_and_pieces_by_matrix():
    checksums._moved_on.cache_clear()
    for n in (0, 1, 7, 700, 4016):
        for head in (b"", b"\0\0", b"head\1", bytes(range(256))):
            data = head + bytes(n)
            assert checksums.weak_crc32_of(data, 0xFFFFFFFF) ^ 0xFFFFFFFF == zlib.crc32(data)
            assert checksums.zlib_combine(zlib.crc32(b"one"), zlib.crc32(data), len(data)) == zlib.crc32(b"one" + data)
    assert checksums.crc32c_of(bytes(32)) == 0x8A9136AA
    checksums.fold_crc32([(zlib.crc32(b"x" * 700), 700)] * 50)
    assert checksums._moved_on.cache_info().hits >= 40


def test_sources_that_name_no_other_are_not_dealt_to_one_task(spark):
    d = spark.range(0, 64).select(F.col("id").alias("source_id"), F.concat(F.lit("/e/"), F.col("id").cast("string")).alias("logical_path"))
    found = signatures.with_related(d, F.when(F.col("source_id") == 5, F.lit("/e/9")), "there")
    assert [r["source_id"] for r in found.filter("there").collect()] == [5]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(" in plan and found.count() == 64


def test_parts_are_searched_by_halves_and_agree_with_a_scan(spark):
    d = spark.range(0, 1000).select((F.col("id") * 7 % 1000 - 300).alias("v")).union(spark.createDataFrame([(None,)], "v long"))
    split = extents.range_parts(d.filter("v IS NOT NULL"), "v", 10)
    out = d.select("v", split(F.col("v")).alias("p")).filter("v IS NOT NULL").orderBy("v").collect()
    assert [r["p"] for r in out] == sorted(r["p"] for r in out) and len({r["p"] for r in out}) > 80
    assert max(sum(1 for r in out if r["p"] == p) for p in {r["p"] for r in out}) <= 30
    plan = d.select(split(F.col("v")).alias("p"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "filter([" not in plan and "aggregate([" in plan


def test_inodes_of_one_file_system_pass_no_window(spark):
    chunks = spark.createDataFrame([(1, 64), (1, 100), (2, 0), (None, 7), (1, 64)], "fs int, chunk_start long")
    asked = spark.createDataFrame([(1, x) for x in (63, 64, 127, 128, 163, 164, None)] + [(2, 63), (2, 64), (3, 0), (None, 70), (None, 71)], "fs int, i long")
    found = extents.inodes_in_chunks(asked, chunks, "fs", "i")
    yes = {(1, 64), (1, 127), (1, 128), (1, 163), (2, 63), (None, 70)}
    assert rows(found) == sorted(((fs, i, (fs, i) in yes) for fs, i in map(tuple, asked.collect())), key=str)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_area_offsets_do_not_depend_on_the_split(spark):
    asked = spark.range(0, 300).select(F.lit(1).alias("pv"), F.col("id").alias("at"))
    areas = spark.createDataFrame([(1, 0, 1000, 100), (1, 1, 5000, 50), (1, 2, 9000, 60)], "pv int, ordinal int, offset long, size long")
    split = extents.range_parts(asked, "at", 20)
    assert rows(extents.area_offsets(asked, areas, "pv", "at", split)) == rows(extents.area_offsets(asked, areas, "pv", "at"))


def test_chains_are_followed_as_far_as_files_need(spark, monkeypatch):
    written = []
    write = chains.Rounds.write
    monkeypatch.setattr(chains.Rounds, "write", lambda self, df: written.append(1) or write(self, df))
    links = chains.fat_links(spark.range(2, 1000).select(F.lit(1).alias("d"), F.col("id").alias("cluster"), (F.col("id") + 1).alias("entry")), "d", "FAT32")
    files = spark.createDataFrame([(1, 7, 2, 1500)], "d int, file_id long, first_cluster long, size long")
    assert rows(chains.cluster_chains(files, links, "d", 512)) == [(1, 7, i, 2 + i, 512 * i, True) for i in range(3)]
    assert len(written) <= 10
    whole = chains.cluster_chains(files.union(spark.createDataFrame([(1, 8, 2, None)], files.schema)), links, "d", 512)
    assert whole.filter("file_id = 8").count() == 999 and whole.filter("file_id = 7").count() == 3


def test_runs_of_one_object_are_made_in_parts_of_stated_size(spark, monkeypatch):
    monkeypatch.setattr(extents, "TASK_ROWS", 40)
    held = [b for b in range(-200, 400) if b % 97 and not 100 < b < 130] + [1000, 1002, None]
    d = spark.createDataFrame([(k, b) for k in (1, None) for b in held] + [(2, 5)] * 50 + [(3, None)], "k int, b long")
    want = [(2, 5, 1), (3, None, 1), *((k, None, 1) for k in (1, None))]
    for k in (1, None):
        first = None
        for b in range(-200, 1004):
            if b in held and first is None:
                first = b
            if b not in held and first is not None:
                want.append((k, first, b - first))
                first = None
    # The second split has a part for each block, so that every run goes on through many parts.
    for split in (None, extents.range_parts(d, "b", 50), lambda c: c, lambda c: F.floor(c / 300)):
        found = extents.coalesce_runs(d, ["k"], "b", split)
        assert rows(found) == sorted(want, key=str)
    assert extents.task_parts(d) == -(-d.count() // 40)
    plan = extents.coalesce_runs(d, ["k"], "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{extents.task_parts(d)}), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_pieces_of_one_request_are_not_brought_together(spark, monkeypatch):
    monkeypatch.setattr(extents, "TASK_ROWS", 40)
    rng = np.random.default_rng(3)
    laid, asked = [], []
    for k in (1, 2, 3):
        at = 7 * k
        for n in range(100 if k == 1 else 3):
            length = int(rng.integers(1, 30))
            laid.append((k, at, length, None if n % 9 == 8 else 10_000 * n + k))
            at += length + int(rng.integers(0, 2)) * int(rng.integers(0, 20))
        asked += [(k, int(a), int(b)) for a, b in zip(rng.integers(-20, at + 40, 30), rng.choice([0, 1, 2, 9, 70, 900], 30), strict=True)]
    asked += [(1, -5, 5000), (4, 3, 10), (None, 3, 10), (1, laid[0][1], laid[0][2]), (1, laid[4][1] + laid[4][2], 3)]
    e = spark.createDataFrame([*laid, (None, 0, 100, 5)], "k long, logical_offset long, length long, physical_offset long")
    r = spark.createDataFrame([(k, i, a, n) for i, (k, a, n) in enumerate(asked)], "k long, request_id long, offset long, length long")
    want = []
    for i, (k, a, n) in enumerate(asked):
        mine = [x for x in laid if x[0] == k]
        cuts = sorted({a} | {c for x in mine for c in (x[1], x[1] + x[2]) if a < c < a + n}) if n else []
        for c, d in zip(cuts, [*cuts[1:], a + n], strict=False):
            within = [x for x in mine if x[1] <= c < x[1] + x[2]]
            want.append((i, c, d - c, within[0][3] + c - within[0][1] if within and within[0][3] is not None else None))
    dealt = e.repartition(6, "k")
    for found in (extents.request_pieces(r, e, "k"), extents.request_pieces(r, dealt, "k", dealt=6), extents.request_pieces(r, e, "k", extents.range_parts(e, "logical_offset", 20))):
        assert rows(found) == sorted(want, key=str)
    plan = extents.request_pieces(r, dealt, "k", dealt=6)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window[^\n]*request_id#\d+L?[^\n]*\], \[request_id", plan) and "piece_offset" not in "".join(x for x in plan.splitlines() if "Window" in x)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_extents_are_joined_in_partitions_of_stated_size(spark, monkeypatch):
    monkeypatch.setattr(extents, "TASK_ROWS", 40)
    d = spark.range(0, 400).select((F.col("id") % 50).alias("k"), (F.col("id") - F.col("id") % 50).alias("logical_offset"), F.lit(50).cast("long").alias("length"), F.when(F.col("id") < 200, F.col("id") - F.col("id") % 50).alias("physical_offset"))
    found = extents.coalesce_extents(d, ["k"])
    assert rows(found) == sorted(((k, *x) for k in range(50) for x in ((0, 200, 0), (200, 200, None))), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "10), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
