"""Operators on small tables: ties, gaps, holes, empty inputs."""

from pyspark.sql import functions as F

from strataspark.functions.text import flag_names, zipped_header
from strataspark.operators import extents, namespace, probe, streams, versions, volumes
from strataspark.operators.probe import Signature


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_probe_ties_follow_registration_and_short_heads_do_not_match(spark):
    sig = [Signature("b", "Image", "AB", "Exact"), Signature("a", "Image", "AB", "Exact"), Signature("z", "Archive", "B", "Weak", 1), Signature("far", "Image", "X", "Exact", 99)]
    s = spark.createDataFrame([(1, "AB"), (2, "A"), (3, None), (4, "")], "id long, head string")
    assert [(r["rank"], r["format_id"]) for r in probe.probe_all(s, sig).filter("id = 1").orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, "z")]
    assert rows(probe.probe_best(s, sig).select("id", "format_id")) == [(1, "a"), (2, None), (3, None), (4, None)]
    assert rows(probe.probe_best(s, sig, kind="Archive").select("id", "format_id"))[0] == (1, "z")


def test_extents_cover_their_object_without_overlap(spark):
    e = spark.createDataFrame([(1, 5, 3), (1, 10, 2), (2, 0, 4)], "k long, logical_offset long, length long")
    sizes = spark.createDataFrame([(1, 15), (2, 4), (3, 7), (4, 0)], "k long, size long")
    got = rows(extents.fill_holes(e, sizes, "k"))
    assert got == sorted([(1, 0, 5, True), (1, 5, 3, False), (1, 8, 2, True), (1, 10, 2, False), (1, 12, 3, True), (2, 0, 4, False), (3, 0, 7, True)], key=str)


def test_floor_lookup_at_edges(spark):
    e = spark.createDataFrame([(1, 5, 3, "a"), (1, 8, 2, "b")], "k long, logical_offset long, length long, v string")
    p = spark.createDataFrame([(1, x) for x in (4, 5, 7, 8, 9, 10)] + [(2, 0)], "k long, at long")
    got = {(r["k"], r["at"]): r["v"] for r in extents.covering_extent(p, e, "k", "at", ["v"]).collect()}
    assert got == {(1, 4): None, (1, 5): "a", (1, 7): "a", (1, 8): "b", (1, 9): "b", (1, 10): None, (2, 0): None}


def test_prefix_offsets_do_not_depend_on_the_split(spark):
    d = spark.range(0, 500).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"), (F.col("id") % 7).alias("length"))
    one = extents.prefix_offsets(d, "k", ["n"], "length")
    two = extents.prefix_offsets(d, "k", ["n"], "length", split=F.floor(F.col("n") / 30))
    assert rows(one) == rows(two.select(one.columns))


def test_zero_masks_lower_layers_and_absent_does_not(spark):
    d = spark.createDataFrame([(1, 0, "absent", 5), (1, 1, "data", 6), (2, 0, "zero", 5), (2, 1, "data", 6), (3, 0, "absent", 5)], "b long, layer int, state string, v long")
    assert rows(extents.layered_read(d, ["b"], "layer", "state", "v", [])) == [(1, 1, 6), (2, 0, 0), (3, None, 0)]


def test_overlaps_touching_spans_and_wide_spans(spark):
    s = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 5, 500), (2, 4, 0, 10)], "k long, id long, start long, end long")
    assert rows(volumes.overlapping_pairs(s, "k", "id")) == [(1, 1, 3), (1, 2, 3)]
    assert rows(volumes.overlapping_neighbours(s, "k", "id")) == [(1, 1, 3), (1, 3, 2)]


def test_deleted_versions(spark):
    d = spark.createDataFrame([("a", 1, 7), ("a", 2, 0), ("b", 1, 0)], "k string, version long, target long")
    assert rows(versions.latest_versions(d, ["k"], "version", "target", [])) == [("a", 1, 7)]
    assert rows(versions.latest_versions(d, ["k"], "version", "target", [], tombstones=True)) == []


def test_cycles_have_no_root_and_no_path(spark):
    n = spark.createDataFrame([("r", None, "R"), ("x", "r", "X"), ("y", "x", "Y"), ("p", "q", "P"), ("q", "p", "Q")], "node string, parent string, name string")
    assert rows(namespace.paths(n)) == [("r", "/R"), ("x", "/R/X"), ("y", "/R/X/Y")]
    got = {r["node"]: (r["root"], r["depth"]) for r in namespace.ancestors_doubled(n, "node", "parent").collect()}
    assert got == {"r": ("r", 0), "x": ("r", 1), "y": ("r", 2), "p": (None, None), "q": (None, None)}


def test_names_fold_alike(spark):
    d = spark.createDataFrame([(1, "STRASSE"), (2, "straße"), (3, "é"), (4, "e\u0301"), (5, None)], "i int, s string")
    got = {r["i"]: r["f"] for r in d.select("i", namespace.folded_name("s").alias("f")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] is None


def test_paths_with_parent_components_are_refused(spark):
    d = spark.createDataFrame([("//a/./b",), ("a/../b",), ("",)], "p string").select(namespace.normal_path(F.col("p")).alias("n"))
    assert [r["n"] for r in d.collect()] == ["/a/b", None, "/"]


def test_read_statistics_of_one_read_and_backward_seeks(spark):
    d = spark.createDataFrame([(1, 0, 100, 10), (2, 0, 100, 10), (2, 1, 0, 5)], "s long, n long, o long, l long")
    got = {r["s"]: (r["gap_sum"], r["gap_avg"], r["avg_bytes"]) for r in streams.read_statistics(d, "s", "n", "o", "l").collect()}
    assert got == {1: (0, 0, 10), 2: (110, 110, 7)}


def test_header_keeps_the_first_of_equal_names(spark):
    d = spark.createDataFrame([("a\tb\ta", "1\t2\t3"), ("a\tb", "1")], "n string, v string")
    assert [r[0] for r in d.select(zipped_header(F.col("n"), F.col("v"))).collect()] == [{"a": "1", "b": "2"}, {"a": "1", "b": None}]
    assert spark.range(5, 6).select(flag_names(F.col("id"), ["r", "w", "x"])).first()[0] == ["r", "x"]
