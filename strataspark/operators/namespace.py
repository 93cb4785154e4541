"""Hierarchies: paths, path lookup, hard links, prefix overlays, name folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspark.functions.text import utf8_text
from strataspark.sources.tables import Rounds


def ancestors_doubled(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth): pointer doubling, so a chain of n links needs log2(n) joins; roots have a null parent.

    Rounds are written tables and end when no further node reaches its root: those left lie on a cycle, below one, or below
    a parent that has no row, and get a null root."""
    rounds = Rounds(nodes.sparkSession)
    now = rounds.write(nodes.select(F.col(node), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(F.col(parent).isNull(), F.col(node)).alias("root")))
    open_, before = now.filter("root IS NULL").count(), None
    while open_ and open_ != before:
        above = now.select(F.col(node).alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        joined = now.join(above, F.when(F.col("root").isNull(), F.col("up")) == F.col("_n"), "left")
        reached = F.col("_root").isNotNull() & F.col("root").isNull()
        moved = F.col("_up").isNotNull() & F.col("root").isNull()
        now = rounds.write(
            joined.select(node, F.when(moved, F.col("_up")).otherwise(F.col("up")).alias("up"), (F.col("depth") + F.when(reached | moved, F.col("_depth")).otherwise(0)).alias("depth"), F.coalesce("root", "_root").alias("root"))
        )
        before, open_ = open_, now.filter("root IS NULL").count()
    return now.select(node, "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def paths(nodes: DataFrame) -> DataFrame:
    """(node, path): from (node, parent, name), roots with a null parent. Paths double in each round, so a tree of depth n
    needs log2(n) joins; a node on a cycle, below one, or below a parent without a row has no path and no row."""
    rounds = Rounds(nodes.sparkSession)
    now = rounds.write(nodes.select("node", F.col("parent").alias("at"), F.concat(F.lit("/"), "name").alias("path")))
    open_, before = now.filter("at IS NOT NULL").count(), None
    while open_ and open_ != before:
        above = now.select(F.col("node").alias("_n"), F.col("at").alias("_at"), F.col("path").alias("_path"))
        joined = now.join(above, F.col("at") == F.col("_n"), "left")
        found = F.col("_n").isNotNull()
        now = rounds.write(joined.select("node", F.when(found, F.col("_at")).otherwise(F.col("at")).alias("at"), F.when(found, F.concat("_path", "path")).otherwise(F.col("path")).alias("path")))
        before, open_ = open_, now.filter("at IS NOT NULL").count()
    return now.filter("at IS NULL").select("node", "path")


def all_paths(dirents: DataFrame, root: int) -> DataFrame:
    """(node, path): every path of every node, as hard links give several; from (parent, name, node, kind). The root's own
    path is empty and has no row. Directories have one entry each, so their paths double; other entries add one step."""
    folders = dirents.filter("kind = 'Directory'").select("node", F.when(F.col("parent") != root, F.col("parent")).alias("parent"), "name")
    above = paths(folders).select(F.col("node").alias("_n"), F.col("path").alias("_path"))
    at = dirents.join(above, F.col("parent") == F.col("_n"), "left").filter((F.col("parent") == root) | F.col("_n").isNotNull())
    return at.select("node", F.concat(F.coalesce("_path", F.lit("")), F.lit("/"), "name").alias("path"))


def first_paths(path_rows: DataFrame) -> DataFrame:
    """(node, path): the first path of each node in byte order."""
    return path_rows.groupBy("node").agg(F.min("path").alias("path"))


def nodes_by_id(requests: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Each request with the columns of its node and ``found``."""
    n = nodes.withColumn("_there", F.lit(True)).withColumnRenamed(key, "_id")
    return requests.join(n, F.col(key) == F.col("_id"), "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there", "_id")


#: Rows of a folder's requests, and of its children, that meet in one block.
BLOCK = 1024

#: Pairs of blocks to a task: some 64 million rows of the result.
TASK_PAIRS = 64


def read_dir(requests: DataFrame, nodes: DataFrame, dirents: DataFrame) -> DataFrame:
    """(request_id, status, name, node_id, kind): the children of each request's ``node_id``, in no order; a request for what
    is no directory, or not there, is one row with its status alone. An empty directory has no rows.

    The result has a row for each request and child, so a folder that is often asked for is quadratic by nature. Its requests
    and its children are dealt to blocks by hash, and each block of the one meets each of the other in a task of its own turn.
    The number of tasks follows the pairs of blocks, and the join that makes the rows is the last step, so that what reads
    them is compiled with it: a union above it would copy every row."""
    asked = requests.join(nodes.select(F.col("node_id").alias("_id"), F.col("kind").alias("_kind")), F.col("node_id") == F.col("_id"), "left")
    status = F.when(F.col("_id").isNull(), "NotFound").when(F.col("_kind") != "Directory", "InvalidFormat").otherwise("Ok")
    asked = asked.select("request_id", F.col("node_id").alias("_asked"), status.alias("status"))
    # What has no children to meet has no folder: a null key, which meets nothing and stays.
    asked = asked.select("request_id", "status", F.when(F.col("status") == "Ok", F.col("_asked")).alias("_dir"))
    children = dirents.select(F.col("parent_id").alias("_parent"), "name", F.col("node_id").cast("long").alias("node_id"), "kind")
    blocks = lambda df, key, name: df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_d")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = Rounds(requests.sparkSession).write(blocks(asked, "_dir", "_ni").join(blocks(children, "_parent", "_nj"), "_d"))
    pairs = grid.agg(F.sum(F.col("_ni").cast("long") * F.col("_nj"))).first()[0] or 0
    parts = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, -(-pairs // TASK_PAIRS)))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.join(grid, F.col("_dir") == F.col("_d"), "left").filter("_dir IS NULL OR _d IS NOT NULL")
    right = children.join(grid, F.col("_parent") == F.col("_d"))
    # Rows are dealt before each is repeated for the blocks it meets, as those of one folder may lie in one partition; to few
    # tasks, as each of them writes to all parts.
    few = max(requests.sparkSession.sparkContext.defaultParallelism, parts // 16)
    left = left.repartition(few, "request_id").select("_dir", "request_id", "status", own(F.coalesce("_ni", F.lit(parts)), "request_id").alias("_i"), every(F.coalesce("_nj", F.lit(1))).alias("_j"))
    right = right.repartition(few, "name", "node_id").select("_parent", "name", "node_id", "kind", own(F.col("_nj"), "name", "node_id").alias("_b"), every(F.col("_ni")).alias("_a"))
    # Blocks are small and what they make is not: their number of partitions stands, and none is broadcast.
    left, right = left.repartition(parts, "_dir", "_i", "_j"), right.repartition(parts, "_parent", "_a", "_b").hint("merge")
    rows = left.join(right, (F.col("_dir") == F.col("_parent")) & (F.col("_i") == F.col("_a")) & (F.col("_j") == F.col("_b")), "left")
    return rows.filter("_dir IS NULL OR _parent IS NOT NULL").select("request_id", "status", "name", "node_id", "kind")


def lookup_names(requests: DataFrame, dirents: DataFrame, folded: bool = False) -> DataFrame:
    """Each request (request_id, parent_id, name) with the first child of that name, by ``ordinal``, or null; ``folded``
    compares decomposed and case-folded names."""
    key = folded_name if folded else (lambda c: F.col(c))
    d = dirents.select("parent_id", key("name").alias("_name"), "node_id", "ordinal").groupBy("parent_id", "_name").agg(F.min_by("node_id", "ordinal").alias("node_id"))
    return requests.withColumn("_name", key("name")).join(d, ["parent_id", "_name"], "left").drop("_name")


def find_paths(requests: DataFrame, path_rows: DataFrame) -> DataFrame:
    """Each request (request_id, path) with the node at the path, after empty components and ``.`` are dropped; ``status`` is
    Unsupported for a path with ``..``, NotFound where nothing stands."""
    p = path_rows.select(F.col("node").alias("node_id"), F.col("path").alias("_path"))
    asked = requests.withColumn("_wanted", normal_path(F.col("path")))
    joined = asked.join(p, F.col("_wanted") == F.col("_path"), "left")
    status = F.when(F.col("_wanted").isNull(), "Unsupported").when(F.col("node_id").isNull(), "NotFound").otherwise("Ok")
    return joined.withColumn("status", status).drop("_wanted", "_path")


def firmlinks(path_rows: DataFrame, attributes: DataFrame, attribute: str) -> DataFrame:
    """(node, path, target): the paths of nodes that have the attribute, whose value is the target."""
    a = attributes.filter(F.col("name") == attribute).select("node", F.col("value").alias("target"))
    return path_rows.join(a, "node").select("node", "path", "target")


def overlay_roots(path_rows: DataFrame, sources: DataFrame, default: str) -> DataFrame:
    """The paths with ``root``: the longest of ``sources`` (path) that the path equals or lies below, else the default.

    A path is exploded into itself and what it lies below, which meet the sources in an equi-join: rows are linear in depth."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    rows = path_rows.withColumn("_row", F.monotonically_increasing_id())
    met = rows.select("_row", F.explode(above).alias("_p")).join(sources.select(F.col("path").alias("_p")).distinct(), "_p")
    best = met.groupBy("_row").agg(F.max_by("_p", F.length("_p")).alias("_root"))
    return rows.join(best, "_row", "left").withColumn("root", F.coalesce("_root", F.lit(default))).drop("_row", "_root")


def hard_links(nodes: DataFrame, hidden: DataFrame, prefix: str) -> DataFrame:
    """(node_id, target_id, size): visible nodes with their target's size where they link to one. Hidden directories, their
    children, and nodes whose name starts with ``prefix`` are left out.

    ``nodes`` has (node_id, parent_id, name, size, link_id: null if it is no link), ``hidden`` (node_id)."""
    target = nodes.select(F.col("node_id").alias("target_id"), F.col("size").alias("_size"))
    shown = nodes.filter(~F.col("name").startswith(prefix))
    for column in ("node_id", "parent_id"):
        shown = shown.join(hidden.select(F.col("node_id").alias("_hidden")), F.col(column) == F.col("_hidden"), "left_anti")
    joined = shown.join(target, F.col("link_id") == F.col("target_id"), "left")
    return joined.select("node_id", "target_id", F.coalesce("_size", "size").alias("size"))


def children_by_scan(requests: DataFrame, indexed: DataFrame, records: DataFrame) -> DataFrame:
    """(node_id, name, child_id, from_index): the children of each node from its index, or from all records where it has none.

    ``indexed`` and ``records`` have (parent_id, name, child_id); a node of ``requests`` is (node_id, has_index)."""
    one = requests.filter("has_index").join(indexed, F.col("node_id") == F.col("parent_id")).select("node_id", "name", "child_id", F.lit(True).alias("from_index"))
    return one.union(requests.filter("NOT has_index").join(records, F.col("node_id") == F.col("parent_id")).select("node_id", "name", "child_id", F.lit(False).alias("from_index")))


def merged_attributes(own: DataFrame, extensions: DataFrame) -> DataFrame:
    """(node_id, kind, name, record): the attributes of a node's base record and of the records that its list names, each once,
    with the least record that has it. ``own`` has (node_id, kind, name), ``extensions`` also (record)."""
    every = own.withColumn("record", F.col("node_id")).select("node_id", "kind", "name", "record").union(extensions.select("node_id", "kind", "name", "record"))
    return every.groupBy("node_id", "kind", "name").agg(F.min("record").alias("record"))


def symlink_targets(links: DataFrame, stored: DataFrame, attributes: DataFrame, attribute: str) -> DataFrame:
    """(node_id, target): text inside the node, else what is stored in its data, else the attribute; up to the first NUL.

    ``links`` has (node_id, inline), ``stored`` (node_id, data), ``attributes`` (node_id, name, value); all bytes."""
    text = lambda c: F.nullif(F.get(F.split(utf8_text(F.col(c)), "\u0000"), F.lit(0)), F.lit(""))
    a = attributes.filter(F.col("name") == attribute).select("node_id", "value")
    joined = links.join(stored.select("node_id", "data"), "node_id", "left").join(a, "node_id", "left")
    return joined.select("node_id", F.coalesce(text("inline"), text("data"), text("value")).alias("target"))


def normal_path(path: Column) -> Column:
    """Components without empty ones and ``.``, joined again; null if there is a ``..``."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.when(~F.exists(parts, lambda x: x == ".."), F.concat(F.lit("/"), F.array_join(parts, "/")))


def longest_prefix(path: Column, prefixes: list[str], default: str) -> Column:
    """The longest of the prefixes that the path equals or continues after a ``/``."""
    order = sorted(prefixes, key=lambda p: (-len(p), p))
    return F.coalesce(*(F.when((path == p) | path.startswith(p + "/"), F.lit(p)) for p in order), F.lit(default))


@F.pandas_udf(T.StringType())
def folded_name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical decomposition, then full case folding, so that names which a case-insensitive volume treats alike agree."""
    for names in batches:
        yield names.map(lambda x: None if x is None else unicodedata.normalize("NFD", unicodedata.normalize("NFD", x).casefold()))
