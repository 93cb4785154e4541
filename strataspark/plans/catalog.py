"""The registered queries over the driver's tables and the SQL that gives the same rows.

The tables stand in for storage evidence: texts are sources, order lines are extents, events are patches and reads, and
so on. Every query runs over whole tables through the operators of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.checksums import weak_crc32
from strataspark.functions.text import canonical_id, flag_names, zipped_header
from strataspark.operators import extents, namespace, probe, streams, versions, volumes
from strataspark.operators.probe import Signature
from strataspark.plans import evidence  # noqa: F401 - registers its queries
from strataspark.plans.registry import ORACLE_SQL, QUERIES, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- probing -------------------------------------------------------------------------------------------------------

SIGNATURES = [
    Signature("archive.listing", "Archive", " | ", "Likely", None),
    Signature("image.page", "Image", "<!DOCTYPE html>", "Strong"),
    Signature("image.page-en", "Image", '<html lang="en"', "Exact", 15),
    Signature("volume.notice", "VolumeSystem", "License", "Exact", None),
    Signature("filesystem.prose", "FileSystem", "The ", "Weak"),
    Signature("filesystem.shout", "FileSystem", "!! ", "Strong", None),
    Signature("filesystem.markup", "FileSystem", "<", "Weak"),
]

_SIG = """
WITH sig(registration_index, format_id, kind, magic, pos, confidence, ord) AS (VALUES
  (0, 'archive.listing', 'Archive', ' | ', NULL, 'Likely', 1), (1, 'image.page', 'Image', '<!DOCTYPE html>', 1, 'Strong', 2),
  (2, 'image.page-en', 'Image', '<html lang="en"', 16, 'Exact', 3), (3, 'volume.notice', 'VolumeSystem', 'License', NULL, 'Exact', 3),
  (4, 'filesystem.markup', 'FileSystem', '<', 1, 'Weak', 0), (5, 'filesystem.prose', 'FileSystem', 'The ', 1, 'Weak', 0),
  (6, 'filesystem.shout', 'FileSystem', '!! ', NULL, 'Strong', 2)),
src AS (SELECT 'page' AS origin, page_id AS source_id, html AS head FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
m AS (SELECT origin, source_id, row_number() OVER (PARTITION BY origin, source_id ORDER BY ord DESC, registration_index) AS rank,
             registration_index, format_id, kind, confidence
      FROM src JOIN sig ON CASE WHEN pos IS NULL THEN contains(head, magic) ELSE substr(head, pos, length(magic)) = magic END {where})
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("source_id"), F.col("html").alias("head"))
    documents = table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("source_id"), F.col("text").alias("head"))
    return pages.unionByName(documents)


@query(_SIG.format(where="") + "SELECT * FROM m")
def q_probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.probe_all(sources(spark, sf_dir), SIGNATURES)


@query(
    _SIG.format(where="")
    + "SELECT s.origin, s.source_id, registration_index, format_id, kind, confidence FROM src s LEFT JOIN m ON m.origin = s.origin AND m.source_id = s.source_id AND rank = 1"
)
def q_probe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.probe_best(sources(spark, sf_dir), SIGNATURES)


@query(_SIG.format(where="WHERE kind = 'FileSystem'") + "SELECT * FROM m")
def q_probe_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.probe_all(sources(spark, sf_dir), SIGNATURES, kind="FileSystem")


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '\\.([a-zA-Z0-9]+)$', 1)) AS extension, split_part(url, '?', 1) AS base, url FROM pages),
u AS (SELECT DISTINCT url AS sibling FROM pages WHERE url NOT LIKE '%?%')
SELECT page_id, extension, sibling IS NOT NULL AS has_sibling,
       CASE WHEN extension = 'html' THEN 'Exact' WHEN sibling IS NOT NULL THEN 'Strong' ELSE 'Likely' END AS confidence
FROM p LEFT JOIN u ON p.base = u.sibling
""")
def q_probe_sibling_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select("page_id", F.lower(F.regexp_extract("url", r"\.([a-zA-Z0-9]+)$", 1)).alias("extension"), F.substring_index("url", "?", 1).alias("base"))
    siblings = pages.filter(~F.col("url").contains("?")).select(F.col("url").alias("sibling")).distinct()
    joined = named.join(siblings, named["base"] == siblings["sibling"], "left")
    has = F.col("sibling").isNotNull()
    confidence = F.when(F.col("extension") == "html", "Exact").when(has, "Strong").otherwise("Likely")
    return joined.select("page_id", "extension", has.alias("has_sibling"), confidence.alias("confidence"))


# --- extents -------------------------------------------------------------------------------------------------------

_MAP = """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS length,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset FROM lineitem)
"""


def line_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("length"))
    return extents.prefix_offsets(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "length")


@query(_MAP + "SELECT * FROM m")
def q_extent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_extents(spark, sf_dir)


@query("""
WITH e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS length FROM events)
SELECT user_id, event_id, length, CAST(coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset FROM e
""")
def q_extent_map_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for objects of any size: each user's events are summed in parts of the event order."""
    parts = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("length"))
    return extents.prefix_offsets(parts, "user_id", ["event_id"], "length", split=F.floor(F.col("event_id") / 1000))


@query(_MAP + """
SELECT o_orderkey AS l_orderkey, o_custkey % 90 AS point, m.logical_offset, m.length, m.l_linenumber
FROM orders LEFT JOIN m ON o_orderkey = l_orderkey AND o_custkey % 90 >= m.logical_offset AND o_custkey % 90 < m.logical_offset + m.length
""")
def q_extent_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 90).alias("point"))
    return extents.covering_extent(points, line_extents(spark, sf_dir), "l_orderkey", "point", ["l_linenumber"])


@query(_MAP + """,
k AS (SELECT * FROM m WHERE l_linenumber % 3 <> 0),
s AS (SELECT l_orderkey, sum(length) AS size FROM m GROUP BY l_orderkey),
b AS (SELECT l_orderkey, logical_offset, length, coalesce(max(logical_offset + length) OVER (PARTITION BY l_orderkey ORDER BY logical_offset, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM k),
t AS (SELECT s.l_orderkey, size, coalesce(max(logical_offset + length), 0) AS covered FROM s LEFT JOIN k USING (l_orderkey) GROUP BY s.l_orderkey, size)
SELECT l_orderkey, logical_offset, length, false AS is_hole FROM k
UNION ALL SELECT l_orderkey, CAST(past AS BIGINT), CAST(logical_offset - past AS BIGINT), true FROM b WHERE logical_offset > past
UNION ALL SELECT l_orderkey, CAST(covered AS BIGINT), CAST(size - covered AS BIGINT), true FROM t WHERE size > covered
""")
def q_extent_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = line_extents(spark, sf_dir)
    sizes = mapped.groupBy("l_orderkey").agg(F.sum("length").alias("size"))
    return extents.fill_holes(mapped.filter("l_linenumber % 3 <> 0"), sizes, "l_orderkey")


@query("""
WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
g AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS island FROM d)
SELECT l_suppkey, min(l_partkey) AS first_block, count(*) AS n_blocks FROM g GROUP BY l_suppkey, island
""")
def q_extent_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return extents.coalesce_runs(lines, ["l_suppkey"], "l_partkey", extents.range_parts(lines, "l_partkey"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey // 64 AS block, l_partkey % 64 AS within, l_partkey // 64 // 8 AS level1, l_partkey // 64 % 8 AS level2,
       l_partkey // 64 // 4 * 5 + l_partkey // 64 % 4 AS slot, CAST((l_suppkey >> (l_linenumber % 8)) & 1 AS INTEGER) AS allocated FROM lineitem
""")
def q_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    addressed = lines.withColumns(extents.block_address(F.col("l_partkey"), 64, 8))
    bit = F.getbit("l_suppkey", (F.col("l_linenumber") % 8).cast("int")).cast("int")
    return addressed.select("l_orderkey", "l_linenumber", "l_partkey", "block", "within", "level1", "level2", extents.interleaved_slot(F.col("block"), 4).alias("slot"), bit.alias("allocated"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
             CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS layer FROM lineitem),
t AS (SELECT *, CASE WHEN q % 7 = 0 THEN 'absent' WHEN q % 5 = 0 THEN 'zero' ELSE 'data' END AS state FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY layer, l_partkey, l_suppkey, CASE WHEN state = 'data' THEN q ELSE 0 END) AS n FROM t WHERE state <> 'absent'),
k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM s)
SELECT k.l_orderkey, k.l_linenumber, r.layer, CASE WHEN r.state = 'data' THEN r.q ELSE 0 END AS value
FROM k LEFT JOIN r ON k.l_orderkey = r.l_orderkey AND k.l_linenumber = r.l_linenumber AND n = 1
""")
def q_layered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    layer = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    state = F.when(q % 7 == 0, "absent").when(q % 5 == 0, "zero").otherwise("data")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", layer.alias("layer"), state.alias("state"), q.alias("q"))
    return extents.layered_read(lines, ["l_orderkey", "l_linenumber"], "layer", "state", "q", ["l_partkey", "l_suppkey"])


@query("""
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders),
c AS (SELECT o_orderkey, size, unnest(range(0, CAST(ceil(size / 65536.0) AS BIGINT))) AS chunk_index FROM o WHERE size > 0)
SELECT o_orderkey, chunk_index, chunk_index % 3 AS stripe, chunk_index // 3 AS row, least(65536, size - chunk_index * 65536) AS length FROM c
""")
def q_stripe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    return extents.stripe_map(orders, "o_orderkey", "size", chunk=65536, stripes=3)


@query("""
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS cents FROM events GROUP BY user_id, event_type
""")
def q_overlay_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return extents.last_writer(patches, ["user_id", "event_type"], "event_id", "cents")


@query(_MAP + """, s AS (SELECT l_orderkey, sum(length) + 7 AS data_end FROM m GROUP BY l_orderkey)
SELECT m.l_orderkey, l_linenumber, l_partkey, l_suppkey, logical_offset,
  CAST(coalesce(lead(logical_offset) OVER (PARTITION BY m.l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), data_end) - logical_offset AS BIGINT) AS stored_size
FROM m JOIN s ON m.l_orderkey = s.l_orderkey
""")
def q_neighbor_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = line_extents(spark, sf_dir)
    ends = mapped.groupBy("l_orderkey").agg((F.sum("length") + 7).alias("data_end"))
    sized = extents.stored_sizes(mapped.join(ends, "l_orderkey"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "logical_offset", "data_end")
    return sized.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "logical_offset", "stored_size")


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS same FROM documents")
def q_chunk_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rebuilt = extents.join_pieces(extents.split_text(documents, "doc_id", "text", 500), "doc_id", "rebuilt")
    own = documents.select("doc_id", F.md5("text").alias("own"))
    return rebuilt.select("doc_id", F.md5("rebuilt").alias("digest")).join(own, "doc_id").select("doc_id", "digest", (F.col("digest") == F.col("own")).alias("same"))


# --- volumes -------------------------------------------------------------------------------------------------------

_SPANS = """
WITH s AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS "start",
                  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 60 + 1 AS BIGINT) AS "end" FROM orders)
"""


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("start"), (day + F.col("o_orderkey") % 60 + 1).alias("end"))


@query(_SPANS + """
SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b FROM s x JOIN s y
  ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x."start" < y."end" AND y."start" < x."end"
""")
def q_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.overlapping_pairs(order_spans(spark, sf_dir), "o_custkey", "o_orderkey")


@query(_SPANS + """
SELECT o_custkey, a, b FROM (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER w AS b, "end" AS e, lead("start") OVER w AS n
  FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY "start", o_orderkey)) WHERE n < e
""")
def q_overlap_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = order_spans(spark, sf_dir)
    return volumes.overlapping_neighbours(spans, "o_custkey", "o_orderkey", extents.range_parts(spans, "start", 5000))


@query("""
WITH w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s FROM orders),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p
WHERE NOT EXISTS (SELECT 1 FROM w WHERE o_orderkey = l_orderkey AND d >= s AND d < s + 60)
""")
def q_containment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("start"), (day("l_shipdate") + 1).alias("end"))
    windows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("start"), (day("o_orderdate") + 60).alias("end"))
    return volumes.not_contained(lines, windows, "key").select(F.col("key").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")


@query("""
SELECT o_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS actual, o_orderkey % 200 AS declared FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderkey HAVING sum(CAST(l_quantity AS BIGINT)) > o_orderkey % 200
""")
def q_bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("end"))
    limits = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 200).alias("limit"))
    return volumes.out_of_bounds(spans, limits, "o_orderkey").select("o_orderkey", F.col("end").alias("actual"), F.col("limit").alias("declared"))


@query("""
SELECT c_custkey, c_mktsegment AS type_code,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Primary' WHEN 'MACHINERY' THEN 'Extended' WHEN 'AUTOMOBILE' THEN 'Metadata' ELSE 'Logical' END AS role FROM customer
""")
def q_role_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("type_code"))
    return volumes.with_roles(customers, "type_code", {"BUILDING": "Primary", "MACHINERY": "Extended", "AUTOMOBILE": "Metadata"}, "Logical")


# --- versions ------------------------------------------------------------------------------------------------------


@query("""
SELECT s_nationkey, s_suppkey, s_name FROM (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey
  ORDER BY CAST(round(s_acctbal) AS BIGINT) % 3 DESC, CAST(round(s_acctbal) AS BIGINT) DESC, s_suppkey) AS n FROM supplier) WHERE n = 1
""")
def q_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.round("s_acctbal").cast("long")
    return versions.best_copy(table(spark, sf_dir, "supplier"), ["s_nationkey"], [whole % 3, whole, -F.col("s_suppkey")], ["s_suppkey", "s_name"])


@query("""
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(target, event_id) AS target FROM
  (SELECT user_id, event_type, event_id, CAST(round(value * 100) AS BIGINT) % 4 AS target FROM events) WHERE target <> 0 GROUP BY user_id, event_type
""")
def q_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.round(F.col("value") * 100).cast("long") % 4).alias("target"))
    return versions.latest_versions(entries, ["user_id", "event_type"], "event_id", "target", [])


@query("""
SELECT * FROM (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(target, event_id) AS target FROM
  (SELECT user_id, event_type, event_id, CAST(round(value * 100) AS BIGINT) % 4 AS target FROM events) GROUP BY user_id, event_type) WHERE target <> 0
""")
def q_latest_version_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.round(F.col("value") * 100).cast("long") % 4).alias("target"))
    return versions.latest_versions(entries, ["user_id", "event_type"], "event_id", "target", [], tombstones=True)


@query("""
WITH q AS (SELECT o_orderkey, o_custkey AS oid, o_orderkey AS xid FROM orders),
f AS (SELECT q.o_orderkey, q.oid, q.xid, e.event_id, e.event_type, row_number() OVER (PARTITION BY q.o_orderkey ORDER BY e.event_id DESC) AS n
      FROM q JOIN events e ON e.user_id = q.oid AND e.event_id <= q.xid)
SELECT o_orderkey, oid, xid, event_id AS version FROM f WHERE n = 1 AND event_type <> 'error'
""")
def q_asof_floor_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version is chosen first; whether it is deleted is asked after."""
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("oid"), F.col("o_orderkey").alias("xid"))
    kept = table(spark, sf_dir, "events").select(F.col("user_id").alias("oid"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"))
    return extents.floor_join(wanted, kept, "oid", "xid", "version", ["deleted"], extents.range_parts(kept, "version", 10_000)).filter("NOT deleted").select("o_orderkey", "oid", "xid", "version")


@query("""
SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE 'Mixed' END AS method FROM orders GROUP BY o_custkey
""")
def q_single_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.single_kind(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@query("""
WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn // 2 END AS parent FROM conversations),
d AS (SELECT conv_id, turn, 0 AS depth FROM n WHERE parent IS NULL
      UNION ALL SELECT n.conv_id, n.turn, d.depth + 1 FROM n JOIN d ON n.conv_id = d.conv_id AND n.parent = d.turn AND n.turn > d.turn),
l AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = d.conv_id AND n.parent = d.turn AND n.turn > d.turn))
SELECT conv_id, CAST(max(depth) AS BIGINT) AS depth, count(*) AS leaves,
       (SELECT count(*) FROM l x WHERE x.conv_id = l.conv_id AND x.depth = max(l.depth)) > 1 AS ambiguous FROM l GROUP BY conv_id
""")
def q_leaf_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot to use is the deepest leaf; two at the same depth are ambiguous."""
    key = lambda turn: F.concat_ws("/", "conv_id", turn)
    parent = F.when(F.col("turn") > 0, key(F.floor(F.col("turn") / 2).cast("string")))
    nodes = table(spark, sf_dir, "conversations").select("conv_id", key(F.col("turn").cast("string")).alias("node"), parent.alias("parent"))
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")).filter("node is not null").distinct(), "node", "left_anti")
    depths = namespace.ancestors_doubled(nodes, "node", "parent").filter("root is not null")
    placed = leaves.join(depths, "node").groupBy("conv_id", "depth").agg(F.count("*").alias("n"))
    top = placed.groupBy("conv_id").agg(F.max(F.struct("depth", "n")).alias("top"), F.sum("n").alias("leaves"))
    return top.select("conv_id", F.col("top.depth").alias("depth"), "leaves", (F.col("top.n") > 1).alias("ambiguous"))


# --- namespace -----------------------------------------------------------------------------------------------------

_TREE = """
WITH RECURSIVE n AS (
  SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders),
p AS (SELECT node, '/' || name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.node, p.path || '/' || n.name FROM n JOIN p ON n.parent = p.node)
"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS node", "CAST(NULL AS string) AS parent", "r_name AS name")
    nation = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS node", "concat('r', n_regionkey) AS parent", "n_name AS name")
    customer = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS node", "concat('n', c_nationkey) AS parent", "c_name AS name")
    orders = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) AS node", "concat('c', o_custkey) AS parent", "CAST(o_orderkey AS string) AS name")
    return region.unionByName(nation).unionByName(customer).unionByName(orders)


@query(_TREE + "SELECT node, path FROM p")
def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.paths(tree(spark, sf_dir))


@query(_TREE + ", w AS (SELECT node AS wanted, path FROM p) SELECT wanted, p.node FROM w JOIN p ON p.path = w.path")
def q_resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with empty and ``.`` components, as a user may write them, resolve to the same nodes."""
    found = namespace.paths(tree(spark, sf_dir))
    written = found.select(F.col("node").alias("wanted"), F.concat(F.lit("/."), F.regexp_replace("path", "/", "//")).alias("asked"))
    return written.select("wanted", namespace.normal_path(F.col("asked")).alias("path")).join(found, "path").select("wanted", "node")


@query("SELECT 'n' || c_nationkey AS parent, count(*) AS children, min(c_name) AS first_child FROM customer GROUP BY c_nationkey")
def q_read_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = tree(spark, sf_dir).filter("parent LIKE 'n%'")
    return children.groupBy("parent").agg(F.count("*").alias("children"), F.min("name").alias("first_child"))


@query("""
SELECT md5(coalesce(text, '')) AS content, min('/' || source || '/' || doc_id) AS path, count(*) AS links FROM documents GROUP BY coalesce(text, '')
""")
def q_hardlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one content are links to one node; its path is the first of theirs."""
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    content = F.coalesce("text", F.lit(""))
    linked = table(spark, sf_dir, "documents").select(F.struct(F.sha2(content, 256).alias("key"), F.md5(content).alias("content")).alias("node"), path.alias("path"))
    first, links = namespace.first_paths(linked), linked.groupBy("node").agg(F.count("*").alias("links"))
    return first.join(links, "node").select("node.content", "path", "links")


@query("""
WITH u AS (SELECT page_id, '/' || split_part(split_part(url, '://', 2), '#', 1) AS path FROM pages),
x AS (SELECT page_id, '/' || regexp_extract(path, '^/[^/]*/([^?]*)', 1) AS path FROM u),
f(pre) AS (VALUES ('/en'), ('/de'), ('/en/7'), ('/fr'))
SELECT page_id, coalesce((SELECT pre FROM f WHERE path = pre OR starts_with(path, pre || '/') ORDER BY length(pre) DESC, pre LIMIT 1), 'System') AS overlay FROM x
""")
def q_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.regexp_extract(F.substring_index(F.split_part("url", F.lit("://"), F.lit(2)), "#", 1), "^[^/]*/([^?]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", namespace.longest_prefix(path, ["/en", "/de", "/en/7", "/fr"], "System").alias("overlay"))


@query("SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS folded FROM customer")
def q_name_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of A-Z fold as in SQL; other letters are tested against a plain version."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))
    return names.select("c_custkey", namespace.folded_name("name").alias("folded"))


# --- streams and aggregates ----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, nullif(l_returnflag, 'N') AS name, count(*) AS n_parts, max(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY 1, 2")
def q_stream_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("name"), F.col("l_quantity").cast("long").alias("size"))
    return streams.grouped_streams(parts, "l_orderkey", "name", "size")


@query("""
WITH r AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS first_vcn, CAST(l_linenumber AS BIGINT) AS next_vcn FROM lineitem),
e AS (SELECT *, coalesce(lag(next_vcn) OVER (PARTITION BY l_orderkey ORDER BY first_vcn), 0) AS expected FROM r)
SELECT * FROM e WHERE first_vcn <> expected
""")
def q_vcn_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber").cast("long")
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", (line - 1).alias("first_vcn"), line.alias("next_vcn")).distinct()
    return streams.run_gaps(runs, ["l_orderkey"], "first_vcn", "next_vcn")


@query("""
WITH s AS (SELECT source, doc_id, n_chars // 4096 AS size FROM documents),
a AS (SELECT source, count(*) AS n_segments, arg_min(size, doc_id) AS full_size, arg_max(size, doc_id) AS last_size, min(doc_id) AS lo, max(doc_id) AS hi FROM s GROUP BY source),
o AS (SELECT s.source, min(size) AS least, max(size) AS most FROM s JOIN a ON s.source = a.source AND doc_id <> hi GROUP BY s.source)
SELECT a.source, n_segments, full_size, last_size, n_segments > 1 AND least = most AS equal_but_last, hi - lo + 1 = n_segments AS contiguous FROM a LEFT JOIN o ON a.source = o.source
""")
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4096).cast("long").alias("size"))
    return streams.segment_checks(parts, "source", "doc_id", "size")


@query("""
WITH t AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS off, event_id % 512 + 1 AS len FROM events),
g AS (SELECT *, abs(off - lag(off + len) OVER (PARTITION BY user_id ORDER BY event_id)) AS gap FROM t)
SELECT user_id, count(*) AS reads, CAST(sum(len) AS BIGINT) AS bytes, max(len) AS max_bytes, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gap_sum, coalesce(max(gap), 0) AS gap_max,
  CAST(sum(len) AS BIGINT) // count(*) AS avg_bytes, CASE WHEN count(*) > 1 THEN CAST(sum(gap) AS BIGINT) // (count(*) - 1) ELSE 0 END AS gap_avg FROM g GROUP BY user_id
""")
def q_read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("off"), (F.col("event_id") % 512 + 1).alias("len"))
    return streams.read_statistics(trace, "user_id", "event_id", "off", "len", split=F.floor(F.col("event_id") / 1000))


@query("""
SELECT s_nationkey, count(*) AS members, string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey) AS listing FROM supplier GROUP BY s_nationkey
""")
def q_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name")))
    text = F.array_join(F.transform(members, lambda x: F.concat_ws(":", x["s_suppkey"].cast("string"), x["s_name"])), ",")
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("members"), text.alias("listing"))


@query("""
SELECT o_orderkey AS l_orderkey, CAST(sum(CASE WHEN l_partkey % 100 + l_suppkey % 30 + 1 <= o_custkey % 130 THEN l_suppkey % 30 + 1 ELSE 0 END) AS BIGINT) AS covered, o_custkey % 130 AS declared,
       sum(CASE WHEN l_partkey % 100 + l_suppkey % 30 + 1 <= o_custkey % 130 THEN l_suppkey % 30 + 1 ELSE 0 END) = o_custkey % 130 AS ok FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey
""")
def q_covered_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).alias("start"), (F.col("l_suppkey") % 30 + 1).alias("length"))
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 130).alias("size"))
    return streams.covered_sizes(blocks, declared, "l_orderkey", "start", "length", "size")


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events)")
def q_dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "events").select("user_id")).distinct()


# --- scalar functions ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def q_digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")
def q_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB has no crc32: Spark's own is held against the one with a start value of its own."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("bytes"))
    own = weak_crc32(0xFFFFFFFF)("bytes").bitwiseXOR(F.lit(0xFFFFFFFF))
    return docs.select("doc_id", (F.crc32("bytes") == own).alias("same"))


@query("SELECT event_id, regexp_extract(props, '\"([a-z]+)\": *([0-9]+)', 1) AS key, CAST(regexp_extract(props, '\"([a-z]+)\": *([0-9]+)', 2) AS BIGINT) AS value FROM events")
def q_kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = r'"([a-z]+)": *([0-9]+)'
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", pair, 1).alias("key"), F.regexp_extract("props", pair, 2).cast("long").alias("value"))


@query("SELECT c_custkey, c_name AS n, c_mktsegment AS s, CAST(NULL AS VARCHAR) AS missing FROM customer")
def q_zip_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = zipped_header(F.lit("n\ts\tn\tx"), F.concat_ws("\t", "c_name", "c_mktsegment", F.lit("again")))
    return table(spark, sf_dir, "customer").select("c_custkey", header.alias("h")).select("c_custkey", F.col("h")["n"].alias("n"), F.col("h")["s"].alias("s"), F.col("h")["x"].alias("missing"))


@query("""
SELECT p_partkey, array_to_string(list_filter(['r', 'w', 'x', 's', 't', 'h'], lambda v, i: (p_size >> CAST(i - 1 AS INTEGER)) & 1 = 1), '|') AS names FROM part
""")
def q_flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(flag_names(F.col("p_size"), list("rwxsth")), "|").alias("names"))


@query("SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS pv_id FROM supplier")
def q_canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", canonical_id(F.col("s_name")).alias("pv_id"))
