"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so, each distinct chunk gets one identifier that is verified on the
chunk's content, and two texts are equal exactly when their ordered identifier lists are equal. Chunk text is
shuffled once, after a map-side distinct; documents are grouped and joined by their short recipes alone.

Plan: the distinct chunks are grouped by 64-bit hash. A hash with one content is itself the identifier. Contents
that share a hash are told apart by a variant number, and only documents that hold such a chunk get a patch list,
so equal (hash list, patch list) pairs mean equal texts, without trust in the hash.

Defined results: a null text is the empty text; texts are compared unchanged; rows with a null id take part in
groups (``keep_id`` is the largest non-null id, null if there is none) and are kept only if the whole group has no
id; rows that repeat an id and its text share one verdict; an empty table gives an empty result. Columns other
than the two named are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.storage import materialise

#: A chunk ends after white space, a full stop or a comma that stands before one of these letters, at 256 to 4,096
#: characters. Text without such places is cut every 4,096 characters, so chunks are bounded in any script.
CHUNK = r"(?s).{256,4096}?[\s.,](?=[b-dg-hm-pstwB-DG-HM-PSTW])|.{1,4096}"


def chunks(text: Column) -> Column:
    """The text as consecutive chunks; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_table(docs: DataFrame) -> DataFrame:
    """(h, chunk): each distinct chunk once; duplicates are dropped before the shuffle."""
    return docs.select(F.explode(chunks(F.col("body"))).alias("chunk")).select(_hash(F.col("chunk")).alias("h"), "chunk").distinct()


def _patches(docs: DataFrame, recipes: DataFrame, variants: DataFrame) -> DataFrame:
    """(text_sha256, patch): for texts with a chunk whose hash has several contents, the variant of each such chunk."""
    hit = recipes.select("text_sha256", F.explode("recipe").alias("h")).join(variants.select("h").distinct(), "h", "left_semi").select("text_sha256").distinct()
    held = docs.withColumn("text_sha256", F.sha2("body", 256)).join(hit, "text_sha256", "left_semi")
    placed = held.select("text_sha256", F.posexplode(chunks(F.col("body"))).alias("pos", "chunk")).withColumn("h", _hash(F.col("chunk")))
    return placed.join(variants, ["h", "chunk"]).groupBy("text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "variant"))).alias("patch"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    body = docs.select(F.col(id_col).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    recipes = materialise(
        body.select("row_key", F.transform(chunks(F.col("body")), _hash).alias("recipe"), F.sha2(F.col("body"), 256).alias("text_sha256")), "recipes"
    )
    shared = materialise(chunk_table(body).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared-hashes")
    none = F.array().cast("array<struct<pos:int,variant:int>>")
    if shared.isEmpty():  # the usual case: every hash has one content
        named = recipes.withColumn("patch", none)
    else:
        several = chunk_table(body).join(shared, "h", "left_semi")
        variants = several.groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("of")).select("h", F.posexplode("of").alias("variant", "chunk"))
        patches = _patches(body, recipes, variants)
        named = recipes.join(patches, "text_sha256", "left").withColumn("patch", F.coalesce("patch", none))
    # The groups are written so that the join shuffles both sides itself: AQE can then split the partition of a hot group.
    groups = materialise(named.groupBy("recipe", "patch").agg(F.max("row_key").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    return named.join(groups, ["recipe", "patch"]).select(
        F.col("row_key").alias(id_col), "keep_id", "group_size", F.col("row_key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
