"""The corpus pipeline: each stage applies one operator to all rows that its predecessor kept.

Stages: quality rules, language ID, exact dedup, near-duplicates, packing. All but the last return the columns of
``documents``; each stage's result is written as Parquet and read again before the next. There is no SQL for the whole:
language ID, banding and tokens cannot be said in it; the stages are tested against brute force.

Defined results, stage by stage. Verdicts go with rows, not with ids, so repeated and null ids change nothing but ties.

- ``quality_rules``: null and empty texts have no words and go; a null source is no host and never blocked.
- ``language_id``: texts without letters go; rows without a language are judged like others but not learned from; if no
  row has a language, every text with a letter stays.
- ``exact_dedup``: of equal texts one row stays, with the largest id, one without id only if none has one; of rows equal
  in id and text the least by source, language and length stays.
- ``near_dedup``: of linked texts one row stays, with the smallest id; texts of fewer than five words are one shingle;
  texts without words are linked with nothing and each id keeps one row of each such text.
- ``packing``: every remaining row is packed whole, in pieces.

Texts of any length are read whole. An empty table, or one of which nothing stays, gives an empty result with the same
columns. Columns other than those of ``documents`` are not read and do not come out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.exact_dedup import exact_duplicates
from strataspark.llm.language_id import learn_prototypes, predict_language
from strataspark.llm.near_dedup import near_components
from strataspark.llm.packing import pack_documents
from strataspark.llm.quality_rules import quality_rules
from strataspark.llm.storage import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best cosine is below this reads like none of the learned languages; see the README for the cosines.
MIN_LANGUAGE_SCORE = 0.2
#: The pipeline's near-duplicates: five words, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _keep_one(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``chosen`` (kept_id, kept_sha256, copies: the rows with this id and text).

    Merged whatever the number of rows now, as it grows with the corpus. Of copies, which may differ in the other
    columns, the least stays."""
    chosen = materialise(chosen, "chosen-rows")
    hashed = docs.withColumn("row_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row_sha256") == F.col("kept_sha256"))
    held = lambda copies: hashed.join(chosen.filter(copies).hint("merge"), same, "left_semi")
    single = held("copies = 1").select(*COLUMNS)
    if chosen.filter("copies > 1").isEmpty():  # the usual case
        return single
    least = held("copies > 1").groupBy("doc_id", "row_sha256").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("row"))
    return single.union(least.select("doc_id", *(F.col(f"row.{c}") for c in COLUMNS[1:])))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule or whose host is blocked."""
    rest = tuple(F.col(c) for c in COLUMNS[1:])  # carried along: ids may repeat or be null
    return quality_rules(docs, carry=rest).filter("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and, if any language could be learned, those that read like none."""
    rest = tuple(F.col(c) for c in COLUMNS[1:])  # carried along, so that no row has to be found again
    prototypes = learn_prototypes(docs)
    if not prototypes:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = predict_language(docs, prototypes, carry=rest)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, one with the group's largest id."""
    kept = exact_duplicates(docs).filter("kept")
    return _keep_one(docs, kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256")).agg(F.count("*").alias("copies")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, one with the group's smallest id, and one of each text without words."""
    counted = near_components(docs, shingle=SHINGLE, percent=PERCENT).groupBy("root", "id", "text_sha256").agg(F.count("*").alias("copies"))
    rows = materialise(counted, "component-rows")
    least = F.min(F.struct(F.col("id").isNull(), "id", "text_sha256", "copies")).alias("row")
    linked = rows.filter("root is not null").groupBy("root").agg(least).select("row.id", "row.text_sha256", "row.copies")
    chosen = linked.union(rows.filter("root is null").select("id", "text_sha256", "copies"))
    return _keep_one(docs, chosen.toDF("kept_id", "kept_sha256", "copies"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
