"""The registered queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.byte_bpe import encode_documents
from strataspark.llm.exact_dedup import exact_duplicates
from strataspark.llm.language_id import learn_prototypes, predict_language
from strataspark.llm.near_dedup import near_duplicates
from strataspark.llm.packing import pack_documents
from strataspark.llm.quality_mil import learn_quality, score_quality
from strataspark.llm.quality_rules import quality_rules
from strataspark.llm.split import held_out
from strataspark.llm.storage import new_path
from strataspark.llm.token_counts import prefix_counts
from strataspark.llm.token_records import with_starts, write_index, write_records
from strataspark.llm.url_filter import filter_urls

TOKEN_LIMIT = 2048
#: The contract's rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL for the trees: hosts, paths and rules are tested against brute force."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tested against the reference library of the rank file."""
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tested by held-out accuracy."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn_quality(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score_quality(docs, model, carry=(held_out(F.col("doc_id")).alias("held_out"),))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tested against the library's encoding of every prefix."""
    docs = table(spark, sf_dir, "documents")
    return prefix_counts(docs, public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT, store=False).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chunks")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    prototypes = learn_prototypes(docs.filter(~held_out(F.col("doc_id"))))
    return predict_language(docs, prototypes, carry=(held_out(F.col("doc_id")).alias("held_out"),))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tested by an exact round trip."""
    path = new_path(spark, "token-records")
    write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    index = write_index(spark, path, f"{path}-index")
    return with_starts(index).selectExpr("row_key AS doc_id", "start", "n_tokens", "ids_crc32")


def packed(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tested against the library's ids and for exact cover."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_mil": op5_quality_mil,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_records": op9_token_records,
    "op10_packing": op10_packing,
}

OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines AS more_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR more_failed) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
q AS (SELECT m, greatest(CASE WHEN v > 1e-9 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1.0 END, 1.0) AS k FROM p),
b AS (SELECT source, (bad + m * k) / (n + k) > 0.6 AS blocked FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR more_failed) AND NOT coalesce(blocked, false) AS kept
FROM f LEFT JOIN b USING (source)
"""

OP8_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3]))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op8_near_dedup": OP8_SQL}
