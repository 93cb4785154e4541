"""Quality rules with host verdicts.

Document rules are counted over the whole text. Rule failures are then aggregated by host, each host's failure
rate is shrunk towards all hosts by an empirical beta prior (method of moments over the hosts' rates), and hosts
whose shrunk rate passes a threshold are blocked; the verdict is joined back to the host's documents.

Scale: texts are read once and only counts per document are written (about 60 bytes a row). Hosts are pre-aggregated
before the shuffle; the prior is two numbers. The verdict join has one row per host on its small side and is left to
the planner: broadcast if its measured size allows, else a sort-merge join whose hot partitions AQE splits.

Defined results: a null text has no words and fails the base rule; an empty text too; a null host is one group of
its own and never blocked; ties in rates are equal verdicts; repeated rows count as often as they occur; an empty
table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.storage import materialise

#: White space that separates words: space and the controls 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: The further document rules, as percentages: symbols for each word, and repeated lines among the lines with a word.
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
#: A host is blocked when its shrunk failure rate is above this.
BLOCK_RATE = 0.6

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the text, the first occurrence included. Exact: no hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    base = len(seen)
    if base == len(words):
        return 0
    code = ids[:n].copy()
    room = np.iinfo(np.int64).max // base
    bound = base
    for k in range(1, window):
        if bound > room:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            bound = n
        code = code * base + ids[k : k + n]
        bound *= base
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _count_batches(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for batch in batches:
        rows = [text_counts(x.as_py() or "") for x in batch.column(2)]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch.columns[3:], *(pa.array(c, pa.int64()) for c in columns)], names=["row_key", "host", *carried, *names])


def document_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: tuple[Column, ...] = ()) -> DataFrame:
    """(row_key, host, any carried columns, counts…, base_failed, rule_failed) for every row; whole texts."""
    d = docs.select(F.col(id_col).alias("row_key"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("body"), *carry)
    schema = d.drop("body").schema
    for x in COUNTS.split(", "):
        schema = schema.add(*x.split())
    carried = d.columns[3:]
    counted = d.mapInArrow(lambda batches: _count_batches(batches, carried), schema)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    return counted.withColumn("base_failed", base).withColumn("rule_failed", base | more)


def host_verdicts(counted: DataFrame, block_rate: float = BLOCK_RATE) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_blocked).

    The beta prior has the mean m and variance v of the hosts' rates: alpha + beta = m (1 - m) / v - 1. Where the
    rates do not vary, or vary more than any beta could, the prior falls back to the weight of one document.
    """
    hosts = counted.filter("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("rule_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.when((F.col("v") > 1e-9) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1.0))
    prior = prior.select("m", F.greatest(weight, F.lit(1.0)).alias("weight"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return (
        hosts.join(F.broadcast(prior))  # one row, the result of an aggregate without keys
        .select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"))
        .withColumn("host_blocked", F.col("shrunk_rate") > block_rate)
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", block_rate: float = BLOCK_RATE, carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row per input row: the id, any carried columns, the counts, ``base_failed``, ``rule_failed``, ``shrunk_rate``, ``host_blocked``, ``kept``.

    A document is kept if it fails no document rule and its host is not blocked.
    """
    counted = materialise(document_counts(docs, id_col, text_col, host_col, carry), "rule-counts")
    # Written, so that the join below shuffles both sides itself where it cannot broadcast: AQE then splits a hot host.
    hosts = materialise(host_verdicts(counted, block_rate).select("host", "shrunk_rate", "host_blocked"), "host-verdicts")
    joined = counted.join(hosts, "host", "left").withColumn("host_blocked", F.coalesce("host_blocked", F.lit(False)))
    return joined.withColumn("kept", ~F.col("rule_failed") & ~F.col("host_blocked")).withColumnRenamed("row_key", id_col)
