"""URL filters: allow and block rules by host and path, and gradient-boosted trees for URLs that no rule decides.

Lexical features (lengths, depth, digit ratio, character entropy, parameter and hyphen counts, and how often URLs of the
same host suffix were blocked) are DataFrame expressions; Spark's gradient-boosted trees learn from labelled URLs. Here
the labels are the rules' own verdicts, so the model carries the rules' pattern on to hosts they do not name.

Suffix statistics cover all labelled rows; they are a written table that is joined as its size allows. The trees learn
from a bounded sample (``MAX_LABELLED`` distinct URLs, half of them for each label, chosen by hash and weighted back to
the labels' shares of distinct URLs). Scoring reads the URL column alone.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and goes to the model; of
rules that fit, the longest wins, then the first given; with labels of one kind only, or none, the model's verdict is
that kind, or allow; repeated rows get the same verdict; an empty table gives an empty result. Only the two named columns
are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.storage import materialise

#: (verdict, host, path start); a rule fits its host and all subdomains.
Rule = tuple[str, str, str]

MAX_LABELLED = 20_000
TREES, DEPTH, SEED = 12, 3, 17
#: Labelled URLs that a suffix's block rate is shrunk by, towards the overall rate.
SUFFIX_WEIGHT = 20
FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "suffix_rate")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case, and the path up to ``?`` or ``#``."""
    text = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER), F.regexp_extract(text, parts, 2)


def rule_text(rule: Rule) -> str:
    return rule[1] + rule[2]


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The position of the longest rule that fits, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rule_text(rules[i])), i))
    fits = [F.when(((host == rules[i][1]) | host.endswith("." + rules[i][1])) & path.startswith(rules[i][2]), F.lit(i)) for i in order]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_remove(F.array_distinct(F.split(text, "")), "")
    total = F.aggregate(letters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds the features but the suffix rate, and ``suffix``, to rows with ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "host_depth": _count(F.col("host"), r"\."),
            "path_depth": _count(F.col("path"), "/"),
            "digit_ratio": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "entropy": entropy(url),
            "n_params": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0),
            "n_hyphens": _count(F.col("host"), "-"),
            "suffix": suffix(F.col("host")),
        }
    )


def _vectors(df: DataFrame, rates: DataFrame, overall: float) -> DataFrame:
    joined = df.join(rates, "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(overall)))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)


def learn(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, float, GBTClassificationModel | None]:
    """From rows with url, host, path and label (1: block): suffix rates, the overall rate and the trees, if both labels occur."""
    known = labelled.select("url", "host", "path", "label")
    seen = known.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = seen["n"], seen["blocked"] or 0
    overall = blocked / n if n else 0.0
    rate = (F.sum("label") + SUFFIX_WEIGHT * overall) / (F.count("*") + SUFFIX_WEIGHT)
    rates = materialise(known.groupBy(suffix(F.col("host")).alias("suffix")).agg(rate.alias("suffix_rate")), "suffix-rates")
    if blocked in (0, n):
        return rates, overall, None
    urls = materialise(known.distinct(), "labelled-urls")
    of_label = {r["label"]: r["count"] for r in urls.groupBy("label").count().collect()}  # two rows
    most = max(1, max_labelled // 2)
    parts = [urls.filter(F.col("label") == x).orderBy(F.xxhash64("url"), "url").limit(most).withColumn("weight", F.lit(of_label[x] / min(of_label[x], most))) for x in (0, 1)]
    sample = materialise(lexical_features(parts[0].union(parts[1])), "sampled-urls")
    mine = rates.join(F.broadcast(sample.select("suffix").distinct()), "suffix", "left_semi")  # at most max_labelled rows
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    return rates, overall, trees.fit(_vectors(sample, F.broadcast(mine), overall).select("features", "weight", F.col("label").cast("double")).coalesce(4))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule`` (its text, or null), ``verdict`` and ``model_block`` (0 or 1)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("row_key"), F.col(url_col).cast("string").alias("url"))
    parsed = urls.withColumns({"host": host, "path": path}).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    texts, verdicts = F.array(*(F.lit(rule_text(r)) for r in rules)), F.array(*(F.lit(r[0]) for r in rules))
    ruled = parsed.withColumns({"rule": F.get(texts, F.col("fit")), "ruled": F.get(verdicts, F.col("fit"))})
    labelled = ruled.filter("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("int"))
    rates, overall, trees = learn(labelled)
    if trees is None:
        scored = ruled.withColumn("model_block", F.lit(int(overall > 0.5)))
    else:
        scored = trees.transform(_vectors(lexical_features(ruled), rates, overall)).withColumn("model_block", F.col("prediction").cast("int"))
    verdict = F.coalesce("ruled", F.when(F.col("model_block") == 1, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col("row_key").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "model_block")
