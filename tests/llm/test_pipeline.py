"""The pipeline's stages, one after the other, on a small corpus."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strataspark.llm.storage import materialise

WORDS = "the cat and a dog with this that over under house tree river stone light of in on at by".split()


def test_stages_keep_clean_documents_and_drop_the_others(spark, tmp_path):
    rng = np.random.default_rng(8)
    clean = [(i, " ".join(rng.choice(WORDS, 90))) for i in range(1, 31)]
    near = " ".join([*clean[0][1].split()[:-1], "changed"])
    rows = [*clean, (50, clean[3][1]), (51, near), (60, "too short"), (61, None), (62, "1 2 3 4 5 6 7 8 9 10 11"), (63, "$$$ ### " * 30)]
    table = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), f"test-{name}")
        names.append((name, {r["doc_id"] for r in docs.collect()}))
        assert name == "packing" or docs.columns == columns
    assert [n for n, _ in names] == ["quality_rules", "language_id", "exact_dedup", "near_dedup", "packing"]
    left = dict(names)
    everyone = {i for i, _ in clean} | {50, 51}
    assert left["quality_rules"] == everyone | {62} and left["language_id"] == everyone
    assert left["exact_dedup"] == everyone - {4} and left["near_dedup"] == everyone - {4, 51} == left["packing"]
    again = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert again == {tuple(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_repeated_and_null_ids_in_each_stage(spark, tmp_path):
    rng = np.random.default_rng(9)
    a, b, c, d, e = (" ".join(rng.choice(WORDS, 90)) for _ in range(5))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)
    kept = lambda stage, rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(rows), "").collect()), key=str)
    want = lambda *rows: sorted(rows, key=str)

    rows = [(1, a, "x"), (1, "too short", "x"), (None, b, "x"), (None, "1 2 3", "x"), (None, "$$$ ### " * 30, "x"), (2, c, "x"), (2, c, "x")]
    assert kept(corpus_pipeline.quality_stage, rows) == want((1, a), (None, b), (2, c), (2, c))
    assert kept(corpus_pipeline.language_stage, [(1, a, "x"), (1, "12 34", "x"), (None, b, "x"), (None, "56", "x")]) == want((1, a), (None, b))
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (None, d, "x"), (2, d, "x"), (3, e, "x")]
    assert kept(corpus_pipeline.exact_stage, rows) == want((1, a), (1, b), (None, c), (2, d), (3, e))
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, near(b), "x"), (3, near(a), "x"), (None, near(a), "x"), (None, e, "x"), (None, d, "x"), (4, near(d), "x")]
    assert kept(corpus_pipeline.near_stage, rows) == want((1, a), (1, b), (None, e), (4, near(d)))
    null_copies = kept(corpus_pipeline.near_stage, [(None, c, "x"), (None, near(c), "x"), (None, c, "y")])
    assert len(null_copies) == 1 and null_copies[0][1] in (c, near(c))


def test_language_stage_drops_what_was_not_learned_only(spark):
    rng = np.random.default_rng(10)
    letters = lambda alphabet, n: " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 9))) for _ in range(n))
    rows = [(i, " ".join(rng.choice(WORDS, 90)), "en") for i in range(1, 41)]
    rows += [(100 + i, letters("abcdefghijklmnopqrstuvwxyz", 60), None) for i in range(20)]
    rows += [(200 + i, letters("абвгдежзийклмнопрстуфхцчшщыэюя", 60), None) for i in range(20)]
    rows += [(300, "1 2 3", "en"), (301, None, "en")]
    docs = spark.createDataFrame([(i, t, lang, "src", 0) for i, t, lang in rows], SCHEMA)
    assert ids(corpus_pipeline.language_stage(spark, docs, "")) == sorted(range(1, 41), key=str)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    everyone = sorted([*range(1, 41), *range(100, 120), *range(200, 220)], key=str)
    assert ids(corpus_pipeline.language_stage(spark, unlabelled, "")) == everyone
