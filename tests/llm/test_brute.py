"""Learned operators against plain versions of their arithmetic, on planted signals and on the fixed split; hot groups."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataspark.llm import language_id, near_dedup, quality_mil
from strataspark.llm.language_id import learn_prototypes, predict_language
from strataspark.llm.near_dedup import near_duplicates
from strataspark.llm.quality_mil import learn_quality, passages, score_quality
from strataspark.llm.queries import URL_RULES
from strataspark.llm.split import held_out
from strataspark.llm.url_filter import filter_urls, fitting_rule, host_and_path, learn, lexical_features, rule_text
from test_texts import near_brute

SF = "/root/testdata/sf0.001"
WORDS = "the cat and a dog with this that over under house tree river stone light of in on at by".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


# --- the split -----------------------------------------------------------------------------------------------------


def test_the_split_is_crc32_of_the_id(spark):
    ids = [*range(0, 200), 10**12, -5, None]
    d = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r[0]: r[1] for r in d.select("doc_id", held_out(F.col("doc_id"))).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


# --- near-duplicates: hot groups -----------------------------------------------------------------------------------


@pytest.mark.parametrize("shingle", [4, 5])
def test_a_hot_group_around_the_threshold_gives_few_links(spark, monkeypatch, shingle):
    """Near copies of one text whose pairs lie on both sides of the threshold: all components are found, and the rows that
    the step for large buckets returns stay below members times bands."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(shingle)
    base = rng.choice(["w%d" % i for i in range(400)], 140)
    rows = []
    for i in range(300):
        words = base.copy()
        at = rng.integers(0, len(base), rng.integers(0, 7))
        words[at] = [f"edit{rng.integers(0, 40)}" for _ in at]
        rows.append((i, " ".join(words)))
    made, real = [], near_dedup._block_links

    def counted(*args):
        found = near_dedup.materialise(real(*args), "counted")
        made.append((found.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(near_dedup, "_block_links", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle).collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows, shingle, 80)
    assert all(n < len(rows) * near_dedup.BANDS for n, _ in made)


def test_members_out_of_reach_have_no_partner(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 100)
    sets = {i: np.unique(np.concatenate((base[: 100 - i], rng.integers(1, 1 << 62, i)))) for i in range(0, 60, 2)}
    reps = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "id long, n long")
    held = spark.createDataFrame([(i, bytearray(s.astype("<u8").tobytes())) for i, s in sets.items()], "id long, hashes binary")
    gone = {r["id"] for r in near_dedup._out_of_reach(reps.select("id"), reps, held, 80).collect()}
    own = {i: sum(all(h not in t for j, t in sets.items() if j != i) for h in s.tolist()) for i, s in ((i, s) for i, s in sets.items())}
    assert gone == {i for i, s in sets.items() if 100 * (len(s) - own[i]) < 80 * len(s)} and gone and len(gone) < len(sets)


def test_forests_join_what_links_join():
    one, two = np.array([5, 5, 7, 9, 9, 5]), np.array([7, 7, 9, 5, 11, 11])
    kept = near_dedup._forest(one, two)
    assert len(kept) == 3 and {5, 7, 9, 11} == set(one[kept]) | set(two[kept])
    assert near_dedup._forest(one[:0], two[:0]) == []


# --- URLs ----------------------------------------------------------------------------------------------------------


def url_brute(url):
    url = url or ""
    _, found, rest = url.partition("://")
    rest = rest if found else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:end], rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def features_brute(url, host, path):
    url = url or ""
    query = url.partition("?")[2].partition("#")[0] if "?" in url else ""
    shares = [n / len(url) for n in Counter(url).values()]
    return [
        len(url), len(host), len(path), host.count("."), path.count("/"), sum(c in "0123456789" for c in url) / max(1, len(url)),
        -sum(p * math.log2(p) for p in shares), query.count("&") + 1 if query else 0, host.count("-"),
    ]


def test_urls_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    parts = ["http", "://", "a.com", "Example.COM", "example.net", "x.org", "net", "com", "/en/", "/en/7", "/de/8", "/es/", "?", "#", "&", "=", "-", ".", "9", "é", "\n", "/"]
    urls = [None, "", "://", "http://h" + "/deep" * 40_000 + "?q=1", *("".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(400)), *["http://example.net/de/8/x"] * 5]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in filter_urls(d, URL_RULES).collect()}
    assert len(got) == len(urls)
    host, path = host_and_path(F.col("url"))
    features = {r["page_id"]: r for r in lexical_features(d.withColumns({"host": host, "path": path})).collect()}
    for i, url in enumerate(urls):
        host, path = url_brute(url)
        fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(rule_text(r)), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and rule_text(best)), url
        assert best is None or got[i]["verdict"] == best[0]
        names = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "n_hyphens")
        assert [features[i][n] for n in names] == pytest.approx(features_brute(url, host, path), abs=1e-9)
    repeated = {got[i]["verdict"] for i in range(len(urls) - 5, len(urls))}
    assert repeated == {"block"}


def test_trees_carry_a_planted_signal_to_hosts_without_rules(spark):
    rng = np.random.default_rng(4)

    def url(bad, host):
        tail = "".join(rng.choice(list("0123456789"), 14)) + "?a=1&b=2&c=3" if bad else "".join(rng.choice(list("abcdefgh"), 8))
        return f"http://{host}/p/{tail}"

    labelled = [(u, *url_brute(u), int(bad)) for i in range(600) for bad in (i % 3 == 0,) for u in (url(bad, f"h{i % 37}.com"),)]
    _, _, trees = learn(spark.createDataFrame(labelled, "url string, host string, path string, label int"))
    assert trees is not None
    rules = [("block", "bad.com", "/"), ("allow", "good.com", "/")]
    pages = [(i, url(i % 2, "x.bad.com" if i % 2 else "x.good.com"), i % 2) for i in range(400)] + [(1000 + i, url(i % 2, f"n{i}.org"), i % 2) for i in range(100)]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, label int"), rules).collect()}
    free = [(got[i], bad) for i, _, bad in pages if i >= 1000]
    assert all(r["rule"] is None for r, _ in free)
    assert sum((r["verdict"] == "block") == bool(bad) for r, bad in free) >= 95


# --- quality -------------------------------------------------------------------------------------------------------


def passages_brute(text):
    data = text.encode() + b"\n"
    cls = [int(quality_mil._CLASS[b]) for b in data]
    starts = [i for i, c in enumerate(cls) if c > 1 and (i == 0 or cls[i - 1] <= 1)]
    firsts = starts[:: quality_mil.PASSAGE_WORDS] or [0]
    words = data.decode().replace("\x1c", "x").split() if not starts else [data[s:].split()[0] for s in starts]
    out = []
    for k, first in enumerate(firsts):
        a, b = (0 if k == 0 else first), (firsts[k + 1] if k + 1 < len(firsts) else len(data))
        own = cls[a:b]
        one = np.array([own.count(c) for c in range(quality_mil.CLASSES)], float)
        two = np.zeros((quality_mil.CLASSES,) * 2)
        for x, y in zip(own, own[1:], strict=False):
            two[x, y] += 1
        mine = range(64 * k, min(64 * k + 64, len(starts)))
        n = max(1, len(mine))
        again = sum(words[i] == words[i - 1] for i in mine if i) / n
        out.append(np.concatenate((np.sqrt(one / len(own)), np.sqrt(two.ravel() / len(own)), [(len(own) - one[0] - one[1]) / n / 16, again])))
    return np.array(out)


def test_passages_and_attention_against_a_plain_version():
    rng = np.random.default_rng(1)
    texts = ["", " \n\t ", "one", "the the the cat", "  lead " + prose(rng, 200) + " !!! $$$ 12 É中", "x" * 5000, prose(rng, 128)]
    bags = list(passages(texts))
    for text, bag in zip(texts, bags, strict=True):
        assert bag == pytest.approx(passages_brute(text), abs=1e-5), text[:30]
    model = quality_mil.Model()
    for bag, score in zip(bags, model.score(bags), strict=True):
        h = [np.tanh((x - model.mean) / model.scale @ model.w + model.wb) for x in bag]
        e = [float((np.tanh(x @ model.v) / (1 + np.exp(-(x @ model.u)))) @ model.a) for x in h]
        alpha = [math.exp(x) for x in e]
        z = sum(a / sum(alpha) * x for a, x in zip(alpha, h, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-float(z @ model.c + model.cb[0]))), abs=1e-4)


def test_quality_of_odd_rows(spark):
    """Very long texts, repeated rows, two labels of one document and columns named as the operator's own."""
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, 150) + (" ### $$$" * 60 if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100, prose(rng, 60_000)), (3, rows[3][1]), (3, rows[3][1]), (7, rows[7][1])]
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, score int, row_key string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 1) for i, _ in rows] + [(8, 0, 1)], "doc_id long, quality int, n int")
    model = learn_quality(d, labels)
    got = score_quality(d, model).collect()
    assert len(got) == len(rows) and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    # Fewer passages than the sample has: whole documents in the order of the hash, never parts of one.
    order = [r[0] for r in labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    few = learn_quality(d.dropDuplicates(["doc_id"]).filter("doc_id <> 100"), labels, max_passages=30)
    assert few.constant is None and len(order) == 61
    assert learn_quality(d, labels, max_passages=0).constant in (0.0, 1.0)


# --- languages -----------------------------------------------------------------------------------------------------


def vector_brute(text):
    codes = [0]
    for c in f"{text.lower()} ":
        code = ord(c) if c.isalpha() else 0
        if code or codes[-1]:
            codes.append(code)
    out = np.zeros(language_id.DIMENSIONS)
    for i in range(len(codes) - 2):
        out += np.prod([np.roll(language_id.letter_vector(codes[i + k]).astype(int), 2 - k) for k in range(3)], axis=0)
    return out


def test_language_against_a_plain_version(spark):
    """Also with repeated rows, a very long text, equal languages and columns named as the operator's own."""
    en, de = "the cat and the dog with this that ", "der hund und die katze nicht auch über "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3) + "xyz"[i % 3], "en" if i % 2 else "de") for i in range(12)]
    rows += [rows[0], rows[0], (50, en * 4000, None), (51, "a1b2 --- c", None), (52, "ü", None), (53, "12", None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, lang_pred int")
    learned = learn_prototypes(d)
    sums = {}
    for _, text, lang in rows:
        if lang:
            v = vector_brute(text)
            sums[lang] = sums.get(lang, 0) + np.rint(v / np.linalg.norm(v) * language_id.UNIT)
    assert sorted(learned) == sorted(sums)
    for k, v in sums.items():
        assert learned[k] == pytest.approx(v / np.linalg.norm(v), abs=1e-6)
    for r, text in ((r, t) for r in predict_language(d, learned).collect() for i, t, _ in rows if i == r["doc_id"]):
        v = vector_brute(text)
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosines = {k: float(v @ p / np.linalg.norm(v)) for k, p in learned.items()}
        assert r["lang_pred"] == max(cosines, key=cosines.get) and r["score"] == pytest.approx(max(0, max(cosines.values())), abs=1e-5)
    same = {"b": learned["en"], "a": learned["en"]}
    assert {r["lang_pred"] for r in predict_language(d.filter("doc_id = 1"), dict(sorted(same.items()))).collect()} == {"a"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    d = spark.createDataFrame([(1, "abc", "a"), (2, "abc", "b"), (3, "abc", "c")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        learn_prototypes(d)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_rows_are_judged_right(spark):
    from strataspark.llm.queries import op5_quality_mil, op7_language_id

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lang = op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    quality = op5_quality_mil(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(lang) > 30 and sum(r["lang"] == r["lang_pred"] for r in lang) >= 0.95 * len(lang)
    assert quality and sum(r["quality"] == r["predicted"] for r in quality) >= 0.9 * len(quality)


# --- the pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Extra columns, a very long text, a null language and an empty table."""
    rng = np.random.default_rng(12)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    rows = [(i, " ".join(rng.choice(vocabulary, 90)), None if i % 4 == 0 else "en", None if i % 5 == 0 else "src", 0, "n", 1) for i in range(20)]
    rows.append((99, " ".join(rng.choice(vocabulary, 50_000)), "en", "src", 0, "n", 1))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, text_sha256 int")
    d.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in rows}
    d.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert empty.count() == 0 and empty.columns == got.columns
