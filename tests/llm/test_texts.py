"""Dedup, rules, classifiers and URL filters against brute force and on the edges."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import exact_dedup, near_dedup, quality_rules
from strataspark.llm.components import components
from strataspark.llm.language_id import learn_prototypes, predict_language
from strataspark.llm.near_dedup import joint_estimate, merge_registers, mixed, near_duplicates, registers
from strataspark.llm.quality_mil import Model, learn_quality, passages, score_quality
from strataspark.llm.url_filter import entropy, filter_urls, learn

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(2)
    base = prose(rng, 120)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, "ONE two"), (7, prose(rng, 30_000)), (None, "one two"), (8, base), (8, base)]
    for i in range(60):  # a group of near copies
        words = base.split()
        for k in rng.integers(0, 120, i % 7):
            words[k] = f"edit{i}x{k}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, 80)) for i in range(20)]
    return spark.createDataFrame([(i, t, "s1" if (i or 0) % 3 else None, 0) for i, t in rows], "doc_id long, text string, source string, kept int")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("hashes", ["all different", "many alike"])
def test_exact_duplicates(table, monkeypatch, hashes):
    """Also with a hash that takes two values, so that chunks must be told apart by their content."""
    if hashes == "many alike":
        monkeypatch.setattr(exact_dedup, "_hash", lambda c: (F.length(c) % 2).cast("long"))
    got = exact_dedup.exact_duplicates(table)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept").collect()), key=str) == exact_brute(texts(table))
    assert exact_dedup.exact_duplicates(table.limit(0)).count() == 0


def test_chunks_are_the_text(spark, table):
    cut = table.filter("text is not null").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    long = spark.createDataFrame([("x" * 10_000,), ("é中😀 " * 3000,)], "text string").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    for r in [*cut.collect(), *long.collect()]:
        assert "".join(r["c"]) == r["text"] and all(len(c) <= 4097 for c in r["c"])


def near_brute(rows, k, percent):
    def shingles(t):
        w = [x.decode() for x in t.encode().lower().split()]
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted(((i, len(s), least[c], i == least[c]) for (i, _), s, c in zip(rows, sets, comp, strict=True)), key=str)


@pytest.mark.parametrize(("shingle", "large"), [(4, None), (5, 3)])
def test_near_duplicates(table, monkeypatch, shingle, large):
    """Also with small buckets compared as the large ones are, in several blocks."""
    if large:
        monkeypatch.setattr(near_dedup, "LARGE", large)
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    got = near_duplicates(table, shingle=shingle).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(texts(table), shingle, 80)


@pytest.mark.parametrize("large", [None, 3])
def test_near_duplicates_with_repeated_and_null_ids(spark, monkeypatch, large):
    """Texts that share an id are told apart, and rows without id are linked like others."""
    if large:
        monkeypatch.setattr(near_dedup, "LARGE", large)
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(11)
    a, b, c, d = (prose(rng, 150) for _ in range(4))
    near = lambda t, k: " ".join([*t.split()[:-1], f"other{k}"])
    rows = [(1, a), (1, b), (2, near(b, 1)), (3, near(a, 1)), (3, near(a, 1)), (3, c), (None, c), (None, near(c, 1)), (None, near(c, 1))]
    rows += [(None, d), (None, near(d, 1)), (None, near(d, 2)), (4, near(d, 3)), (None, ""), (None, None), (5, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == near_brute([(i, t or "") for i, t in rows], 5, 80)


def test_near_duplicates_of_nothing(table):
    assert near_duplicates(table.limit(0)).count() == 0
    assert near_duplicates(table.filter("text is null")).collect()[0]["component_id"] == 1


def test_sketches_merge_and_estimate():
    a, b = mixed(np.arange(1, 3001, dtype=np.uint64)), mixed(np.arange(601, 3601, dtype=np.uint64))
    assert (merge_registers(registers(a), registers(b)) == registers(np.union1d(a, b))).all()
    j = joint_estimate(registers(a)[None], registers(b)[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(j - 2400 / 3600) < 0.16


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 301: 300}


def rules_brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, table):
    more = spark.createDataFrame([(900, "a b c d e " * 9, "s1", 0), (901, "x ### $$$\nx ### $$$\n\n", "bad", 0), (902, "é\x0bé\xa0é " + prose(np.random.default_rng(1), 40), "s1", 0)], table.schema)
    both = table.union(more)
    want = {i: rules_brute(t) for i, t in texts(both) if i is not None}
    for r in quality_rules.quality_rules(both.filter("doc_id is not null")).collect():
        n = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(both.limit(0)).count() == 0


def test_hosts_are_blocked_on_evidence_only(spark):
    good = "a fine text of more than ten different words that nobody would call bad"
    rows = [(i, "short", "spam") for i in range(200)] + [(1000 + 2 * i, good, f"h{i % 20}") for i in range(400)] + [(5000, "short", "new"), (5001, good, "spam")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(d).collect()}
    assert not got[5001]["kept"] and got[5001]["host_blocked"] and not got[5001]["rule_failed"]
    assert not got[5000]["host_blocked"] and got[1000]["kept"]


def test_repeats_with_large_vocabularies():
    rng = np.random.default_rng(4)
    words = [str(x).encode() for x in rng.integers(0, 9000, 30_000)]
    words[20_000:20_050] = words[100:150]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    assert quality_rules.repeated_words(words) == len(hit)


def test_language_profiles(spark):
    en, de = "the cat and the dog with this that ", "der hund und die katze nicht auch über "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(20)]
    learned = learn_prototypes(spark.createDataFrame(rows + [(50, None, "en"), (51, en, None), (52, "123", "xx")], "doc_id long, text string, lang string"))
    assert sorted(learned) == ["de", "en"]
    d = spark.createDataFrame([(1, "the dog and that cat", 0), (2, "die katze und der hund", 0), (3, None, 0), (4, "", 0), (5, "123 !?", 0)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in predict_language(d, learned).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in predict_language(d, {}).collect()} == {"und"}
    assert predict_language(d.limit(0), learned).count() == 0 and learn_prototypes(d.limit(0).withColumn("lang", F.lit("a"))) == {}


def test_quality_by_passages(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, 150) + (" ### $$$" * 60 if i % 3 == 0 else ""), int(i % 3 != 0)) for i in range(120)]
    d = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, ""), (502, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:90]] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in score_quality(d, learn_quality(d, labels)).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in rows[90:]) and len(got) == 123
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == bool(r["predicted"]) for r in got.values())
    assert score_quality(d, learn_quality(d, labels.limit(0))).first()["score"] == 0.5
    assert score_quality(d.limit(0), Model()).count() == 0


def test_gradients_of_the_attention():
    rng = np.random.default_rng(0)
    bags = [passages_[:3] for passages_ in passages([prose(rng, 200), prose(rng, 100) + " !!! $$$"])]
    x, starts, y = np.concatenate(bags).astype(np.float64), np.array([0, len(bags[0])]), np.array([1.0, 0.0])
    model = Model()
    for k in Model.NAMES:
        setattr(model, k, getattr(model, k).astype(np.float64))
    loss = lambda: -(y * np.log(p := model.forward(x, starts)[-1]) + (1 - y) * np.log(1 - p)).mean()
    grads = model._gradients(x, starts, y)
    for k in Model.NAMES:
        value = getattr(model, k)
        at = tuple(rng.integers(0, n) for n in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5, k


def test_url_rules_and_trees(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/")]
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "https://a.com/en/1", "x://org/es/", "http://notexample.com/en/7", "http://b.org/de/1", "http://h?x=1&y=2", "a://b://c/d"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in filter_urls(d, rules).collect()}
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [got[i]["rule"] for i in range(10)] == [None, None, None, "example.com/en/7", "com/en/", "org/es/", "com/en/", None, None, None]
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 8, 9)] == [("", ""), ("h", ""), ("b:", "//c/d")]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert filter_urls(d.limit(0), rules).count() == 0
    assert {r["verdict"] for r in filter_urls(d.filter("page_id < 3"), rules).collect()} == {"allow"}
    assert abs(spark.createDataFrame([("aabb",)], "t string").select(entropy(F.col("t"))).first()[0] - 1) < 1e-12


def test_url_statistics_cover_all_labelled_urls(spark):
    """Also with one URL that holds most rows and has the least hash, so that it comes first in any sample by hash."""
    many = [(f"http://a{i}.h{i % 40}.com/p{i}", f"a{i}.h{i % 40}.com", f"/p{i}", int(i % 40 < 10)) for i in range(200)]
    d = spark.createDataFrame(many, "url string, host string, path string, label int")
    hot = d.filter("label = 1").orderBy(F.xxhash64("url")).limit(1)
    both = d.union(hot.crossJoin(spark.range(300)).drop("id"))
    rates, overall, trees = learn(both, max_labelled=20)
    rows = both.collect()
    assert overall == sum(r["label"] for r in rows) / len(rows)
    n, blocked = Counter(), Counter()
    for r in rows:
        key = ".".join(r["host"].split(".")[-2:])
        n[key] += 1
        blocked[key] += r["label"]
    got = {r["suffix"]: r["suffix_rate"] for r in rates.collect()}
    assert got == pytest.approx({k: (blocked[k] + 20 * overall) / (n[k] + 20) for k in n})
    assert trees is not None
