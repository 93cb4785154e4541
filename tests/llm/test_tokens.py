"""Tokenizer operators against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from strataspark.llm import byte_bpe, token_records
from strataspark.llm.byte_bpe import MergeReplay, decode_documents, encode_documents, read_ranks
from strataspark.llm.library_bpe import LibraryEncoder
from strataspark.llm.packing import pack_documents, pack_histogram
from strataspark.llm.token_counts import PrefixCounter, longest_prefixes, prefix_counts, prefix_table, tokens_at, tokens_of_prefixes
from strataspark.llm.token_records import frame, read_by_index, unframe, with_starts, write_index, write_records

RANKS, WORD, BYTE = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def odd_texts(n=400):
    rnd = random.Random(3)
    parts = [*"abcdeXYZ '  \n\n\t.,!#0123éüßñ中文नमС́\xa0\x1c\x85😀İΣς", "'re", "'ll", "'ve", "'s", "<|endoftext|>", "<|startoftext|>", "<|", " the", "  ", "\r\n", "."]
    return ["", "  ", " \n ", "a" * 3000, "ab " * 500, *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n))]


def test_byte_bpe_is_the_librarys():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = MergeReplay(read_ranks(RANKS), P.PATTERN)
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_byte_bpe_is_the_librarys_whatever_the_pair_cache_holds(monkeypatch):
    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "PAIR_ENTRIES", 5)
    own = MergeReplay(ranks, P.PATTERN)
    texts = ["internationalisation of Xqzvbnm and Kwyjibo-flummoxing", "aGVsbG8gd29ybGQ 0x7fDeadBeef", *odd_texts(60)]
    for _ in range(2):
        assert [list(map(int, ids.split())) for ids, _ in own.encode_written(texts)] == [library.encode_ordinary(x) for x in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunked_encoding_is_the_librarys(path):
    own, library = LibraryEncoder(open(path).read()), Tokenizer.from_file(path)
    texts = odd_texts()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts_of_every_prefix_are_the_librarys():
    counter, library = PrefixCounter(open(WORD).read()), Tokenizer.from_file(WORD)
    for text in [x[:50] for x in odd_texts(60)]:
        for p in range(len(text) + 1):
            assert tokens_at(counter, text, p) == len(library.encode(text[:p], add_special_tokens=False).ids)


def docs(spark):
    texts = [None, "", "The same text. ", "The same text. ", "<|endoftext|> x", "word " * 2500, *odd_texts(30)]
    # An extra column has a name that the operators use inside; the ids are not in order.
    return spark.createDataFrame([((7 * i) % 1009, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def plain(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_byte_bpe_over_documents(spark):
    d = docs(spark)
    own = MergeReplay(read_ranks(RANKS), P.PATTERN)
    got = decode_documents(encode_documents(d, RANKS, P.PATTERN), RANKS).collect()
    texts = plain(d)
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert encode_documents(d.limit(0), RANKS, P.PATTERN).count() == 0


def test_prefix_counts_over_documents(spark):
    d, library = docs(spark), Tokenizer.from_file(WORD)
    for r in prefix_counts(d, WORD, limit=20).collect():
        text = plain(d)[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 20)
        assert r["chunk_tokens"][-1] == n
        fit = " ".join(text.replace("\n", " ").split(" ")[: r["fit_chunks"]])
        assert len(library.encode(fit, add_special_tokens=False).ids) <= 20
    assert prefix_counts(d.limit(0), WORD, 20).count() == 0


def test_stored_prefixes_answer_truncation_and_budgets(spark):
    library = Tokenizer.from_file(WORD)
    texts = {i: t[:40] for i, t in enumerate(["", "one two\n three  four", " lead", "end ", *odd_texts(20)])}
    d = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string")
    stored = prefix_table(d, WORD)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    asked = [(i, n) for i, t in texts.items() for n in (0, 1, len(t) // 2, len(t), len(t) + 5)]
    got = tokens_of_prefixes(stored, spark.createDataFrame([*asked, (99, 3), (1000, 1)], "doc_id long, chars int")).collect()
    assert Counter(map(tuple, got)) == Counter([*((i, n, count(texts[i][:n])) for i, n in asked), (99, 3, 0), (1000, 1, None)])
    budgets = longest_prefixes(stored, spark.createDataFrame([(i, b) for i in texts for b in (0, 3, 1000)], "doc_id long, budget int")).collect()
    for r in budgets:
        t = texts[r["doc_id"]]
        assert r["chars"] == max(n for n in range(len(t) + 1) if count(t[:n]) <= r["budget"])
    assert prefix_table(d.limit(0), WORD).count() == 0


def test_records_round_trip_and_notice_damage(spark, tmp_path):
    d, library = docs(spark), Tokenizer.from_file(WORD)
    write_records(d, f"{tmp_path}/r", WORD, end_id=1)
    index = write_index(spark, f"{tmp_path}/r", f"{tmp_path}/i")
    start = 0
    got = {r["row_key"]: r for r in with_starts(index).collect()}
    want = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in plain(d).items()}
    for i in sorted(want):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        start += len(want[i])
    some = read_by_index(spark, index.filter("row_key % 2 = 0"), f"{tmp_path}/r").collect()
    assert {r["row_key"]: r["ids"] for r in some} == {i: x for i, x in want.items() if i % 2 == 0}
    record = frame(-3, np.array([5, 70_000], "<u4").tobytes()) + b"\n"
    assert unframe(record, 0) == (-3, np.array([5, 70_000], "<u4").tobytes(), len(record))
    assert unframe(frame(None, b"") + b"\n", 0)[:2] == (None, b"")
    with pytest.raises(ValueError, match="checksum"):
        unframe(record[:20] + bytes([record[20] ^ 1]) + record[21:], 0)


def test_no_documents_give_no_records(spark, tmp_path):
    write_records(docs(spark).limit(0), f"{tmp_path}/r", WORD, end_id=1)
    assert with_starts(write_index(spark, f"{tmp_path}/r", f"{tmp_path}/i")).count() == 0


def test_packing_covers_every_id_once(spark):
    d, library = docs(spark), Tokenizer.from_file(BYTE)
    want = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in plain(d).items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in pack_documents(d, BYTE, end_id=0).collect():
        assert r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for spans, end in [(x, len(want[i])) for i, x in pieces.items()] + [(x, None) for x in places.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == end or end is None and at <= 1024
    assert pack_documents(d.limit(0), BYTE, end_id=0).count() == 0


def test_plans_use_up_any_histogram():
    rng = np.random.default_rng(1)
    for counts in (np.zeros(65, int), rng.poisson(2, 65), rng.poisson(300, 65), np.eye(65, dtype=int)[63] * 1000):
        counts[0] = 0
        used = np.zeros(65, int)
        for lengths, repeats in pack_histogram(counts, 64):
            assert sum(lengths) <= 64 and repeats > 0
            for x in lengths:
                used[x] += repeats
        assert (used == counts).all()
    counts = rng.poisson(300, 65) * (np.arange(65) > 0)
    padding = sum((64 - sum(x)) * n for x, n in pack_histogram(counts, 64))
    assert padding < 0.02 * (counts * np.arange(65)).sum()


def test_letters_are_the_librarys():
    """Characters that editions of Unicode disagree on, before a contraction."""
    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = MergeReplay(ranks, P.PATTERN)
    odd = [0x12609, 0x88F, 0xA7D2, 0xA7DD, 0x10940, 0x1B123, 0x13460, 0x16D40, 0x10D4A, 0x11DE0, 0x323B0, 0x16FF2, 0x378, 0x1C89, 0x1CCF0]
    for c in map(chr, odd):
        for text in (c + "'ve", f"ab {c}{c}'s x{c}!", f"{c} {c}7{c}"):
            assert own.encode(text) == library.encode_ordinary(text), hex(ord(c))


def test_records_of_repeated_and_null_ids_in_small_runs(spark, tmp_path, monkeypatch):
    """Each row is written once, null ids first; runs and files end early, and a record may be longer than a run."""
    monkeypatch.setattr(token_records, "RUN_BYTES", 200)
    monkeypatch.setattr(token_records, "FILE_RUNS", 2)
    library = Tokenizer.from_file(WORD)
    rows = [(None, "no id"), (None, None), (3, "one"), (3, "two"), (3, "one"), (2, "word " * 500), (1, ""), (10, "10 13 10\n\r"), *((100 + i, f"text {i}") for i in range(40))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    write_records(d, f"{tmp_path}/r", WORD, end_id=1)
    got = with_starts(write_index(spark, f"{tmp_path}/r", f"{tmp_path}/i")).orderBy("start").collect()
    want = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows)
    assert Counter((r["row_key"], r["ids_crc32"]) for r in got) == want
    keys = [r["row_key"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len({r["part"] for r in got}) > 3
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]))
    ids = np.arange(70_000, dtype="<u4").tobytes()
    frames = spark.createDataFrame([(bytearray(frame(1, ids)),)], "value binary")
    frames.select(frames["value"].cast("string")).write.option("lineSep", "\n").text(f"{tmp_path}/every")
    assert unframe(bytes(spark.read.format("binaryFile").load(f"{tmp_path}/every").first()["content"]), 0)[:2] == (1, ids)


def test_packing_of_repeated_and_null_ids(spark):
    rows = [(None, "no id"), (None, "no id"), (None, None), (3, "one"), (3, "two"), (3, "one"), (4, "word " * 3000)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, end_id=0).collect()
    library = Tokenizer.from_file(BYTE)
    assert sum(r["length"] for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        assert [o for o, _ in sorted(spans)] == list(np.cumsum([0, *(n for _, n in sorted(spans)[:-1])]))
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(i for i, _ in rows)
