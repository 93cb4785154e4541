"""Token counts by prefix dynamic programming.

For a word w and every prefix w[:p], the last token of the prefix's encoding is the one vocabulary token that ends at p
and is compatible with the last token of what stands before it: two neighbours are compatible when encoding their
concatenation gives exactly the two. So last[p] and count[p] = count[p - len] + 1 follow from earlier prefixes, and one
pass stores the exact count at every prefix. A word's end has an end-of-word mark, so each prefix has two states: open
(more follows) and ended (the text stops here).

Counts are kept for each distinct chunk at each of its characters. A document's count at any prefix is the sum of its
chunks before plus the count in the chunk reached. ``prefix_table`` stores these counts for documents, and ``tokens_of_prefixes``
and ``longest_prefixes`` answer truncation and budget questions from the stored table by a join, without encoding.

No shuffle: documents are read once, workers hold a bounded cache. Defined results: null and empty texts have no tokens
and no bytes; repeated rows give repeated rows; an empty table gives an empty result; very long texts are counted whole.
Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.chunked import TAIL, ChunkCache, blocks, cut_column, small_batches, texts_of
from strataspark.llm.library_bpe import byte_alphabet

#: Compatible pairs and words remembered by a worker before it starts anew.
PAIR_ENTRIES = 1_000_000
WORD_ENTRIES = 250_000
#: The pre-tokenizer's pattern for printable ASCII in lower case; other chunks go through the library's own splitter.
_ASCII = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Matches of more than one letter after the quote.
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


_WRITTEN = byte_alphabet()


def _one(lowered: str) -> bool:
    return len(lowered) == 1


class PrefixCounter:
    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        parsed = json.loads(definition)
        model = parsed["model"]
        self.end = model["end_of_word_suffix"]
        self.merges = {tuple(x) if isinstance(x, list) else tuple(x.split(" ")): i for i, x in enumerate(model["merges"])}
        # Each token's text: 1 if it is a token inside a word, 2 at a word's end, 3 both. The automaton finds, for every
        # place in a word, the tokens that end there.
        kinds: dict[str, int] = {}
        for x in model["vocab"]:
            ended = x.endswith(self.end)
            text = x[: -len(self.end)] if ended else x
            kinds[text] = kinds.get(text, 0) | 1 + ended
        self.ending = ahocorasick.Automaton()
        for text, kind in kinds.items():
            self.ending.add_word(text, (text, len(text), kind))
        self.ending.make_automaton()
        self.special = [x["content"] for x in parsed["added_tokens"]]
        tokenizer = Tokenizer.from_str(definition)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        # By left token (empty: a word's start): whether a right token, open or ended, fits it.
        self.fits: dict[str, tuple[str, dict[str, bool], dict[str, bool]]] = {}
        self.pairs = 0
        self.known = ChunkCache(lambda chunks: list(map(self.chunk, chunks)))
        self.known_words: dict[str, array] = {}
        self.old_words: dict[str, array] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied to a few symbols, lowest rank first, leftmost first."""
        symbols, merges = list(symbols), self.merges
        while len(symbols) > 1:
            rank, at = min((merges.get(x, len(merges)), i) for i, x in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(merges):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def right_of(self, left: str) -> tuple[str, dict[str, bool], dict[str, bool]]:
        found = self.fits.get(left)
        if found is None:
            if self.pairs > PAIR_ENTRIES:
                self.fits.clear()
                self.pairs = 0
            found = self.fits[left] = (left, {}, {})
        return found

    def fit(self, row: tuple[str, dict[str, bool], dict[str, bool]], right: str, ended: bool) -> bool:
        """Whether the encoding of both together is exactly these two tokens; an empty left: whether right is one token."""
        left = row[0]
        last = right + self.end if ended else right
        symbols = [*left, *right]
        if ended:
            symbols[-1] += self.end
        found = row[1 + ended][right] = self.merged(symbols) == ([left, last] if left else [last])
        self.pairs += 1
        return found

    def word(self, word: str) -> array:
        """The token count of every prefix of one word, as if the text ended there."""
        found = self.known_words.get(word)
        if found is None:
            if len(self.known_words) > WORD_ENTRIES:
                self.old_words, self.known_words = self.known_words, {}
            found = self.old_words.get(word)
            if found is None:
                found = array("I", self._word(word))
                if word in _LONG_CONTRACTIONS:  # its inner prefix is two words, not one
                    found[1] = self.word(word[0])[0] + self.word(word[1])[0]
            self.known_words[word] = found
        return found

    def _word(self, word: str) -> list[int]:
        n = len(word)
        rows: list = [None] * (n + 1)  # what fits to the right of each prefix's last token
        rows[0] = self.right_of("")
        count, out, fit = [0] * (n + 1), [0] * n, self.fit
        for end, (token, size, kind) in self.ending.iter(word):
            k = end + 1 - size
            row = rows[k]
            if kind & 2 and not out[end]:
                ok = row[2].get(token)
                if ok or ok is None and fit(row, token, True):
                    out[end] = count[k] + 1
            if kind & 1 and rows[end + 1] is None:
                ok = row[1].get(token)
                if ok or ok is None and fit(row, token, False):
                    rows[end + 1], count[end + 1] = self.right_of(token), count[k] + 1
        return out

    def words(self, text: str) -> list[str]:
        return [x for x, _ in self.split(self.normalise(text))]

    def chunk(self, text: str) -> array:
        """The token count of every prefix of a chunk, by characters of the text as given."""
        if not text:
            return array("I")
        if text.isascii():
            if text.isalpha():
                return self.word(text.lower())
            word = text.rstrip(TAIL)
            if word.isalpha() and len(word) < len(text):
                out = array("I", self.word(word.lower()))
                out.extend([out[-1] + x for x in self.word(text[len(word) :])])
                return out
        if text.isascii() and text.isprintable() and "<|" not in text:
            out, before = array("I"), 0
            for word in _ASCII.findall(text.lower()):
                counts = self.word(word)
                out.extend([before + x for x in counts] if before else counts)
                before = out[-1]
            return out
        lower = [c.lower() for c in text]
        if text.isprintable() and "<|" not in text and unicodedata.is_normalized("NFC", text) and all(map(_one, lower)):
            joined = "".join(lower)
            if self.normalise(text) == joined:  # so each prefix's words are the words' prefixes
                return self._by_characters(joined)
        # Else prefixes of normalised text need not be normalised prefixes: each prefix is counted by its own words.
        seen: dict[str, int] = {}
        out = array("I")
        for p in range(1, len(text) + 1):
            out.append(self._whole(text[:p], seen))
        return out

    def _by_characters(self, text: str) -> array:
        if text.isalpha():  # one word: its bytes as the byte-level alphabet writes them
            counts = self.word("".join(map(_WRITTEN.__getitem__, text.encode())))
            return array("I", [counts[n - 1] for n in accumulate(len(c.encode()) for c in text)])
        out, before = array("I"), 0
        for word, (start, end) in self.split(text):
            counts = self.word(word)
            out.extend(before + counts[n - 1] for n in accumulate(len(c.encode()) for c in text[start:end]))
            before = out[-1]
        return out

    def _whole(self, text: str, seen: dict[str, int]) -> int:
        total, rest = 0, text
        while rest:
            at, special = min(((rest.find(s), s) for s in self.special if s in rest), default=(len(rest), ""))
            for word in self.words(rest[:at]):
                if word not in seen:
                    seen[word] = self.word(word)[-1]
                total += seen[word]
            total += bool(special)
            rest = rest[at + len(special) :]
        return total

    def counted(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text, the count at the end of each of its chunks (between single spaces or line breaks)."""
        for block in blocks(texts):
            distinct, index, offsets = cut_column(block, spaced=False)
            chunks, starts = distinct.to_pylist(), offsets.to_numpy()
            known = self.known.learn(set(chunks))
            totals = np.array([known[x][-1] if x else 0 for x in chunks], np.int64)
            ends = np.cumsum(totals[index])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield ends[a:b] - (ends[a - 1] if a else 0)


    def prefixes(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text, the count at the end of each of its prefixes of one character and more."""
        for block in blocks(texts):
            cut = [x.replace("\n", " ").split(" ") for x in block]
            known = self.known.learn({c for chunks in cut for c in chunks if c})
            for text, chunks in zip(block, cut, strict=True):
                out, before, at = np.zeros(len(text) + 1, np.int32), 0, 0
                for c in chunks:
                    if c:
                        out[at : at + len(c)] = known[c]
                        out[at : at + len(c)] += before
                        before = int(out[at + len(c) - 1])
                    at += len(c) + 1
                    out[at - 1] = before  # the white space behind
                yield out[:-1]


_HELD: dict[bytes, PrefixCounter] = {}


def _counter(definition: bytes) -> PrefixCounter:
    key = hashlib.md5(definition, usedforsecurity=False).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = PrefixCounter(definition.decode())
    return _HELD[key]


def prefix_counts(docs: DataFrame, definition_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", store: bool = True) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fit_chunks`` (how many chunks, words between
    spaces, fit the limit) and, if ``store``, ``chunk_tokens``: the exact count at the end of each chunk."""
    d = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("body"))
    kind = d.schema["row_key"].dataType.simpleString()
    definition = docs.sparkSession.sparkContext.broadcast(Path(definition_path).read_bytes())  # the vocabulary file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(definition.value)
        for batch in small_batches(batches):
            texts = texts_of(batch.column(1))
            tokens, fits, stored = [], [], []
            for ends in counter.counted(texts):
                tokens.append(int(ends[-1]))
                fits.append(int(np.searchsorted(ends, limit, side="right")))
                stored.append(ends.tolist() if store else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_()), pa.array(fits, pa.int64()), pa.array(stored, pa.list_(pa.int64()))],
                names=["row_key", "n_bytes", "n_tokens", "over_limit", "fit_chunks", "chunk_tokens"],
            )

    out = d.mapInArrow(run, f"row_key {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chunks long, chunk_tokens array<bigint>")
    return out.withColumnRenamed("row_key", id_col)


def prefix_table(docs: DataFrame, definition_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``prefix_tokens``, the exact token count of each prefix, shortest first; to be written
    and asked. An empty or null text has an empty list."""
    d = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("body"))
    kind = d.schema["row_key"].dataType.simpleString()
    definition = docs.sparkSession.sparkContext.broadcast(Path(definition_path).read_bytes())  # the vocabulary file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(definition.value)
        for batch in small_batches(batches, 100):
            counts = list(counter.prefixes(texts_of(batch.column(1))))
            ends = np.cumsum([0, *map(len, counts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*counts, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row_key", "prefix_tokens"])

    return d.mapInArrow(run, f"row_key {kind}, prefix_tokens array<int>").withColumnRenamed("row_key", id_col)


def tokens_of_prefixes(table: DataFrame, questions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The questions (id, chars) with ``n_tokens``, the count of the document's first ``chars`` characters; past its end that of
    the whole, null for an unknown document."""
    n = F.least(F.col("chars"), F.size("prefix_tokens")).cast("int")
    count = F.when(n > 0, F.try_element_at("prefix_tokens", n)).when(n == 0, F.lit(0))
    return questions.join(table.select(id_col, "prefix_tokens"), id_col, "left").withColumn("n_tokens", count).drop("prefix_tokens")


def longest_prefixes(table: DataFrame, questions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The questions (id, budget) with ``chars``, the length of the longest prefix of at most ``budget`` tokens; counts need not
    grow with the prefix, so it is the last that fits."""
    fits = F.transform("prefix_tokens", lambda v, i: F.when(v <= F.col("budget"), i + 1))
    longest = F.when(F.col("prefix_tokens").isNotNull(), F.coalesce(F.array_max(fits), F.lit(0)))
    return questions.join(table.select(id_col, "prefix_tokens"), id_col, "left").withColumn("chars", longest).drop("prefix_tokens")


def tokens_at(counter: PrefixCounter, text: str, chars: int) -> int:
    """The exact token count of text[:chars], from stored counts."""
    total = 0
    at = 0
    for chunk in text.replace("\n", " ").split(" "):
        if at >= chars:
            break
        if chunk:
            counts = counter.known.learn({chunk})[chunk]
            total += counts[min(len(chunk), chars - at) - 1]
        at += len(chunk) + 1
    return total
