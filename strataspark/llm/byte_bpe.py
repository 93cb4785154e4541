"""Byte-level BPE encoding and decoding by merge replay over a block's vocabulary.

A block's distinct new words are laid out as one symbol sequence. An inverted index leads from each mergeable pair,
named by the rank of what it makes, to the positions where it stands; ranks are taken in ascending order from a heap,
each merge rewrites its position and enters only the two pairs with the touched neighbours. Every merge is thus applied
to all words of the block at once.

The corpus is replayed in blocks of bounded size, without a shuffle: a worker keeps the words it has encoded in a
bounded cache, so memory does not grow with the corpus and a lost task is redone from its own input split alone.

Defined results: null and empty texts have no tokens; repeated rows give repeated rows; an empty table gives an empty
result; very long texts are encoded whole, a block at least one text. Only the two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.chunked import TAIL, ChunkCache, ColumnCache, joined_texts, small_batches, texts_of

#: Pair ranks remembered by a worker before it starts anew with its next block.
PAIR_ENTRIES = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank on each line."""
    lines = (x.split() for x in Path(path).read_bytes().splitlines() if x)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class KnownLetters:
    """Which characters the reference library's pattern engine has as letters or numbers.

    Its tables and those of ``regex`` follow different editions of Unicode. Only characters that Python's own, older tables
    leave unassigned can differ; each of these is asked for once."""

    def __init__(self) -> None:
        ranks = {bytes([b]): b for b in range(256)} | {b"'v": 256, b"ve": 257, b"'ve": 258}
        # After a letter or number the contraction stands alone; after another mark its quote belongs to the mark.
        self.encode = tiktoken.Encoding("letters", pat_str=r"'ve| ?[\p{L}\p{N}]+| ?[^\s\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.unknown: dict[str, bool] = {}

    def hidden(self, text: str) -> str:
        """The text with a control character for each letter that the library does not have as one."""
        for c in set(text):
            if c not in self.unknown:
                self.unknown[c] = unicodedata.category(c) == "Cn" and self.encode(c + "'ve")[-1] != 258
        return "".join(["\x01" if self.unknown[c] else c for c in text])


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.letters = KnownLetters()
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.words = ChunkCache(self._encode_words)
        self.chunks = ColumnCache(self._encode_chunks, parts=2)

    def _pair(self, key: tuple[int, int]) -> int:
        """The rank of what two neighbours make, -1 if they make nothing; remembered in ``pairs``."""
        a, b = key
        made = self.pairs[key] = -1 if a < 0 or b < 0 else self.ranks.get(self.token[a] + self.token[b], -1)
        return made

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word. A word that is itself a token is that token, as the library has it."""
        if len(self.pairs) > PAIR_ENTRIES:  # not later: positions below are filed by what is known here
            self.pairs.clear()
        symbol: list[int] = [-1]  # a mark before, between and after the words, which makes nothing with any neighbour
        starts = []
        for word in words:
            starts.append(len(symbol))
            if (whole := self.ranks.get(word)) is None:
                symbol.extend(map(self.single.__getitem__, word))
            else:
                symbol.append(whole)
            symbol.append(-1)
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        pair, known = self._pair, self.pairs.get
        where: dict[int, list[int]] = {}
        for i, key in enumerate(zip(symbol, symbol[1:], strict=False)):
            if (made := known(key)) is None:
                made = pair(key)
            if made >= 0:
                if made in where:
                    where[made].append(i)
                else:
                    where[made] = [i]
        ranks = list(where)
        heapify(ranks)
        while ranks:
            rank = heappop(ranks)
            at = where.pop(rank, None)
            if at is None:
                continue
            at.sort()
            for k, i in enumerate(at):
                a = symbol[i]
                if a < 0:
                    continue
                j = after[i]
                if known((a, symbol[j])) != rank:
                    continue
                symbol[i] = rank
                symbol[j] = -2
                left, right = before[i], after[j]
                after[i], before[right] = right, i
                lower = False
                key = (symbol[left], rank)
                if (made := known(key)) is None:
                    made = pair(key)
                if made >= 0:
                    if made in where:
                        where[made].append(left)
                    else:
                        where[made] = [left]
                        heappush(ranks, made)
                    lower = made < rank
                key = (rank, symbol[right])
                if (made := known(key)) is None:
                    made = pair(key)
                if made >= 0:
                    if made in where:
                        where[made].append(i)
                    else:
                        where[made] = [i]
                        heappush(ranks, made)
                    lower = lower or made < rank
                if lower and k + 1 < len(at):  # a lower rank goes first
                    if rank not in where:
                        heappush(ranks, rank)
                    where.setdefault(rank, []).extend(at[k + 1 :])
                    break
        ends = [*starts[1:], len(symbol)] if starts else []
        return [[x for x in symbol[s:e] if x >= 0] for s, e in zip(starts, ends, strict=True)]

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """For each chunk: its ids in decimal with a space before each, and the bytes the ids decode to."""
        split = list(map(self._split, chunks))
        known = self.words.learn(set().union(*split))
        out = []
        for words in split:
            found = [known[w] for w in words]
            out.append(found[0] if len(found) == 1 else (b"".join([x for x, _ in found]), b"".join([x for _, x in found])))
        return out

    def _split(self, chunk: str) -> list[str]:
        """The pattern's matches; the two usual shapes, a word and a word with marks after it, without the pattern."""
        word = chunk.rstrip(TAIL)
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return [word, chunk[len(word) :]] if len(word) < len(chunk) else [word]
        if chunk.isascii():
            return self.pattern.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(self.letters.hidden(chunk))]

    def _encode_words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        return [(b"".join([b" %d" % i for i in ids]), self.decode(ids)) for ids in self.replay([w.encode() for w in words])]

    def encode_written(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text: its ids in decimal with a space before each, and the bytes they decode to."""
        yield from joined_texts(texts, True, self.chunks)

    def encode(self, text: str) -> list[int]:
        return list(map(int, next(self.encode_written([text]))[0].split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_HELD: dict[tuple, MergeReplay] = {}


def _replay(lines: bytes, pattern: str) -> MergeReplay:
    """One per worker process, kept between tasks."""
    key = (hashlib.md5(lines, usedforsecurity=False).digest(), pattern)
    if key not in _HELD:
        rows = (x.split() for x in lines.splitlines() if x)
        _HELD.clear()
        _HELD[key] = MergeReplay({base64.b64decode(a): int(b) for a, b in rows}, pattern)
    return _HELD[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: the id, ``ids`` (array of int, null unless ``with_ids``), ``n_tokens``, ``ids_sha256`` of the
    decimal ids joined by spaces and ``decoded_sha256`` of the bytes they decode to."""
    d = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("body"))
    kind = d.schema["row_key"].dataType.simpleString()
    lines = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # the vocabulary file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _replay(lines.value, pattern)
        for batch in small_batches(batches):
            ids, n, digest, decoded = [], [], [], []
            for written, plain in coder.encode_written(texts_of(batch.column(1))):
                ids.append(list(map(int, written.split())) if with_ids else None)
                n.append(written.count(b" "))
                digest.append(hashlib.sha256(written[1:]).hexdigest())
                decoded.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())],
                names=["row_key", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = d.mapInArrow(run, f"row_key {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("row_key", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, a null list as null."""
    token = {rank: token for token, rank in read_ranks(ranks_path).items()}
    held = encoded.sparkSession.sparkContext.broadcast(token)

    @F.pandas_udf("binary")
    def decoded(ids):  # noqa: ANN001, ANN202
        return ids.map(lambda x: None if x is None else b"".join(held.value[i] for i in x))

    return encoded.withColumn("decoded", decoded(ids_col))
