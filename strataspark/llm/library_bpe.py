"""Encoding with the ``tokenizers`` library, chunk by chunk through a bounded cache."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np

from strataspark.llm.chunked import TAIL, ColumnCache, joined_texts


#: So many words make one text, and so many texts go to the library at once.
LINE_CHUNKS = 500
LINES = 20
#: The end of the Latin blocks; words beyond go through the library's whole chain.
LATIN_END = "\u0250"


def byte_alphabet() -> list[str]:
    """How byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_WRITTEN = byte_alphabet()


class LibraryEncoder:
    """Ids as bytes, little-endian unsigned 32-bit, without added special tokens. Special strings inside a text are
    handled as the library does by default: such a text goes to the library whole."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [x["content"] for x in parsed["added_tokens"]]
        by_word = self.by_word = bool(parsed["model"].get("end_of_word_suffix"))
        bare = parsed | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
        self.lean = Tokenizer.from_str(json.dumps(bare))
        vocabulary = parsed["model"]["vocab"]
        self.edges = np.zeros(max(vocabulary.values()) + 1, bool)
        end, start = parsed["model"].get("end_of_word_suffix"), _WRITTEN[32]
        self.edges[[i for x, i in vocabulary.items() if (x.endswith(end) if by_word else x.startswith(start))]] = True
        self.known = ColumnCache(self._encode_chunks, parts=1)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, chunks: list[str]) -> list[bool]:
        """Which are one word of Latin letters, after the one space that byte-level chunks start with: the normaliser only
        puts it in lower case and the splitter leaves it whole."""
        words = chunks if self.by_word else [x[1:] if x[:1] == " " else "" for x in chunks]
        return [x.isalpha() and (x.isascii() or max(x) < LATIN_END and len(x.lower()) == len(x) and unicodedata.is_normalized("NFC", x)) for x in words]

    def _words(self, chunks: list[str]) -> list[bytes]:
        """Plain words go to the library's model without its normaliser and splitter, many to a text. Their ids are told apart
        by the token that ends, or starts, a word."""
        written = [x if x.isascii() and self.by_word else "".join(map(_WRITTEN.__getitem__, x.encode())) for x in chunks]
        out: list[bytes] = []
        for first in range(0, len(written), LINE_CHUNKS * LINES):
            some = written[first : first + LINE_CHUNKS * LINES]
            lines = [" ".join(some[i : i + LINE_CHUNKS]) for i in range(0, len(some), LINE_CHUNKS)]
            for found in self.lean.encode_batch_fast(lines, add_special_tokens=False):
                ids = np.array(found.ids, "<u4")
                edge = np.flatnonzero(self.edges[ids]) * 4
                edge = [0, *(edge + 4).tolist()] if self.by_word else [*edge.tolist(), 4 * len(ids)]
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        if len(out) != len(chunks):
            raise ValueError("words were not kept apart")
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[bytes]]:
        """A chunk is a plain word, in lower case if that is the same, and the marks after it, which are a word of their own;
        or it goes to the library as it is. Words and marks that chunks share are encoded once."""
        words = [x.rstrip(TAIL) for x in chunks]
        plain = self._plain(words)
        tails = [c[len(w) :] if p else "" for c, w, p in zip(chunks, words, plain, strict=True)]
        if self.by_word:
            words = [w.lower() for w in words]
        stems = [w if p else c for c, w, p in zip(chunks, words, plain, strict=True)]
        distinct = list({w for w, p in zip(words, plain, strict=True) if p})
        found = dict(zip(distinct, self._words(distinct), strict=True))
        other = [x for x in {*tails, *(c for c, p in zip(chunks, plain, strict=True) if not p)} if x]
        for i in range(0, len(other), LINE_CHUNKS):
            found.update(zip(other[i : i + LINE_CHUNKS], self._encode(other[i : i + LINE_CHUNKS]), strict=True))
        found[""] = b""
        return [(found[s] + found[t],) if t else (found[s],) for s, t in zip(stems, tails, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        special = lambda text: any(s in text for s in self.special)
        for text, found in zip(texts, joined_texts(texts, not self.by_word, self.known, special), strict=True):
            yield self._encode([text])[0] if found is None else found[0]


_HELD: dict[bytes, LibraryEncoder] = {}


def encoder(definition: bytes) -> LibraryEncoder:
    """One per worker process, kept between tasks."""
    key = hashlib.md5(definition, usedforsecurity=False).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = LibraryEncoder(definition.decode())
    return _HELD[key]


def read_definition(path: str) -> bytes:
    return Path(path).read_bytes()
