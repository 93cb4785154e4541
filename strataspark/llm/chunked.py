"""Texts as short chunks that can be encoded one by one, and a bounded cache of what each chunk gives.

The byte-level pattern never matches across a boundary between a non-space and the space after it, nor across the last
space of a run, and the word tokenizer drops white space. So a text's tokens are its chunks' tokens, and a chunk that
was met before costs one dictionary lookup.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space characters, as the tokenizers' patterns understand ``\\s``.
WHITE = "\t-\r \x85\xa0  -     　"
#: A space inside or at the end of a longer run of white space: such a text is cut before its runs instead.
_LONG_RUN = re.compile(f"[{WHITE}] (?:[{WHITE}]|\\Z)")
_RUN_AND_WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+\\Z")

#: Marks that stand after words and form a word of their own there, in any number.
TAIL = ".,!?;:#$%&*|()[]{}\"-_/+=~@^<>`\\"

#: Characters and entries of a cache's generation, and characters of text encoded at once.
CACHE_CHARS = 6_000_000
CACHE_ENTRIES = 300_000
BLOCK_CHARS = 3_000_000


def spaced_chunks(text: str) -> list[str]:
    """For byte-level tokenizers: each chunk with the space before it; joined they give the text."""
    if _LONG_RUN.search(text):
        return _RUN_AND_WORD.findall(text)
    first, *rest = text.split(" ")
    out = [f" {x}" for x in rest]
    return [first, *out] if first else out


class ChunkCache:
    """What each chunk gives, for the chunks of the last few blocks and those met again since.

    Two generations: when the young one is full it becomes the old one, and what is met again moves to the new young one.
    So a worker's memory does not grow with the corpus, and frequent chunks stay.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], entries: int = CACHE_ENTRIES) -> None:
        self.encode, self.entries = encode, entries
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.chars = 0

    def learn(self, needed: set[str]) -> dict[str, object]:
        """Encode what is not known yet of these chunks, all at once; gives a dictionary that holds them all."""
        if len(self.young) > self.entries or self.chars > CACHE_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        missing = needed.difference(self.young)
        old = self.old
        self.young.update([(x, old[x]) for x in missing if x in old])
        new = [x for x in missing if x not in old]
        self.chars += sum(map(len, missing))
        collecting = gc.isenabled()
        gc.disable()  # many small values and no cycles: nothing to look for meanwhile
        try:
            self.young.update(zip(new, self.encode(new), strict=True))
        finally:
            if collecting:
                gc.enable()
        return self.young


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters."""
    block, held = [], 0
    for text in texts:
        block.append(text)
        held += len(text)
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block


class ColumnCache:
    """What each chunk gives, as Arrow columns of bytes: a block's distinct chunks are looked up at once.

    When it is full, the chunks that were needed least recently go. ``encode`` gives a tuple of ``parts`` for each new chunk.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[tuple[bytes, ...]]], parts: int, entries: int = CACHE_ENTRIES) -> None:
        self.encode, self.entries, self.turn = encode, entries, 0
        self.keys = pa.array([], pa.string())
        self.parts = [pa.array([], pa.binary()) for _ in range(parts)]
        self.used = np.zeros(0, np.int64)

    def find(self, chunks: pa.Array) -> list[pa.Array]:
        """The parts of each of these distinct chunks."""
        self.turn += 1
        at = pc.index_in(chunks, value_set=self.keys)
        missing = chunks.filter(pc.is_null(at)).to_pylist()
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        if missing:
            collecting = gc.isenabled()
            gc.disable()  # many small values and no cycles: nothing to look for meanwhile
            try:
                made = list(zip(*self.encode(missing), strict=True))
            finally:
                if collecting:
                    gc.enable()
            place[place < 0] = np.arange(len(missing)) + len(self.keys)
            self.keys = pa.concat_arrays([self.keys, pa.array(missing, pa.string())])
            self.parts = [pa.concat_arrays([x, pa.array(y, pa.binary())]) for x, y in zip(self.parts, made, strict=True)]
            self.used = np.concatenate([self.used, np.zeros(len(missing), np.int64)])
        self.used[place] = self.turn
        wanted = pa.array(place)
        found = [x.take(wanted) for x in self.parts]
        if len(self.keys) > self.entries:
            kept = pa.array(np.argpartition(self.used, len(self.used) - self.entries * 2 // 3)[-(self.entries * 2 // 3) :])
            self.keys, self.parts = self.keys.take(kept), [x.take(kept) for x in self.parts]
            self.used = self.used[kept.to_numpy()]
        return found


def cut_column(texts: list[str], spaced: bool) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The distinct chunks of some texts, the number of each chunk in text order, and where each text's chunks start.

    Texts are cut at single spaces, and without ``spaced`` at line breaks; such chunks equal ``spaced_chunks`` where a text
    has no long run of white space, and the words between white space, with empty ones left in, without ``spaced``.
    """
    column = pa.array(texts, pa.string())
    if not spaced:
        column = pc.replace_substring(column, "\n", " ")
    lists = pc.split_pattern(column, " ")
    numbered = lists.values.dictionary_encode()
    chunks, index = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
    if spaced:  # all but a text's first chunk have their space
        heads = lists.values.take(lists.offsets[:-1]).dictionary_encode()
        index[lists.offsets.to_numpy()[:-1]] = heads.indices.to_numpy() + np.int64(len(chunks))
        chunks = pa.concat_arrays([pc.binary_join_element_wise(" ", chunks, ""), heads.dictionary])
    return chunks, index, lists.offsets


def joined(cut: tuple[pa.Array, np.ndarray, pa.Array], cache: ColumnCache) -> Iterator[tuple[bytes, ...]]:
    """For each text the bytes that its chunks have in the cache, joined, part by part."""
    chunks, index, starts = cut
    nothing = pa.scalar(b"", pa.binary())
    index = pa.array(index)
    yield from zip(*(pc.binary_join(pa.ListArray.from_arrays(starts, x.take(index)), nothing).to_pylist() for x in cache.find(chunks)), strict=True)


def joined_texts(texts: list[str], spaced: bool, cache: ColumnCache, whole: Callable[[str], bool] = lambda _: False) -> Iterator[tuple[bytes, ...] | None]:
    """The same for any number of texts, block by block; None for those that ``whole`` picks to be encoded otherwise."""
    for block in blocks(texts):
        kind = [0 if whole(x) else 1 if spaced and _LONG_RUN.search(x) else 2 for x in block]
        quick = [x for x, k in zip(block, kind, strict=True) if k == 2]
        found = {2: joined(cut_column(quick, spaced), cache) if quick else iter(())}
        if 1 in kind:
            lists = pa.array([spaced_chunks(x) for x, k in zip(block, kind, strict=True) if k == 1], pa.list_(pa.string()))
            numbered = lists.values.dictionary_encode()
            found[1] = joined((numbered.dictionary, numbered.indices.to_numpy(), lists.offsets), cache)
        for k in kind:
            yield next(found[k]) if k else None


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold little memory at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def texts_of(column: pa.Array) -> list[str]:
    """A batch's texts; null is the empty text."""
    return [x or "" for x in column.to_pylist()]
