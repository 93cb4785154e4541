"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds) its n-grams' vectors. A language's
prototype is the bundle of its documents' vectors, each scaled to one length, and a document goes to the prototype with
the highest cosine.

Learning is one pass with partial bundles per task (languages x dimensions integers) that are summed by key, so it covers
all rows and does not depend on their order. The prototypes, one vector of 8 KB per language, are the only rows at the
driver: a column with more than ``MAX_LANGUAGES`` values is no language column and is refused with an error, not cut.
Prediction is one pass without a shuffle.

Defined results: a null text and a text without letters are ``und`` with score 0, as is any text if nothing was learned;
equal cosines go to the first language by name; rows without a language are not learned from; repeated rows count as
often as they occur; an empty table gives an empty result; texts are read whole. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.chunked import blocks, texts_of

DIMENSIONS = 1024
GRAM = 3
SEED = 7
#: Characters to a block, and n-grams whose vectors exist at once.
BLOCK = 500_000
GRAMS_AT_ONCE = 4096
#: A document vector's length when it is learned: integers make the sums exact in any order.
UNIT = 1 << 20
#: Languages that may be learned: 32 MB of prototypes.
MAX_LANGUAGES = 4096

_LETTER_VECTORS: dict[int, np.ndarray] = {}
_IS_LETTER = np.zeros(0x110000, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _IS_LETTER[97]:
        _IS_LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _IS_LETTER[codes]


def letter_vector(code: int) -> np.ndarray:
    """The letter's random vector; code 0 is the gap between words."""
    if code not in _LETTER_VECTORS:
        if len(_LETTER_VECTORS) > 20_000:
            _LETTER_VECTORS.clear()
        _LETTER_VECTORS[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return _LETTER_VECTORS[code]


def text_vectors(texts: list[str]) -> np.ndarray:
    """The bundle of each text's n-grams, one row a text; a row of zeros has no letters."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    row = 0
    for block in blocks(texts, BLOCK):
        lowered = [f" {x.lower()} " for x in block]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(block)), [len(x) for x in lowered])
        codes = np.where(_letters(codes), codes, 0)
        # A run of other characters is one gap; each text starts with one.
        kept = (codes != 0) | np.concatenate(([True], (codes[:-1] != 0) | (owner[1:] != owner[:-1])))
        codes, owner = codes[kept], owner[kept]
        if len(codes) >= GRAM:
            out[row : row + len(block)] = _bundle(codes, owner, len(block))
        row += len(block)
    return out


def _bundle(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    alphabet, local = np.unique(codes, return_inverse=True)
    size = len(alphabet)
    vectors = np.stack([letter_vector(int(c)) for c in alphabet])
    gram = np.zeros(len(codes) - GRAM + 1, np.int64)
    for k in range(GRAM):
        gram = gram * size + local[k : len(codes) - GRAM + 1 + k]
    whole = owner[: len(gram)] == owner[GRAM - 1 :]
    gram, of = gram[whole], owner[: len(whole)][whole]
    if size**GRAM <= 4_000_000:
        present = np.flatnonzero(np.bincount(gram, minlength=size**GRAM))
        number = np.zeros(size**GRAM, np.int64)
        number[present] = np.arange(len(present))
        gram = number[gram]
    else:
        present, gram = np.unique(gram, return_inverse=True)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for first in range(0, len(present), GRAMS_AT_ONCE):
        part = present[first : first + GRAMS_AT_ONCE]
        bound = np.ones((len(part), DIMENSIONS), np.int8)
        for k in range(GRAM):
            bound *= np.roll(vectors, GRAM - 1 - k, axis=1)[part // size ** (GRAM - 1 - k) % size]
        mine = (gram >= first) & (gram < first + len(part))
        counts = np.bincount(of[mine] * len(part) + gram[mine] - first, minlength=n * len(part)).reshape(n, len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """One unit vector per language of the given rows, however many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            vectors = np.rint(_unit(text_vectors(texts_of(batch.column(0)))) * UNIT).astype(np.int64)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    partial = docs.select(F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null AND body is not null")
    places = partial.mapInArrow(run, "lang string, bundle array<bigint>").select("lang", F.posexplode("bundle").alias("place", "value"))
    summed = places.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("bundle"))
    rows = summed.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    out = {r["lang"]: np.array(r["bundle"], np.float64) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """The id, any carried columns, ``lang_pred`` and ``score``: the best cosine, not below 0."""
    d = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("body"), *carry)
    names = list(prototypes)
    matrix = np.stack([prototypes[x] for x in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    schema = d.drop("body").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = text_vectors(texts_of(batch.column(1)))
            found = vectors.any(axis=1) & bool(names)
            cosines = (_unit(vectors) @ matrix.T).astype(np.float64) if names else np.zeros((len(vectors), 1))
            best = cosines.argmax(axis=1) if len(vectors) else np.zeros(0, np.int64)
            langs = [names[i] if f else "und" for i, f in zip(best, found, strict=True)]
            score = np.where(found, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
            rest = [c for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(score)], names=[f.name for f in schema])

    return d.mapInArrow(run, schema).withColumnRenamed("row_key", id_col)
