"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is described by the shares of its character classes and of
neighbouring pairs of classes, its mean word length and the share of words that repeat the word before; a small network
encodes it, a gated attention (tanh times sigmoid) weighs the passages, and the weighted mean is scored. Only document
labels are used; the network finds the passages that matter.

Learning takes a bounded sample of the labelled documents, in the order of a hash of the id: at most ``MAX_LABELLED``
documents, as long as they have at most ``MAX_PASSAGES`` passages together. Every passage of these documents is encoded,
in tasks; the driver gets 844 bytes for each, at most 51 MB, and fits batch by batch. A first document that has more
passages alone is taken. Scoring is one pass over whole texts without a shuffle.

Defined results: a null or empty text, or one without words, is one blank passage and gets that passage's score; with no
labels, or labels of one kind only, every score is that kind's share (0.5 without labels); several labels of one
document count as the largest; repeated rows are scored alike and learned from once; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.llm.chunked import blocks, texts_of
from strataspark.llm.storage import materialise

PASSAGE_WORDS = 64
MAX_LABELLED = 4000
MAX_PASSAGES = 60_000
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.004, 1e-4

_CLASS = np.full(256, 17, np.uint8)
for _i, _chars in enumerate(("\t\x0b\x0c\r ", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "#", "*", "$", "%", "&", "|", "<>", "'\"")):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:192], _CLASS[192:] = 18, 19
CLASSES = 20
FEATURES = CLASSES * CLASSES + CLASSES + 2


def passages(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's passages as rows of features; at least one row."""
    for block in blocks(texts, 1_000_000):
        parts = [x.encode("utf-8", "surrogatepass") for x in block]
        data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        cls = _CLASS[data]
        space = cls <= 1
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        edges = np.cumsum([0, *(len(x) + 1 for x in parts)])
        first = np.searchsorted(starts, edges)
        words = np.diff(first)
        count = np.maximum(1, -(-words // PASSAGE_WORDS))
        base = np.concatenate(([0], np.cumsum(count)))
        total = int(base[-1])
        doc_of_word = np.repeat(np.arange(len(block)), words)
        passage_of_word = base[doc_of_word] + (np.arange(len(starts)) - first[doc_of_word]) // PASSAGE_WORDS
        # A character belongs to the passage of the last word that started, white space before the first word to the first.
        doc_of_char = np.repeat(np.arange(len(block)), np.diff(edges))
        word_of_char = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
        own = (word_of_char >= first[doc_of_char]) & (word_of_char >= 0)
        passage = np.where(own, passage_of_word[np.maximum(word_of_char, 0)] if len(starts) else 0, base[doc_of_char])
        one = np.bincount(passage * CLASSES + cls, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
        same = passage[1:] == passage[:-1]
        pair = passage[:-1] * (CLASSES * CLASSES) + cls[:-1].astype(np.int64) * CLASSES + cls[1:]
        two = np.bincount(pair[same], minlength=total * CLASSES * CLASSES).reshape(total, -1).astype(np.float32)
        size = np.maximum(1, one.sum(axis=1, keepdims=True))
        n_words = np.maximum(1, np.bincount(passage_of_word, minlength=total))
        letters = (size[:, 0] - one[:, 0] - one[:, 1]) / n_words / 16
        again = np.zeros(total, np.float32)
        if len(starts) > 1:
            place = np.arange(len(data)) - starts[np.maximum(word_of_char, 0)]
            value = np.where(space, 0, (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)))
            code = np.add.reduceat(value, starts)
            repeat = (code[1:] == code[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
            again = np.bincount(passage_of_word[1:][repeat], minlength=total) / n_words
        rows = np.concatenate([np.sqrt(one / size), np.sqrt(two / size), letters[:, None], again[:, None]], axis=1).astype(np.float32)
        for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True):
            yield rows[a:b]


class Model:
    """Encoder, gated attention and scorer."""

    NAMES = ("w", "wb", "v", "u", "a", "c", "cb")

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.3, (FEATURES, HIDDEN)).astype(np.float32)
        self.wb = np.zeros(HIDDEN, np.float32)
        self.v = rng.normal(0, 0.3, (HIDDEN, GATE)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (HIDDEN, GATE)).astype(np.float32)
        self.a = rng.normal(0, 0.3, GATE).astype(np.float32)
        self.c = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.cb = np.zeros(1, np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """x: passages of several bags, one after the other; starts: each bag's first row."""
        h = np.tanh((x - self.mean) / self.scale @ self.w + self.wb)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.cb, -30, 30)))
        return h, t, g, alpha, bag, z, p

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)[-1].astype(np.float64) if bags else np.zeros(0)

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 12) -> Model:
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        n = sum(map(len, bags))
        mean = sum(x.sum(axis=0, dtype=np.float64) for x in bags) / n
        spread = sum(((x - mean) ** 2).sum(axis=0) for x in bags) / n
        self.mean, self.scale = mean.astype(np.float32), np.sqrt(spread).astype(np.float32) + np.float32(0.05)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        s = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                x = np.concatenate([bags[k] for k in own]).astype(np.float32)
                starts = np.cumsum([0, *(len(bags[k]) for k in own[:-1])])
                step += 1
                for k, d in self._gradients(x, starts, labels[own]).items():
                    d = d + DECAY * getattr(self, k)
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.999 * s[k] + 0.001 * d * d
                    rate = RATE * (1 - epoch / EPOCHS)
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        return self

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, t, g, alpha, bag, z, p = self.forward(x, starts)
        d_out = ((p - y) / len(y)).astype(np.float32)
        d_z = d_out[:, None] * self.c
        d_alpha = (d_z[bag] * h).sum(axis=1)
        d_e = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, starts)[bag])
        d_tg = d_e[:, None] * self.a
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_h = (alpha[:, None] * d_z[bag] + d_t @ self.v.T + d_g @ self.u.T) * (1 - h * h)
        return {
            "w": ((x - self.mean) / self.scale).T @ d_h, "wb": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_g,
            "a": (t * g).T @ d_e, "c": z.T @ d_out, "cb": d_out.sum(keepdims=True),
        }


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_passages: int = MAX_PASSAGES) -> Model:
    """Fit on every passage of a bounded sample of the labelled documents."""
    known = labels.select(F.col(id_col).alias("row_key"), F.col(label_col).cast("int").alias("label")).filter("row_key is not null AND label is not null")
    sample = known.groupBy("row_key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("row_key"), "row_key").limit(max_labelled)
    bags_of = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("body")).join(F.broadcast(sample), "row_key").select("row_key", "label", "body").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [x.astype("<f2") for x in passages(texts_of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in bags], pa.int64()), pa.array([x.tobytes() for x in bags], pa.binary())], names=["row_key", "label", "n", "rows"]
            )

    kind = bags_of.schema["row_key"].dataType.simpleString()
    encoded = materialise(bags_of.mapInArrow(run, f"row_key {kind}, label int, n long, rows binary").withColumn("tie", F.md5("rows")), "labelled-passages")
    # The one window is over counts of the sample's rows, not their passages.
    order = Window.orderBy(F.xxhash64("row_key"), "row_key", "tie")
    counts = encoded.select("row_key", "tie", "n", F.row_number().over(order).alias("place"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))
    last = counts.filter((F.col("so_far") <= max_passages) | (F.col("place") == 1)).orderBy(F.desc("place")).limit(1).collect()
    if not last:
        return Model().fit([], np.zeros(0))
    at = F.struct(F.xxhash64("row_key"), F.col("row_key"), F.col("tie"))
    end = F.struct(F.xxhash64(F.lit(last[0]["row_key"]).cast(kind)), F.lit(last[0]["row_key"]).cast(kind), F.lit(last[0]["tie"]))
    found = encoded.filter(at <= end).orderBy(F.xxhash64("row_key"), "row_key", "tie").select("label", "rows").toArrow()
    bags = [np.frombuffer(x.as_buffer(), "<f2").reshape(-1, FEATURES) for x in found["rows"]]
    return Model().fit(bags, np.array(found["label"].to_pylist(), np.float32))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """The id, any carried columns, ``score`` and ``predicted``."""
    d = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("body"), *carry)
    schema = d.drop("body").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, held = [], []
            for bag in passages(texts_of(batch.column(1))):
                held.append(bag)
                if len(held) == 256:
                    score.append(model.score(held))
                    held = []
            score = np.concatenate([*score, model.score(held)])
            rest = [c for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[f.name for f in schema])

    return d.mapInArrow(run, schema).withColumnRenamed("row_key", id_col)
