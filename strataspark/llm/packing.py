"""Packing by non-negative least squares over length combinations.

A document's ids are cut into full windows and one remainder. The remainders' histogram, at most window - 1 numbers
whatever the corpus, goes to the driver. There, shallow combinations of one to three lengths that fill a window exactly
are enumerated, repeat counts are solved by non-negative least squares against the histogram, rounded within what the
histogram holds, and what is left is packed greedily, largest first, in bulk: each step repeats one combination until a
length runs out, so there are no more steps than lengths.

Pieces then find their places without meeting: a piece's number among all pieces of its length comes from counts per
(length, bucket) and a row number within the bucket, and the plan maps (length, number) to (sequence, offset). Buckets
grow in number with the corpus, so a length that a third of all pieces share is spread evenly.

A sequence is padded to the window unless its length is a power of two.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an empty
table gives no pieces; very long texts give many full windows. Only the named columns are read. The piece table is
written to the shared folder, so a lost executor does not repeat the encoding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.llm.chunked import small_batches, texts_of
from strataspark.llm.library_bpe import encoder, read_definition
from strataspark.llm.storage import materialise

WINDOW = 1024
#: Combinations of three lengths are taken where the smallest is a multiple of this, so that a few thousand are solved at once.
TRIPLE_STEP = 16
NNLS_STEPS = 400
#: Pieces of one length to a bucket, about; the number of buckets follows from the corpus.
BUCKET_PIECES = 20_000


def cut_pieces(docs: DataFrame, definition_path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(row_key, start, length, ids_crc32, doc_tokens, ids): each document's full windows and its remainder."""
    d = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("body"))
    kind = d.schema["row_key"].dataType.simpleString()
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(definition_path))  # the vocabulary file, under 2 MB
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(definition.value)
        for batch in small_batches(batches):
            at, start, length, crc, total, held = [], [], [], [], [], []
            for row, encoded in enumerate(coder.encode(texts_of(batch.column(1)))):
                ids = encoded + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    piece = ids[4 * s : 4 * (s + window)]
                    at.append(row)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    held.append(np.frombuffer(piece, "<u4").tolist() if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(held, pa.list_(pa.int32()))],
                names=["row_key", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    return d.mapInArrow(run, f"row_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Shallow combinations of the lengths present that fill the window exactly: rows of three lengths, 0 where fewer."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    out = [(window, 0, 0)] if present[window] else []
    for a in lengths[lengths < window]:
        b = window - a
        if a <= b and present[b]:
            out.append((b, a, 0))
        if a % TRIPLE_STEP == 0:
            for b in lengths[(lengths >= a) & (lengths <= (window - a) // 2)]:
                if present[c := window - a - b]:
                    out.append((c, b, a))
    return np.array(out, np.int64).reshape(-1, 3)


def nnls(columns: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient; a column adds 1 at each length it names, 0 named none."""
    if not len(columns):
        return np.zeros(0)

    def add(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(target))
        for k in range(columns.shape[1]):
            total += np.bincount(columns[:, k], weights=x, minlength=len(target))
        total[0] = 0
        return total

    used = add(np.ones(len(columns)))
    step = 1.0 / max(1.0, columns.shape[1] * used.max())
    goal = target.astype(float)
    goal[0] = 0
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(NNLS_STEPS):
        residual = add(y) - goal
        residual[0] = 0
        slope = residual[columns].sum(axis=1)
        new = np.maximum(0, y - step * slope)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pack_histogram(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up ``counts`` (by length, 0 to window) exactly."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    columns = combinations(np.flatnonzero(left), window)
    solved = nnls(columns, left)
    for k in np.argsort(-solved, kind="stable"):
        if solved[k] < 0.5:
            break
        lengths = [int(x) for x in columns[k] if x]
        most = min(int(left[x]) // lengths.count(x) for x in lengths)
        repeats = min(int(np.rint(solved[k])), most)
        if repeats:
            plan.append((tuple(lengths), repeats))
            for x in lengths:
                left[x] -= repeats
    while left.any():
        room, lengths, rest = window, [], left.copy()
        while room and (fit := np.flatnonzero(rest[: room + 1])).size:
            x = int(fit[-1])
            lengths.append(x)
            rest[x] -= 1
            room -= x
        repeats = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        plan.append((tuple(lengths), repeats))
        for x in lengths:
            left[x] -= repeats
    return plan


class Places:
    """The plan as arrays: the number of a piece among those of its length gives its sequence and offset."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]) -> None:
        rows, sequence, taken = [], 0, {}
        for lengths, repeats in plan:
            offset = 0
            for x in lengths:
                rows.append((x, taken.get(x, 0), sequence, offset))
                taken[x] = taken.get(x, 0) + repeats
                offset += x
            sequence += repeats
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.length, self.first, self.sequence, self.offset = table.T
        self.starts = np.searchsorted(self.length, np.arange(int(self.length.max(initial=0)) + 2))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for own in np.split(order, edges) if len(order) else []:
            a, b = self.starts[length[own[0]]], self.starts[length[own[0]] + 1]
            at[own] = a + np.searchsorted(self.first[a:b], number[own], side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces (row_key, start, length, …; read twice, so given as a written table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    places = spark.sparkContext.broadcast(Places(pack_histogram(counts, window)))
    buckets = int(min(65_536, max(16, counts.sum() // BUCKET_PIECES)))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_key", "start"), F.lit(buckets)))
    held = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("row_key", "start", "ids_crc32")
    numbered = dealt.withColumn("nth", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).withColumn("number", F.col("first") + F.col("nth"))
    numbered = numbered.drop("bucket", "nth", "first")
    at = numbered.columns.index("length"), numbered.columns.index("number")
    schema = numbered.drop("number").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            sequence, offset = places.value.find(length, number)
            kept = [c for i, c in enumerate(batch.columns) if i != at[1]]
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, definition_path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if ``with_ids``, ``ids``."""
    pieces = cut_pieces(docs, definition_path, end_id, window, id_col, text_col, with_ids)
    packed = pack(materialise(pieces if with_ids else pieces.drop("ids"), "pieces"), window)
    return packed.withColumnRenamed("row_key", id_col)
