"""Token ids as length-delimited binary records, with an offset index.

The format is this library's own, and so are its readers. A record is framed as: payload length (8 bytes), masked checksum
of those 8 bytes (4), payload, masked checksum of the payload (4), a line feed. The checksum is CRC-32 (not the CRC-32C of
other record formats), masked by a rotation of 15 bits and a constant, so that data which itself holds checksums stays
safe. The payload is the document id (8 bytes, signed), flags (1: bit 0 an id is present,
bit 1 ids take 4 bytes, else 2) and the ids. All numbers are little-endian.

The files are written by Spark's text writer, whose line separator is the frame's last byte: so records go through the
cluster's own file system and commit protocol, and a lost task leaves no half file. The writer takes strings, so frames
are cast from bytes to string unchecked and written as they are; the round trip is tested on every byte value. Files
follow ascending ids: the rows are range-partitioned by id and sorted within. Frames are handed over in runs of about
``RUN_BYTES`` and a file holds at most ``FILE_RUNS`` of these, so a file is bounded by bytes: about 32 MB, more only by its
records of over 256 KB. Nothing is gathered: file totals, one row a file, give each file's first id position.

Defined results: a null or empty text is the end id alone; null ids come first; rows that repeat an id are all written,
ordered by a hash of their text; an empty table gives no records. Ids must be integers. Only the named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.llm.chunked import small_batches, texts_of
from strataspark.llm.library_bpe import encoder, read_definition

#: Fixed value of the checksum's mask.
MASK_DELTA = 0xA282EAD8
#: Bytes of frames after which a run ends, with the record it is in, and runs in a file at most.
RUN_BYTES, FILE_RUNS = 256 << 10, 128

_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<qB")
INDEX = "part long, path string, offset long, length long, row_key long, n_tokens long, file_start long, ids_crc32 long"


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(row_key: int | None, ids: bytes) -> bytes:
    """One record without its closing line feed; ids: little-endian unsigned 32-bit."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    payload = _KEY.pack(row_key or 0, (row_key is not None) | (0 if narrow else 2)) + (wide.astype("<u2").tobytes() if narrow else ids)
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_checksum(length)) + payload + struct.pack("<I", masked_checksum(payload))


def unframe(data: bytes | memoryview, offset: int) -> tuple[int | None, bytes, int]:
    """The id and ids of the record at this offset and where the next one starts; raises if a checksum is wrong."""
    n, check = _HEAD.unpack_from(data, offset)
    if masked_checksum(bytes(data[offset : offset + 8])) != check:
        raise ValueError(f"the length at offset {offset} does not match its checksum")
    at = offset + _HEAD.size
    payload = bytes(data[at : at + n])
    if masked_checksum(payload) != struct.unpack_from("<I", data, at + n)[0]:
        raise ValueError(f"the record at offset {offset} does not match its checksum")
    key, flags = _KEY.unpack_from(payload)
    ids = payload[_KEY.size :]
    return key if flags & 1 else None, ids if flags & 2 else np.frombuffer(ids, "<u2").astype("<u4").tobytes(), at + n + 5


def write_records(docs: DataFrame, path: str, definition_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the records in ascending id order below ``path``."""
    d = docs.select(F.col(id_col).cast("long").alias("row_key"), F.col(text_col).alias("body")).withColumn("tie", F.xxhash64("body"))
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(definition_path))  # the vocabulary file, under 2 MB
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(definition.value)
        for batch in small_batches(batches):
            keys, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            framed, size = [], 0
            for k, ids in zip(keys, coder.encode(texts), strict=True):
                framed.append(frame(k, ids + end))
                size += len(framed[-1])
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(framed)], pa.binary())], names=["value"])
                    framed, size = [], 0
            if framed:
                yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(framed)], pa.binary())], names=["value"])

    sorted_ = d.repartitionByRange("row_key", "tie").sortWithinPartitions("row_key", "tie")
    framed = sorted_.select("row_key", "body").mapInArrow(run, "value binary")
    framed.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RUNS).text(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """The index of the files below ``path``, read whole, checksums verified: ``INDEX``; ``file_start`` counts the ids before
    the record in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, part, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = memoryview(content.as_buffer())
                rows, at, start = [], 0, 0
                while at < len(data):
                    key, ids, after = unframe(data, at)
                    rows.append((part, file, at, after - at, key, len(ids) // 4, start, zlib.crc32(ids)))
                    at, start = after, start + len(ids) // 4
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    part = F.regexp_extract("path", r"part-(\d+)-", 1).cast("long") * 1_000_000 + F.regexp_extract("path", r"-c(\d+)(?:\.[^/]*)?$", 1).cast("long")
    return files.select("path", part.alias("part"), "content").mapInArrow(run, INDEX)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Write the offset index as Parquet and return it as read back."""
    scan_records(spark, path).write.parquet(index_path)
    return spark.read.parquet(index_path)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all records before. Files, not records, pass the one window."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("part", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("first"))
    return index.join(firsts, "part").withColumn("start", F.col("first") + F.col("file_start")).drop("first")


def read_by_index(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """(row_key, ids) of some rows of the index, in any order: each file that holds one is read and cut at the offsets."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    offsets = wanted.groupBy("path").agg(F.collect_list("offset").alias("offsets"))  # a file is bounded by bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                found = [unframe(data, x) for x in at]
                ids = [np.frombuffer(x, "<u4").tolist() for _, x, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["row_key", "ids"])

    return files.join(offsets, "path").select("content", "offsets").mapInArrow(run, "row_key long, ids array<bigint>")
