"""Scalar functions on text and integers."""

from __future__ import annotations

import bz2
import lzma
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zipped_header(names: Column, values: Column) -> Column:
    """A map from a tab-separated line of names and one of values; the first of equal names counts, missing values are null."""
    n, v = F.split(names, "\t"), F.split(values, "\t")
    pairs = F.transform(n, lambda x, i: F.struct(x.alias("key"), F.get(v, i).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(n, p["key"]) == i + 1)
    return F.map_from_entries(first)


def flag_names(flags: Column, names: list[str]) -> Column:
    """The names of the bits that are set, lowest first."""
    table = F.array(*(F.lit(x) for x in names))
    return F.filter(table, lambda _, i: F.getbit(flags, i) == 1)


def canonical_id(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


#: Two-byte units, as hexadecimal digits in either byte order, with surrogates in pairs only.
_UTF16 = {"BE": "^(?:(?:[0-9A-CEF].|D[0-7])..|D[89AB]..D[CDEF]..)*$", "LE": "^(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[CDEF])*$"}


def utf16_text(data: Column, order: str = "LE") -> Column:
    """Two-byte text up to the first NUL; null if it is malformed, where Spark's own ``decode`` would fail the job."""
    units = F.regexp_extract(F.hex(data), "^((?:(?!0000)[0-9A-F]{4})*)", 1)
    return F.when(units.rlike(_UTF16[order]), F.decode(F.unhex(units), f"UTF-16{order}"))


def utf8_text(data: Column) -> Column:
    """Text from bytes; null if they are malformed."""
    return F.try_validate_utf8(data.cast("string"))


def code_page(charset: str):  # noqa: ANN201
    """The column function that decodes a code page, such as windows-1252, cp437 or shift_jis, which Spark's own ``decode``
    does not know; null where the bytes are no such text."""

    def one(data: bytes) -> str | None:
        try:
            return bytes(data).decode(charset)
        except UnicodeDecodeError:
            return None

    @F.pandas_udf(T.StringType())
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else one(x))

    return decode


def dos_timestamp(date: Column, time: Column) -> Column:
    """A timestamp without zone from a packed date (years since 1980, month, day) and time (hours, minutes, two seconds);
    null if there is no such day or time."""
    part = lambda c, at, bits: F.shiftright(c, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    year, month, day = part(date, 9, 7) + 1980, part(date, 5, 4), part(date, 0, 5)
    hour, minute, second = part(time, 11, 5), part(time, 5, 6), part(time, 0, 5) * 2
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def _unpack_adc(data: bytes, limit: int) -> bytes:
    """Runs of literals, and copies of earlier bytes by short or long distances."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        head = data[at]
        if head & 0x80:
            n = (head & 0x7F) + 1
            out += data[at + 1 : at + 1 + n]
            at += 1 + n
            continue
        if head & 0x40:
            n, back, at = (head & 0x3F) + 4, int.from_bytes(data[at + 1 : at + 3], "big") + 1, at + 3
        else:
            n, back, at = (head >> 2 & 0xF) + 3, ((head & 3) << 8 | data[at + 1]) + 1, at + 2
        _copy_back(out, back, n)
    return bytes(out[:limit])


def _unpack_lznt1(data: bytes, limit: int) -> bytes:
    """Chunks of up to 4 KB; how many of a copy's 16 bits are its distance grows with the place in the chunk."""
    out, at = bytearray(), 0
    while at + 2 <= len(data) and len(out) < limit:
        head = int.from_bytes(data[at : at + 2], "little")
        if not head:
            break
        chunk, at = data[at + 2 : at + 3 + (head & 0xFFF)], at + 3 + (head & 0xFFF)
        if not head & 0x8000:
            out += chunk
            continue
        piece, k = bytearray(), 0
        while k < len(chunk):
            flags, k = chunk[k], k + 1
            for bit in range(8):
                if k >= len(chunk):
                    break
                if not flags >> bit & 1:
                    piece.append(chunk[k])
                    k += 1
                    continue
                token, k = int.from_bytes(chunk[k : k + 2], "little"), k + 2
                lengths = 16 - max(4, (len(piece) - 1).bit_length())
                _copy_back(piece, (token >> lengths) + 1, (token & (1 << lengths) - 1) + 3)
        out += piece
    return bytes(out[:limit])


def _copy_back(out: bytearray, back: int, n: int) -> None:
    if back > len(out):
        raise ValueError("a copy from before the start")
    for _ in range(n):
        out.append(out[-back])


#: How stored chunks are unpacked; ``limit`` bounds what one may give.
def _unpack(kind: str, data: bytes, limit: int) -> bytes | None:
    try:
        if kind == "zlib":
            return zlib.decompressobj().decompress(data, limit)
        if kind == "deflate":
            return zlib.decompressobj(-15).decompress(data, limit)
        if kind == "bzip2":
            return bz2.BZ2Decompressor().decompress(data, limit)
        if kind in ("xz", "lzma"):
            return lzma.LZMADecompressor().decompress(data, limit)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)[:limit]
        if kind in ("adc", "lznt1"):
            return (_unpack_adc if kind == "adc" else _unpack_lznt1)(data, limit)
        return data[:limit] if kind == "none" else None
    except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, IndexError):
        return None
    except Exception as e:
        if type(e).__module__.startswith("zstandard"):
            return None
        raise


@F.pandas_udf(T.BinaryType())
def decompressed(kind: pd.Series, data: pd.Series, limit: pd.Series) -> pd.Series:
    """Chunks unpacked by kind (zlib, deflate, bzip2, xz, lzma, zstd, adc, lznt1, none), at most ``limit`` bytes; null if they cannot be."""
    return pd.Series([None if d is None or k is None else _unpack(k, bytes(d), int(n)) for k, d, n in zip(kind, data, limit, strict=True)], dtype=object)
