"""Checksums that Spark has no function for, in Arrow batches."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fletcher64_of(data: bytes) -> int:
    """Both sums over little-endian 32-bit words after the first 8 bytes, which hold the checksum, modulo 2^32 - 1."""
    words = np.frombuffer(data[8 : len(data) - len(data) % 4], "<u4").astype(np.uint64)
    limit = (1 << 32) - 1
    low = high = 0
    for i in range(0, len(words), 1024):  # sums of a block fit 64 bits
        part = words[i : i + 1024]
        high = (high + low * len(part) + int((part * np.arange(len(part), 0, -1, dtype=np.uint64)).sum())) % limit
        low = (low + int(part.sum())) % limit
    first = limit - (low + high) % limit
    return (limit - (low + first) % limit) << 32 | first


@F.pandas_udf(T.DecimalType(20, 0))
def fletcher64(blocks: pd.Series) -> pd.Series:
    from decimal import Decimal

    return blocks.map(lambda b: None if b is None else Decimal(fletcher64_of(bytes(b))))


@F.pandas_udf(T.LongType())
def adler32(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: None if b is None else zlib.adler32(bytes(b)))


@F.pandas_udf(T.LongType())
def byte_sum(blocks: pd.Series) -> pd.Series:
    """The sum of the bytes."""
    return blocks.map(lambda b: None if b is None else int(np.frombuffer(b, np.uint8).sum(dtype=np.int64)))


def _tables(polynomial: int) -> np.ndarray:
    """For eight bytes at once: table k has what a byte followed by k zero bytes leaves."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, first >> 1 ^ np.uint32(polynomial), first >> 1)
    out = [first]
    for _ in range(7):
        out.append(out[0][out[-1] & 255] ^ out[-1] >> 8)
    return np.array(out)


#: The reflected polynomials of CRC-32C and CRC-32.
_CASTAGNOLI, _CRC32 = _tables(0x82F63B78), _tables(0xEDB88320)


def _crc(blocks: list[bytes], tables: np.ndarray, start: int) -> np.ndarray:
    """The register after each block. Headers end in long runs of zeros, which move the register on by a matrix."""
    cut = [bytes(b).rstrip(b"\0") for b in blocks]
    crc = _crc_in_step(cut, tables, start)
    zeros = np.array([len(b) - len(c) for b, c in zip(blocks, cut, strict=True)], np.int64)
    for n in np.unique(zeros[zeros > 0]):
        rows = zeros == n
        old, new = crc[rows], np.zeros(int(rows.sum()), np.uint32)
        for i, column in enumerate(_moved_on(int(n), int(tables[0][128]))):
            new ^= (old >> np.uint32(i) & np.uint32(1)) * np.uint32(column)
        crc[rows] = new
    return crc


def _crc_in_step(blocks: list[bytes], tables: np.ndarray, start: int) -> np.ndarray:
    """The register after each block, all blocks in step: eight bytes of every block that still has them at once."""
    size = np.array([len(b) for b in blocks], np.int64)
    order = np.argsort(-size, kind="stable")
    width = int(size.max(initial=0) + 7) // 8 * 8
    crc = np.full(len(blocks), start, np.uint32)
    for group in np.array_split(order, max(1, len(order) * max(width, 1) // (64 << 20) + 1)):
        if not len(group):
            continue
        wide = int(size[group[0]] + 7) // 8 * 8
        data = np.zeros((len(group), wide), np.uint8)
        for row, k in enumerate(group):
            data[row, : size[k]] = np.frombuffer(blocks[k], np.uint8)
        now, left = crc[group], size[group]
        for at in range(0, wide, 8):
            n = int(np.searchsorted(-left, -(at + 8), side="right"))  # blocks with eight more bytes
            if n:
                x = data[:n, at : at + 8].astype(np.uint32)
                head = now[:n] ^ (x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16 | x[:, 3] << 24)
                now[:n] = (
                    tables[7][head & 255] ^ tables[6][head >> 8 & 255] ^ tables[5][head >> 16 & 255] ^ tables[4][head >> 24]
                    ^ tables[3][x[:, 4]] ^ tables[2][x[:, 5]] ^ tables[1][x[:, 6]] ^ tables[0][x[:, 7]]
                )
            for row in range(n, len(group)):
                if left[row] <= at:
                    break
                for b in data[row, at : left[row]]:
                    now[row] = tables[0][(now[row] ^ b) & 255] ^ now[row] >> 8
        crc[group] = now
    return crc


def crc32c_of(data: bytes) -> int:
    return int(_crc([data], _CASTAGNOLI, 0xFFFFFFFF)[0]) ^ 0xFFFFFFFF


def weak_crc32_of(data: bytes, initial: int) -> int:
    """CRC-32 from a given register, without the final inversion."""
    return int(_crc([data], _CRC32, initial)[0])


def _over(blocks: pd.Series, tables: np.ndarray, start: int, invert: int) -> pd.Series:
    present = blocks.notna().to_numpy()
    out = pd.Series([None] * len(blocks), dtype="Int64")
    out[present] = (_crc([bytes(b) for b in blocks[present]], tables, start) ^ np.uint32(invert)).astype(np.int64)
    return out


@F.pandas_udf(T.LongType())
def crc32c(blocks: pd.Series) -> pd.Series:
    return _over(blocks, _CASTAGNOLI, 0xFFFFFFFF, 0xFFFFFFFF)


def weak_crc32(initial: int):  # noqa: ANN201
    """The column function for a given first register."""

    @F.pandas_udf(T.LongType())
    def weak(blocks: pd.Series) -> pd.Series:
        return _over(blocks, _CRC32, initial, 0)

    return weak


def fold_crc32(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of data from the CRC-32 and length of its consecutive parts, in order."""
    total = 0
    for crc, length in parts:
        total = zlib_combine(total, crc, length)
    return total


def _times(m: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v, i = v >> 1, i + 1
    return out


@lru_cache(maxsize=128)
def _zero_bytes(log: int, polynomial: int) -> tuple[int, ...]:
    """What 2^log zero bytes do to a register, as a matrix of 32 columns."""
    if log == -3:
        return (polynomial, *(1 << i for i in range(31)))  # one zero bit
    half = _zero_bytes(log - 1, polynomial)
    return tuple(_times(half, x) for x in half)


@lru_cache(maxsize=4096)
def _moved_on(length: int, polynomial: int = 0xEDB88320) -> tuple[int, ...]:
    """What ``length`` zero bytes do: pieces of few sizes recur, so each size is worked out once."""
    out = tuple(1 << i for i in range(32))
    for log in range(length.bit_length()):
        if length >> log & 1:
            out = tuple(_times(_zero_bytes(log, polynomial), x) for x in out)
    return out


def zlib_combine(one: int, two: int, length: int) -> int:
    """The CRC-32 of two pieces, the second of ``length`` bytes: the first is moved on by that many zero bytes."""
    return (_times(_moved_on(length), one) if one else 0) ^ two


@F.pandas_udf(T.LongType())
def folded_crc32(parts: pd.Series) -> pd.Series:
    """From arrays of (crc, length) structs in order: what CRC-32 the whole has. Parts are small, so a group is too."""
    return parts.map(lambda p: None if p is None else fold_crc32([(x["crc"], x["length"]) for x in p]))
