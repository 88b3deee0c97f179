"""Hashes, codecs and distances that Spark lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = (1 << 64) - 1
# Offset basis and prime of 64-bit FNV-1a; alphabet of z-base-32.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
ZBASE32 = "ybndrfg8ejkmcpqxot1uwisza345h769"


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & _MASK
    return h


def fnv1a_all(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many values: position by position over all that are long enough."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], dtype=np.int64)
    flat = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    h = np.full(len(order), FNV_BASIS, dtype=np.uint64)
    for at in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -at, side="left"))  # values longer than ``at``
        h[:k] = (h[:k] ^ flat[first[:k] + at]) * np.uint64(FNV_PRIME)
    out = np.empty(len(order), dtype=np.uint64)
    out[order] = h
    return out


@F.pandas_udf(T.StringType())
def fnv1a_hex(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit FNV-1a as 16 hexadecimal digits; null stays null."""
    for s in batches:
        made = fnv1a_all([b"" if x is None else x.encode() for x in s])
        yield pd.Series([None if x is None else f"{h:016x}" for x, h in zip(s, made.tolist(), strict=True)], dtype=object)


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (transposition costs one), or most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new[j] = d
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def osa_distance(a: Column, b: Column, most: int = 2) -> Column:
    @F.pandas_udf(T.IntegerType())
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q, most) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return each(a, b)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit as a signed number."""
    h, n = seed, len(data) // 4 * 4
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    for k in np.frombuffer(data[:n], dtype="<u4").tolist():
        k = rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if tail := data[n:]:
        k = rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@F.pandas_udf(T.IntegerType())
def icon_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Murmur3 over MIME base64 (lines of 76 and a final line end) of the bytes."""
    for s in batches:
        yield s.map(lambda x: None if x is None else murmur3_32(base64.encodebytes(bytes(x)))).astype("Int32")


@F.pandas_udf(T.StringType())
def base32_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else base64.b32encode(bytes(x)).decode())


@F.pandas_udf(T.BinaryType())
def base32_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Null for text that is no base32."""

    def one(x):
        try:
            return None if x is None else base64.b32decode(x.upper() + "=" * (-len(x) % 8))
        except ValueError:
            return None

    for s in batches:
        yield s.map(one)


def zbase32(data: bytes) -> str:
    bits = "".join(f"{b:08b}" for b in data)
    return "".join(ZBASE32[int(bits[i : i + 5].ljust(5, "0"), 2)] for i in range(0, len(bits), 5))


def hmac_sha256(key: bytes):
    @F.pandas_udf(T.StringType())
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest())

    return each
