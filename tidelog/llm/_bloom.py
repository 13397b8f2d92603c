"""Bloom filters built by DataFrame aggregation and asked in numpy.

They only thin rows out before an exact join: a full filter lets more rows through, never fewer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T

MOST_BITS = 28  # at most 2**28 bits, 32 MB, are broadcast


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter (64-bit words) of a long column ``k``, built by OR over the rows."""
    n = keys.count()
    bits = int(np.clip(np.ceil(np.log2(16 * n + 1)), 16, MOST_BITS))
    h = F.xxhash64("k")
    slot = F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(h, 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1)))).alias("s")
    words = keys.select(slot).groupBy(F.shiftrightunsigned("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), T.U64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(T.U64)
    return out


def has(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the Bloom filter holds each key."""
    bits = int(np.log2(len(words))) + 6
    h = spark_xxhash64(keys).view(T.U64)
    ok = np.ones(len(keys), bool)
    for s in (h >> T.U64(64 - bits), (h >> T.U64(64 - 2 * bits)) & T.U64((1 << bits) - 1)):
        ok &= ((words[(s >> T.U64(6)).astype(np.int64)] >> (s & T.U64(63))) & T.U64(1)).astype(bool)
    return ok


#: The five primes of the public XXH64 hash, which F.xxhash64 computes.
XXH64 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def spark_xxhash64(*columns: np.ndarray) -> np.ndarray:
    """F.xxhash64 of columns of longs, for whole arrays."""
    p1, p2, p3, p4, p5 = map(T.U64, XXH64)
    turn = lambda x, k: (x << T.U64(k)) | (x >> T.U64(64 - k))
    h = np.full(len(columns[0]), 42, T.U64)
    for c in columns:
        h = h + p5 + np.full(1, 8, T.U64) ^ (turn(c.view(T.U64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> T.U64(33))) * p2
        h = (h ^ (h >> T.U64(29))) * p3
        h ^= h >> T.U64(32)
    return h.view(np.int64)
