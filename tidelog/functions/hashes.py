"""Hash expressions: checksums, digests, folds, mixes and probe addresses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers and shifts of the public 32-bit Murmur3 finaliser and body.
MURMUR3 = {"c1": 0xCC9E2D51, "c2": 0x1B873593, "n": 0xE6546B64, "f1": 0x85EBCA6B, "f2": 0xC2B2AE35}


def checksum(value: Column, meta: Column, meta_bytes: int = 152) -> Column:
    """CRC-32 of a value; of its first bytes only for meta values."""
    data = value.cast("binary")
    return F.crc32(F.when(meta, F.substring(data, 1, meta_bytes)).otherwise(data))


def sha_fold(key: Column) -> Column:
    """The eight big-endian 32-bit words of the SHA-256 digest, XORed (a long, 0 to 2**32-1)."""
    digest = F.sha2(key.cast("binary"), 256)
    words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    return reduce(lambda a, b: a.bitwiseXOR(b), words)


def probe_address(h: Column, step: Column, slots: int) -> Column:
    """Quadratic probing: (h + c + c*c) mod (slots - 1) + 1."""
    return F.pmod(h + step + step * step, F.lit(slots - 1)) + 1


#: Fixed value: the start of the string hash.
STRING_SEED = 5361


def string_hash(text: Column, seed: int = STRING_SEED) -> Column:
    """hash * 33 + byte over the bytes of ASCII text, modulo 2**32."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h * 33 + c) % (1 << 32))


def mix32(h: Column) -> Column:
    """Murmur3's finaliser on a long that holds 32 bits."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))

    def times(c: Column, m: int) -> Column:  # products are kept under 2**63
        return low(F.shiftleft(low(c * (m >> 16)), 16) + c * (m & 0xFFFF))

    h = low(h)
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), MURMUR3["f1"])
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), MURMUR3["f2"])
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def murmur3_bytes(data: bytes, seed: int) -> int:
    """Murmur3 x86-32 of one byte string."""
    return int(murmur3_many([data], seed)[0])


def murmur3_many(values: list[bytes], seed: int) -> np.ndarray:
    """Murmur3 x86-32 of many byte strings: four bytes of all of them a step."""
    size = np.array([len(v) for v in values], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(values) + bytes(4), np.uint8).astype(np.uint64)
    words = data[:-3] | data[1:-2] << np.uint64(8) | data[2:-1] << np.uint64(16) | data[3:] << np.uint64(24)
    mask = np.uint64(0xFFFFFFFF)
    c = {k: np.uint64(v) for k, v in MURMUR3.items()}
    rotl = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & mask
    scrambled = lambda k: rotl(k * c["c1"] & mask, 15) * c["c2"] & mask
    h = np.full(len(values), seed, np.uint64)
    on, at = np.flatnonzero(size >= 4), 0
    while len(on):
        h[on] = (rotl(h[on] ^ scrambled(words[begin[on] + at]), 13) * np.uint64(5) + c["n"]) & mask
        at += 4
        on = on[size[on] >= at + 4]
    tail = np.flatnonzero(size % 4)
    left = (size[tail] % 4).astype(np.uint64)
    h[tail] ^= scrambled(words[begin[tail] + size[tail] // 4 * 4] & ((np.uint64(1) << (np.uint64(8) * left)) - np.uint64(1)))
    h ^= size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(16))) * c["f1"] & mask
    h = (h ^ (h >> np.uint64(13))) * c["f2"] & mask
    return h ^ (h >> np.uint64(16))


def murmur3(seed: int = 2):
    """Arrow-batched UDF: Murmur3 x86-32 with any seed (Spark's F.hash treats tails differently)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            h = pd.Series(murmur3_many([b"" if b is None else bytes(b) for b in s], seed).astype(np.int64), dtype="Int64")
            yield h.mask(s.isna().to_numpy())

    return run
