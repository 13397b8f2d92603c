"""Encodings of key pages: deltas within a prefix, packed key lists, exact Bloom filters per segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashes import murmur3_many


def delta_encode(rows: DataFrame, *keep: str) -> DataFrame:
    """Each row's block as its prefix's first block plus a delta; further columns to keep."""
    base = rows.groupBy("inode").agg(F.min("block").alias("base"))  # a row a prefix, so a crowded one stays spread
    return rows.join(base, "inode").select(*keep, "inode", "block", "base", (F.col("block") - F.col("base")).alias("delta"))


def delta_decode(rows: DataFrame) -> DataFrame:
    return rows.select("inode", (F.col("base") + F.col("delta")).alias("block"))


def delta_find(rows: DataFrame, inode: int | None, block: int) -> DataFrame:
    """Lookup in encoded rows without decoding them; inode None: in every prefix."""
    own = F.lit(True) if inode is None else F.col("inode") == inode
    return rows.filter(own & (F.col("delta") == F.lit(block) - F.col("base")))


def pack_keys(rows: DataFrame) -> DataFrame:
    """Each segment's keys as one ordered array of (key, address)."""
    return rows.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("key_str", "pos"))).alias("keys"))


def visit_keys(packed: DataFrame, visitor) -> DataFrame:
    """Each segment's keys, in order, as visitor makes them (a function of the column of one key)."""
    return packed.select("segment", F.posexplode(F.transform("keys", visitor)).alias("at", "seen"))


def search_layout(rows: DataFrame, n: Column) -> DataFrame:
    """Rows with ``node`` (from 1), the place of their pos (0 to n - 1) in the breadth-first layout of the
    complete search tree: the children of node k are 2k and 2k + 1.

    In a perfect tree the q-th key (from 1) lies as many levels above the leaves as q has trailing zero
    bits.  The leaves of the last level come between the first keys; behind them the tree is the perfect
    one without that level."""
    height = F.floor(F.log2(n))
    leaves = n - F.pow(F.lit(2), height).cast("long") + 1
    deep = F.col("pos") < 2 * leaves
    q, h = F.when(deep, F.col("pos") + 1).otherwise(F.col("pos") - leaves + 1), F.when(deep, height).otherwise(height - 1)
    zeros = F.bit_count(q.bitwiseAND(-q) - 1)
    node = F.pow(F.lit(2), h - zeros).cast("long") + F.floor(q / F.pow(F.lit(2), zeros + 1))
    return rows.withColumn("node", node)


def unpack_keys(packed: DataFrame) -> DataFrame:
    return packed.select("segment", F.explode("keys").alias("k")).select("segment", "k.key_str", "k.pos")


def _positions(keys: pd.Series, bits: int, hashes: int) -> np.ndarray:
    """Bit positions (keys, hashes) by double hashing."""
    data = [k.encode() for k in keys]
    a, b = murmur3_many(data, 2), murmur3_many(data, 3) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def bloom_filters(rows: DataFrame, bits: int = 8192, hashes: int = 6) -> DataFrame:
    """One Bloom filter per segment (segments are bounded), as bytes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros(bits, bool)
        field[_positions(pdf["key_str"], bits, hashes).astype(np.int64).ravel()] = True
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "n": [len(pdf)], "filter": [np.packbits(field).tobytes()]})

    return rows.select("segment", "key_str").groupBy("segment").applyInPandas(build, "segment long, n long, filter binary")


def bloom_probe(pairs: DataFrame, bits: int = 8192, hashes: int = 6) -> DataFrame:
    """Of (segment, key_str, filter) rows, those whose filter may hold the key; a null filter may."""

    def test(batches):
        for b in batches:
            at = _positions(b["key_str"], bits, hashes).astype(np.int64)
            keep = [f is None or bool(np.unpackbits(np.frombuffer(f, np.uint8))[p].all()) for f, p in zip(b["filter"], at, strict=True)]
            yield b.loc[keep, ["segment", "key_str"]]

    return pairs.select("segment", "key_str", "filter").mapInPandas(test, "segment long, key_str string")
