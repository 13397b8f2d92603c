"""Changes as log rows: upserts, tombstones, range deletes and byte-level read-modify-write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import key_text
from tidelog.schema import GEOMETRY


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def tombstones(keys: DataFrame, seq: Column, tid: Column | None = None, committed: Column | None = None) -> DataFrame:
    """A tombstone row for each key (inode, block).

    tid and committed: the transaction that deletes.  Without them the keys' own columns of these names
    count, if there are any; else the delete stands outside transactions (tid null) and is committed."""
    if tid is None:
        tid = F.col("tid") if "tid" in keys.columns else F.lit(None).cast("long")
    if committed is None:
        committed = F.col("committed") if "committed" in keys.columns else F.lit(True)
    return keys.select(seq.alias("seq"), tid.alias("tid"), F.lit("DELETE").alias("op"), "inode", "block", key_text(F.col("inode"), F.col("block")).alias("key_str"), committed.alias("committed"))


def delete(log: DataFrame, keys: DataFrame, seq: Column, tid: Column | None = None, committed: Column | None = None) -> DataFrame:
    """The log with a tombstone for each key (see tombstones)."""
    return append(log, tombstones(keys, seq, tid, committed))


def range_tombstones(deletes: DataFrame) -> DataFrame:
    """One tombstone per key of range deletes (seq, inode, block, n, and tid and committed if the deletes
    have them): n consecutive blocks."""
    each = F.explode(F.sequence(F.col("block"), F.col("block") + F.col("n") - 1))
    wanted = deletes.filter("n > 0").withColumn("block", each)
    return tombstones(wanted, F.col("seq"))


def overlay(value: Column, patch: Column, offset: Column, length: Column) -> Column:
    """value with ``length`` characters or bytes from ``offset`` (0-based) on replaced by the patch."""
    return F.overlay(value, patch, offset + 1, length)


def read_modify_write(patches: DataFrame, state: DataFrame, size: int = 64) -> DataFrame:
    """New values of patches (seq, inode, block, offset, patch): the live value, blank where there is
    none, with the patch laid over it."""
    live = state.filter(~F.col("is_deleted")).select("inode", "block", F.col("payload").alias("old"))
    base = F.rpad(F.coalesce("old", F.lit("")), F.greatest(F.lit(size), F.length(F.coalesce("old", F.lit("")))), " ")
    return patches.join(live, ["inode", "block"], "left").select("seq", "inode", "block", overlay(base, F.col("patch"), F.col("offset"), F.length("patch")).alias("payload"))


def pieces(length: Column) -> Column:
    """Value length in whole pieces."""
    return F.ceil(length / GEOMETRY.piece_bytes)
