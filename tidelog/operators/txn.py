"""Transactions: which rows a reader sees, and transaction bookkeeping.

A transactions table has one row per tid; visibility is a join of the log with it.  Aborting is an
extension: rows of aborted tids are an anti-join away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.read import latest
from tidelog.schema import VISIBLE_STATES
from tidelog.sources.log import writes


def transactions(log: DataFrame) -> DataFrame:
    """tid, status, key range, number of writes and of requests.  Requests outside transactions (tid null)
    make none."""
    write = F.col("op").isin("SET", "RMW", "DELETE")
    return log.filter(F.col("tid").isNotNull()).groupBy("tid").agg(
        F.min(F.when(write, F.col("key_str"))).alias("range_start"), F.max(F.when(write, F.col("key_str"))).alias("range_end"),
        F.count_if(write).alias("kv_count"), F.count("*").alias("requests"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.bool_and("committed").alias("committed"),
    ).withColumn("status", F.when(F.col("kv_count") == 0, "EMPTY").when(F.col("committed"), "COMMIT").when(F.col("kv_count") >= 8, "LOGGED").otherwise("CACHED"))


def visible(log: DataFrame, isolation: str = "read_committed", tid: int | None = None) -> DataFrame:
    """The latest state that a reader sees.

    read_committed: rows of committed transactions and of the reader's own.
    read_uncommitted: rows of all transactions; a later transaction hides earlier ones, whatever the
    order of their requests."""
    rows = writes(log)
    if isolation == "read_committed":
        return latest(rows.filter(F.col("committed") | (F.lit(False) if tid is None else F.col("tid") == tid)))
    if isolation == "read_uncommitted":
        return latest(rows.withColumn("rank", F.struct("tid", "seq")), version="rank").drop("rank")
    raise ValueError(f"unknown isolation {isolation}")


def cursor_entries(table: DataFrame, key: str) -> DataFrame:
    """Transactions that a cursor at key must merge: visible status, and a range that reaches the key."""
    return table.filter(F.col("status").isin(*VISIBLE_STATES) & (F.col("range_end") >= key))


def holders(table: DataFrame, key: str) -> DataFrame:
    """Transactions whose key range covers key, newest first."""
    return table.filter((F.col("range_start") <= key) & (F.col("range_end") >= key)).orderBy(F.desc("tid"))


def commitable(table: DataFrame) -> DataFrame:
    return table.select("tid", (F.col("kv_count") > 0).alias("commitable"))


def advance(table: DataFrame, commits: DataFrame) -> DataFrame:
    """The table after commits (tid): EMPTY ones go, others wait if cached and commit if logged."""
    to = F.when(F.col("status") == "CACHED", "WAITCOMMIT").when(F.col("status") == "LOGGED", "COMMIT").otherwise(F.col("status"))
    out = table.join(commits.select("tid", F.lit(True).alias("asked")).distinct(), "tid", "left")
    return out.filter(~(F.coalesce("asked", F.lit(False)) & (F.col("status") == "EMPTY"))).withColumn("status", F.when(F.col("asked"), to).otherwise(F.col("status"))).drop("asked")


def abort(log: DataFrame, tids: DataFrame) -> DataFrame:
    return log.join(tids.select("tid"), "tid", "left_anti")


def compaction_target(table: DataFrame) -> DataFrame:
    """The oldest committed transaction."""
    return table.filter(F.col("status") == "COMMIT").orderBy("tid").limit(1)


def vectors(log: DataFrame) -> DataFrame:
    """Each tid's requests as one ordered array, and whether the vector is complete (16 requests)."""
    each = F.struct("seq", "op", "key_str")
    return log.groupBy("tid").agg(F.array_sort(F.collect_list(each)).alias("requests")).withColumn("complete", F.size("requests") == 16)


def buffers(log: DataFrame, limit: int = 16) -> DataFrame:
    """Write buffers that are due: transactions with ``limit`` requests or more, their distinct keys
    written and their last request.  The batch form of streaming.replay.memtables."""
    written = F.when(F.col("op") != "GET", F.col("key_str"))
    each = log.filter(F.col("tid").isNotNull()).groupBy("tid").agg(F.count("*").alias("requests"), F.count_distinct(written).alias("kv_count"), F.max("seq").alias("last_seq"))
    return each.filter(F.col("requests") >= limit)


def adjacent_tids(log: DataFrame) -> DataFrame:
    """Consecutive equal tids of each inode's write queue collapsed to one."""
    before = F.lag("tid").over(Window.partitionBy("inode").orderBy("seq"))
    return writes(log).select("inode", "seq", "tid", before.alias("before")).filter(F.col("before").isNull() | (F.col("before") != F.col("tid"))).select("inode", "seq", "tid")
