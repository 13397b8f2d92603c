"""The change log: one row per request, derived from ``events`` or given in the LOG schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import key_text

#: What each event type stands for.
OPS = {"click": "SET", "purchase": "SET", "signup": "RMW", "view": "GET", "error": "DELETE"}
WRITES = ("SET", "RMW", "DELETE")


def request_log(events: DataFrame) -> DataFrame:
    """The log of an ``events`` table.  No shuffle: every column is an expression of its row."""
    op = F.create_map(*(F.lit(x) for pair in OPS.items() for x in pair))[F.col("event_type")]
    seq, block = F.col("event_id"), F.pmod("event_id", F.lit(64))
    tid = F.floor(seq / 16)
    return events.select(
        seq.alias("seq"), tid.alias("tid"), op.alias("op"), F.col("user_id").alias("inode"), block.alias("block"),
        key_text(F.col("user_id"), block).alias("key_str"), "value", F.col("props").alias("payload"), (tid % 5 != 0).alias("committed"),
    )


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def writes(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op").isin(*WRITES))
