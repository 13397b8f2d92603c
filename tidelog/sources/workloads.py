"""Seeded workload generators: table functions over spark.range.

Randomness is a hash of seed and row number, so a workload is the same on any cluster, however it is
partitioned, and another SQL engine can generate it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import padded
from tidelog.schema import GEOMETRY

KEY_BYTES = 20


def draw(seed: int, i: Column, below: int) -> Column:
    """A number from 0 to below - 1, by 32 bits of an md5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(below))


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def _out(rows: DataFrame, op: Column, k: Column) -> DataFrame:
    return rows.select("i", op.alias("op"), k.cast("long").alias("k"), padded(k, KEY_BYTES).alias("key_str"))


def sequential(spark: SparkSession, n: int, start: int, end: int, op: str = "SET") -> DataFrame:
    return _out(_rows(spark, n), F.lit(op), start + F.pmod("i", F.lit(end - start)))


def sequential_rw(spark: SparkSession, n: int, start: int, end: int) -> DataFrame:
    """The first half sets keys in order, the second half gets the same keys."""
    half = n // 2
    return _out(_rows(spark, 2 * half), F.when(F.col("i") < half, "SET").otherwise("GET"), start + F.pmod(F.pmod("i", F.lit(half)), F.lit(end - start)))


def uniform(spark: SparkSession, n: int, start: int, end: int, op: str = "SET", seed: int = 1) -> DataFrame:
    return _out(_rows(spark, n), F.lit(op), start + draw(seed, F.col("i"), end - start))


def uniform_rw(spark: SparkSession, n: int, start: int, end: int, seed: int = 1) -> DataFrame:
    half = n // 2
    return _out(_rows(spark, 2 * half), F.when(F.col("i") < half, "SET").otherwise("GET"), start + draw(seed, F.pmod("i", F.lit(half)), end - start))


def mixed(spark: SparkSession, n: int, start: int, end: int, percent: int = 50, seed: int = 1) -> DataFrame:
    """SET with a probability of percent / 100, else GET."""
    return _out(_rows(spark, n), F.when(draw(seed + 1, F.col("i"), 100) < percent, "SET").otherwise("GET"), start + draw(seed, F.col("i"), end - start))


def permutation(spark: SparkSession, start: int, end: int, seed: int = 1) -> DataFrame:
    """Each key once, in random order: the order is a global sort by a hash of the key."""
    return _out(_rows(spark, end - start), F.lit("SET"), start + F.col("i")).orderBy(draw(seed, F.col("i"), 1 << 32), "i")


def locality(spark: SparkSession, n: int, start: int, end: int, hot_percent: int = 90, hot_range: float = 0.1, op: str = "GET", seed: int = 1, shift: int = 0) -> DataFrame:
    """hot_percent of the requests go to the first hot_range of the keys (moved by shift)."""
    span = end - start
    hot = draw(seed + 1, F.col("i"), 100) < hot_percent
    k = F.when(hot, draw(seed, F.col("i"), max(1, int(span * hot_range)))).otherwise(draw(seed, F.col("i"), span))
    return _out(_rows(spark, n), F.lit(op), start + F.pmod(k + shift, F.lit(span)))


def latency(spark: SparkSession, n: int, start: int, end: int, percent: int = 50, seed: int = 1) -> DataFrame:
    """A mix whose reads ask only for keys that the workload has written by then."""
    rows = mixed(spark, n, start, end, percent, seed)
    first = rows.filter("op = 'SET'").groupBy("k").agg(F.min("i").alias("written"))
    return rows.join(first, "k", "left").filter((F.col("op") == "SET") | (F.col("written") < F.col("i"))).select("i", "op", "k", "key_str")


def command(spark: SparkSession, op: str, tid: int, k: int) -> DataFrame:
    """One request as a row that can be appended to a workload."""
    return spark.range(1).select(F.lit(tid).cast("long").alias("tid"), F.lit(op).alias("op"), F.lit(k).cast("long").alias("k"), padded(F.lit(k), KEY_BYTES).alias("key_str"))


def commands(rows: DataFrame) -> DataFrame:
    """Requests grouped into command buffers."""
    per = (GEOMETRY.command_bytes - 8) // (6 + KEY_BYTES)
    return rows.withColumn("command", F.floor(F.col("i") / per)).withColumn("pos", F.pmod("i", F.lit(per)))


def transactions(rows: DataFrame, size: int = 1, term: int = 2) -> DataFrame:
    """Framing: commands of a transaction share a tid; a BEGIN and a COMMIT row for each tid; term tids
    commit together."""
    framed = commands(rows).withColumn("tid", F.floor(F.col("command") / size)).withColumn("term", F.floor(F.col("tid") / term))
    tids = framed.select("tid", "term").distinct()
    mark = lambda op, pos: tids.select("tid", "term", F.lit(op).alias("op"), F.lit(None).cast("string").alias("key_str"), F.lit(pos).cast("long").alias("i"))
    return framed.select("tid", "term", "op", "key_str", "i").unionByName(mark("BEGIN", -1)).unionByName(mark("COMMIT", 1 << 62))


def payload(key: Column, version: Column) -> Column:
    """A value that can be computed again to verify a read."""
    return F.sha2(F.concat_ws("-", key, version.cast("string")).cast("binary"), 256)


def verify(reads: DataFrame) -> DataFrame:
    """Reads (key_str, version, value) whose value is not what was written."""
    return reads.filter(~F.col("value").eqNullSafe(payload(F.col("key_str"), F.col("version"))))


def rate_stream(spark: SparkSession, start: int, end: int, op: str = "SET", seed: int = 1, per_second: int = 1000) -> DataFrame:
    """The uniform workload as an endless stream."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().withColumnRenamed("value", "i")
    return _out(rows, F.lit(op), start + draw(seed, F.col("i"), end - start))
