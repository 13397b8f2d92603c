"""Segments as Parquet datasets: append-only writes, whole-segment trims, pushed-down lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, segment: str = "segment", codec: str = "snappy") -> None:
    """Adds immutable files, a directory per segment; rows are sorted within files for min/max pruning.
    codec: how pages are compressed (snappy, lz4, zstd, none)."""
    rows.repartition(segment).sortWithinPartitions(segment, "key_str").write.mode("append").option("compression", codec).partitionBy(segment).parquet(path)


def trim(spark: SparkSession, path: str, segments: list[int], segment: str = "segment") -> None:
    """Frees whole segments."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for s in segments:
        p = hadoop(f"{path}/{segment}={s}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lookup(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of one key; the equality reaches the Parquet scan."""
    return spark.read.parquet(path).filter(F.col("key_str") == key)


def publish(spark: SparkSession, rows: DataFrame, root: str, version: int) -> str:
    """Writes a new version of a level beside the old ones.  It becomes current when its files are
    committed (Spark's _SUCCESS mark), so a reader sees the old version or the new one, never none."""
    path = f"{root}/v{version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under root, oldest first."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{versions(spark, root)[-1]}")


def discard(rows: DataFrame) -> None:
    """A sink that counts only: the plan runs, nothing is kept."""
    rows.write.format("noop").mode("overwrite").save()
