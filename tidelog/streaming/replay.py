"""Structured Streaming replay of a change log: the latest state, memtables per transaction, windows.

Order is by sequence number only; files arrive in order and each micro-batch is merged into the state
by newest-wins, which does not depend on the order within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.read import KEY, latest
from tidelog.sources.device import versions
from tidelog.sources.log import request_log, writes


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The log of an events directory as a stream; files_per_trigger is the back-pressure."""
    return request_log(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


BUCKETS = 64


def _parts(spark: SparkSession, root: str, before: int | None = None) -> dict[int, list[int]]:
    """Committed versions of each bucket (older than ``before``), oldest first."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v*/bucket=*")
    fs, out = pattern.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    done = set(versions(spark, root))
    for f in fs.globStatus(pattern) or []:
        bucket, version = int(f.getPath().getName().split("=")[1]), int(f.getPath().getParent().getName()[1:])
        if version in done and (before is None or version < before):
            out.setdefault(bucket, []).append(version)
    return {b: sorted(v) for b, v in out.items()}


def state(spark: SparkSession, root: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The state under root: the newest version of each bucket (of some of them; older than ``before``)."""
    paths = [f"{root}/v{v[-1]}/bucket={b}" for b, v in sorted(_parts(spark, root, before).items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def maintain_state(log: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest state of all keys under root, in BUCKETS buckets by a hash of the inode (read it
    with ``state``).  A batch writes new versions of the buckets it touches and nothing else; of each it
    leaves the version before, which a replay of the batch reads, and removes older ones.  A replayed batch
    overwrites its own version, so results are exactly-once."""

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = writes(batch)
        bucket = F.pmod(F.xxhash64("inode"), F.lit(BUCKETS)).cast("int")
        touched = {r.b for r in rows.select(bucket.alias("b")).distinct().collect()}  # at most BUCKETS
        if not touched:
            return
        old = state(spark, root, epoch, touched)
        if old is not None:
            rows = rows.unionByName(old.select(*rows.columns))
        new = latest(rows).drop("is_deleted").select(*batch.columns, bucket.alias("bucket"))
        new.repartition("bucket").sortWithinPartitions("bucket", *KEY).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v{epoch}")
        for b, found in _parts(spark, root, epoch).items():
            for v in found[:-1] if b in touched else []:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{v}/bucket={b}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return log.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memtables(log: DataFrame, limit: int = 16) -> DataFrame:
    """Per-transaction memtables as state: a row is emitted when a transaction has ``limit`` requests
    (its vector is complete), with the number of distinct keys it wrote."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, keys = (state.get[0], set(state.get[1])) if state.exists else (0, set())
        for b in batches:
            seen += len(b)
            keys |= set(b.loc[b["op"] != "GET", "key_str"])
        if seen >= limit:
            state.remove()
            yield pd.DataFrame({"tid": [key[0]], "requests": [seen], "kv_count": [len(keys)]})
        else:
            state.update((seen, sorted(keys)))

    return log.groupBy("tid").applyInPandasWithState(step, "tid long, requests long, kv_count long", "seen long, keys array<string>", "append", "NoTimeout")


def coalesce_writes(log: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Drops a queued duplicate of the same write (key and sequence) within the watermark."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([*KEY, "seq"])


def windowed_ops(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Requests per tumbling window of event time (an extension: the store itself has only sequence)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
