import importlib
import sys

import pytest
from pyspark.sql import functions as F

from tidelog.operators import read
from tidelog.sources import device, requests
from tidelog.sources.log import read_log
from tidelog.streaming import replay


def test_segments_on_disk(spark, sf, tmp_path):
    log = read_log(spark, sf).withColumn("segment", F.floor(F.col("seq") / 256))
    path = f"{tmp_path}/level"
    device.append(log, path, codec="lz4")
    key = log.first().key_str
    found = device.lookup(spark, path, key)
    assert "EqualTo(key_str" in found._jdf.queryExecution().toString() and found.count() == log.filter(F.col("key_str") == key).count()
    device.trim(spark, path, [0, 1])
    spark.catalog.clearCache()
    assert spark.read.parquet(path).filter("segment < 2").count() == 0
    root = f"{tmp_path}/pub"
    for v in (1, 2):
        device.publish(spark, log.limit(v), root, v)
    assert device.current(spark, root).count() == 2
    (tmp_path / "pub" / "v3").mkdir()  # a write that is not committed is not seen
    assert device.current(spark, root).count() == 2 and device.versions(spark, root) == [1, 2]
    device.discard(log)


def test_trace_files(spark, sf, tmp_path):
    lines = requests.trace_lines(read_log(spark, sf))
    lines.select("line").write.text(f"{tmp_path}/t")
    assert requests.read_trace(spark, f"{tmp_path}/t").count() == lines.count()
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("banana\n")
    (tmp_path / "d" / "e" / "b.txt").write_text("ananas\nx\n")
    from tidelog.operators.search import substring_total

    assert substring_total(requests.read_directory(spark, f"{tmp_path}/d"), "ana", "value").first().n == 4


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        events.filter(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = replay.log_stream(spark, f"{tmp_path}/in", events.schema)
    q = replay.maintain_state(log, f"{tmp_path}/state", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {(r.inode, r.block): r.seq for r in replay.state(spark, f"{tmp_path}/state").collect()}
    assert got == {(r.inode, r.block): r.seq for r in read.latest_state(read_log(spark, sf)).collect()}


def test_memtables_as_state(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(f"{tmp_path}/in")
    log = replay.log_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{sf}/events.parquet").schema)
    q = replay.memtables(log).writeStream.format("memory").queryName("mem").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.tid: r.n for r in read_log(spark, sf).groupBy("tid").agg(F.count("*").alias("c"), F.count_distinct(F.when(F.col("op") != "GET", F.col("key_str"))).alias("n")).filter("c = 16").collect()}
    assert {r.tid: r.kv_count for r in spark.sql("SELECT * FROM mem").collect()} == want


def test_windows_and_coalescing(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = replay.windowed_ops(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == events.count()
    twice = stream.union(stream).select(F.col("event_id").alias("seq"), F.col("user_id").alias("inode"), F.pmod("event_id", F.lit(64)).alias("block"), "ts")
    q = replay.coalesce_writes(twice).writeStream.format("memory").queryName("dd").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM dd").count() == events.count()


@pytest.mark.parametrize("missing", ["tidelog.llm", "tidelog.llm.queries"])
def test_entry_without_the_pipeline_subpackage(missing, monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == missing else real(name, *a))
    names = entry.queries()
    assert names and not any(n.startswith("op1") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    assert "__spark_entry__" in sys.modules
