"""Reports: latency, throughput, amplification, levels, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.sizing import bloom_bits
from tidelog.operators.read import KEY
from tidelog.sources.log import WRITES


def latencies(log: DataFrame) -> DataFrame:
    """A latency in microseconds per request; value stands for milliseconds in synthetic logs."""
    return log.select("op", "tid", "seq", F.floor(F.abs("value") * 1000).alias("us"))


def histogram(samples: DataFrame, width_us: int = 1000) -> DataFrame:
    """Ten buckets of width_us, then up to a second, then the rest."""
    bucket = F.when(F.col("us") >= 1_000_000, 11).when(F.col("us") >= 10 * width_us, 10).otherwise(F.floor(F.col("us") / width_us))
    return samples.groupBy("op", bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def cdf(samples: DataFrame, slot_us: int = 10) -> DataFrame:
    """Non-empty slots of slot_us with the running share.  Slots are summed first, so the window sees
    the distinct slots of an operation, not its samples."""
    slots = samples.groupBy("op", F.floor(F.col("us") / slot_us).alias("slot")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("op").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = Window.partitionBy("op")
    return slots.select("op", "slot", "n", F.sum("n").over(run).alias("running"), (F.sum("n").over(run) / F.sum("n").over(all_of)).alias("share"))


def op_type_stats(samples: DataFrame) -> DataFrame:
    """Count, least, greatest and mean latency of each operation, and its share of all requests."""
    each = samples.groupBy("op").agg(F.count("*").alias("n"), F.min("us").alias("min_us"), F.max("us").alias("max_us"), F.sum("us").alias("sum_us"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per operation
    return each.select("op", "n", "min_us", "max_us", (F.col("sum_us") / F.col("n")).alias("avg_us"), (100 * F.col("n") / total).alias("percent"))


def throughput(log: DataFrame, state_hits: DataFrame) -> DataFrame:
    """One row: requests, bytes written, rates over the logged time, success ratio of GETs."""
    names = ("requests", "n_writes", "write_bytes", "total_us", "gets", "hits")
    zero = lambda *cs: [F.lit(0).cast("long").alias(c) for c in cs]
    asked = log.select(F.lit(1).cast("long").alias("requests"), F.col("op").isin(*WRITES).cast("long").alias("n_writes"), F.when(F.col("op").isin("SET", "RMW"), F.octet_length("payload").cast("long")).alias("write_bytes"), F.floor(F.abs("value") * 1000).alias("total_us"), *zero("gets", "hits"))
    found = state_hits.select(*zero("requests", "n_writes", "write_bytes", "total_us"), F.lit(1).cast("long").alias("gets"), (F.col("status") == "FOUND").cast("long").alias("hits"))
    t = asked.unionByName(found).agg(*(F.sum(c).alias(c) for c in names))
    return t.select("requests", "n_writes", "write_bytes", "gets", "hits", (F.col("requests") * 1e6 / F.col("total_us")).alias("iops"), (F.col("write_bytes") * 1e6 / F.col("total_us") / 1024).alias("kb_s"), (F.col("hits") / F.col("gets")).alias("success_ratio"))


def maintenance(upper: DataFrame, lower: DataFrame, placed: DataFrame, victim: DataFrame) -> DataFrame:
    """One row: rows that the merge of two runs into the last level reads (merged_in), writes (merged_out),
    replaces and drops as tombstones, and how many victims collection takes, what it frees and relocates."""
    zero = lambda c: F.lit(0).cast("long").alias(c)
    names = ("merged_in", "merged_out", "replaced", "tombstones_dropped", "victims", "freed", "relocated")
    one = lambda df, **found: df.agg(*(found[c].cast("long").alias(c) if c in found else zero(c) for c in names))
    both = upper.select(*KEY, "op", F.lit(1).alias("rank")).unionByName(lower.select(*KEY, "op", F.lit(0).alias("rank")))
    keys = both.groupBy(*KEY).agg(F.count("*").alias("n"), F.max_by("op", "rank").alias("op"))
    deleted = F.col("op") == "DELETE"
    merged = one(keys, merged_in=F.coalesce(F.sum("n"), F.lit(0)), merged_out=F.count_if(~deleted), replaced=F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), tombstones_dropped=F.count_if(deleted))
    taken = one(victim, victims=F.count("*"), freed=F.coalesce(F.sum("invalid"), F.lit(0)), relocated=F.coalesce(F.sum("valid"), F.lit(0)))
    return merged.unionByName(taken).agg(*(F.sum(c).alias(c) for c in names))


def amplification(log: DataFrame, work: DataFrame) -> DataFrame:
    """Write and read amplification, from what the user asked for and what maintenance moved (a row as of
    ``maintenance``): the device writes user rows, merged rows and relocated rows; it reads for reads and
    read-modify-writes, for merges and for relocation."""
    names = ("user_writes", "user_reads", "device_writes", "device_reads")
    w, r, rmw = F.count_if(F.col("op").isin(*WRITES)), F.count_if(F.col("op") == "GET"), F.count_if(F.col("op") == "RMW")
    asked = log.agg(w.alias("user_writes"), r.alias("user_reads"), w.alias("device_writes"), (r + rmw).alias("device_reads"))
    zero = F.lit(0).cast("long")
    moved = work.select(zero.alias("user_writes"), zero.alias("user_reads"), (F.col("merged_out") + F.col("relocated")).alias("device_writes"), (F.col("merged_in") + F.col("relocated")).alias("device_reads"))
    total = asked.unionByName(moved).agg(*(F.sum(c).alias(c) for c in names))
    return total.withColumn("waf", F.col("device_writes") / F.col("user_writes")).withColumn("raf", F.col("device_reads") / F.col("user_reads"))


def monitor(log: DataFrame, work: DataFrame) -> DataFrame:
    """Counters by name: requests and microseconds of each operation, and rows that maintenance moved."""
    asked = latencies(log).groupBy(F.col("op").alias("name")).agg(F.count("*").alias("n"), F.sum("us").alias("us"))
    names = ("merged_in", "merged_out", "relocated", "freed")
    moved = work.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names))).alias("c")).select("c.name", "c.n", F.lit(None).cast("long").alias("us"))
    return asked.unionByName(moved)


def tree_shape(rows: DataFrame, by: str = "inode") -> DataFrame:
    """Keys of each prefix and the height of a balanced tree over them."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("height", F.ceil(F.log2(F.col("n") + 1)))


def traffic(log: DataFrame) -> DataFrame:
    """Requests of each level (inode mod 4) by operation, a column each."""
    count = lambda op: F.count_if(F.col("op") == op).alias(f"n_{op.lower()}")
    return log.groupBy(F.pmod("inode", F.lit(4)).alias("level")).agg(*(count(op) for op in ("SET", "GET", "RMW", "DELETE")))


def level_summary(run_table: DataFrame) -> DataFrame:
    return run_table.groupBy("level").agg(F.count("*").alias("runs"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("n").alias("entries"), F.sum(F.col("n") * 24).alias("bytes"))


def level_memory(run_table: DataFrame, rate: float, run_entry_bytes: int = 64) -> DataFrame:
    """Bytes of run entries and filters (at a false-positive rate) of each level, and of 'all' of them."""
    bits = bloom_bits(F.col("n"), rate).cast("long")
    each = run_table.groupBy("level").agg(F.count("*").alias("runs"), F.sum("n").alias("entries"), (F.count("*") * run_entry_bytes).alias("run_bytes"), F.sum(F.floor((bits + 7) / 8)).alias("filter_bytes"))
    each = each.withColumn("bytes", F.col("run_bytes") + F.col("filter_bytes"))
    sums = each.rollup("level").agg(*(F.sum(c).alias(c) for c in ("runs", "entries", "run_bytes", "filter_bytes", "bytes")))
    return sums.withColumn("level", F.coalesce(F.col("level").cast("string"), F.lit("all")))


def cache_hits(log: DataFrame) -> DataFrame:
    """GETs of a key whose previous request came within 256 requests: hits of a recency cache."""
    before = F.lag("seq").over(Window.partitionBy("inode", "block").orderBy("seq"))
    gets = log.select("op", "inode", (F.col("seq") - before).alias("gap")).filter("op = 'GET'")
    return gets.groupBy("inode").agg(F.count("*").alias("gets"), F.count_if(F.col("gap") <= 256).alias("hits"))


def average_value_length(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op").isin("SET", "RMW")).groupBy("inode").agg(F.avg(F.length("payload")).alias("avg_length"))
