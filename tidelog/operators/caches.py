"""Exact cache simulations: sequential by nature, one task per shard of the key space."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simulate_lru(log: DataFrame, capacity: int = 64, shards: int = 16, coarse: int = 1, size: Column | None = None) -> DataFrame:
    """hits, misses, evictions, dirty evictions and the units held at the end of a recency cache for each
    shard of inodes.

    coarse: keys per cached entry (1: entries, more: pages of that many blocks).  size: the units that an
    entry takes (one, unless given; the largest that it ever had counts), so that capacity may be a budget
    of bytes; an entry larger than the cache passes by.  Requests of a shard pass in order through one
    task, which holds no more than the cache; a cluster takes as many shards as it has cores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, cache, count, held = None, OrderedDict(), None, 0

        def given():
            return pd.DataFrame([count | {"held": held}])

        for b in batches:
            for s, inode, entry, write, units in zip(*(b[c].tolist() for c in ("shard", "inode", "entry", "is_write", "units")), strict=True):
                if s != shard:
                    if count:
                        yield given()
                    shard, cache, held, count = s, OrderedDict(), 0, {"shard": s, "hits": 0, "misses": 0, "evictions": 0, "dirty": 0}
                key = (inode, entry)
                if key in cache:
                    count["hits"] += 1
                    was, old = cache.pop(key)
                    write, units, held = write or was, max(units, old), held - old
                else:
                    count["misses"] += 1
                if units > capacity:
                    continue
                cache[key] = write, units
                held += units
                while held > capacity:
                    _, (dirty, gone) = cache.popitem(last=False)
                    held -= gone
                    count["evictions"] += 1
                    count["dirty"] += dirty
        if count:
            yield given()

    units = F.lit(1).cast("long") if size is None else F.coalesce(size.cast("long"), F.lit(0))
    rows = log.select(F.pmod("inode", F.lit(shards)).alias("shard"), "seq", "inode", F.floor(F.col("block") / coarse).alias("entry"), (F.col("op") != "GET").alias("is_write"), units.alias("units"))
    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, "shard long, hits long, misses long, evictions long, dirty long, held long")


def least_recent(log: DataFrame, n: int = 10) -> DataFrame:
    """The n keys whose last request is longest ago."""
    return log.groupBy("inode", "block").agg(F.max("seq").alias("last")).orderBy("last").limit(n)
