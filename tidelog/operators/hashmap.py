"""Hash-addressed placement of keys with quadratic probing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashes import probe_address, sha_fold


def hashed(keys: DataFrame, key: str = "key_str") -> DataFrame:
    return keys.withColumn("h", sha_fold(F.col(key)))


def first_probe(keys: DataFrame, slots: int) -> DataFrame:
    """Keys with the address of their first probe and how many keys share it."""
    at = hashed(keys).withColumn("address", probe_address(F.col("h"), F.lit(0).cast("long"), slots))
    return at.withColumn("n", F.count("*").over(Window.partitionBy("address")))


def tables_for(n: int, slots: int, load: float = 0.75, least: int = 16) -> int:
    """The least number of tables, doubled from ``least``, that n keys fill to ``load`` at most."""
    tables = least
    while n > load * tables * (slots - 1):
        tables *= 2
    return tables


def first_come(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(address, probes) of keys inserted one after the other into one table.

    All keys that have no place ask for their next address at once; an address keeps the earliest key
    that asked for it, whenever it asked, and the others go on.  That ends where inserting one by one
    ends, since each key has the first of its addresses that no earlier key holds."""
    owner, probes = np.full(slots, len(h), np.int64), np.zeros(len(h), np.int64)
    address, asking = np.zeros(len(h), np.int64), np.arange(len(h))
    while len(asking):
        if probes[asking].max() >= slots - 1:
            raise ValueError(f"the table has no place for a key of hash {h[asking[np.argmax(probes[asking])]]}")
        c = probes[asking]
        address[asking] = (h[asking] + c + c * c) % (slots - 1) + 1
        before = owner.copy()
        np.minimum.at(owner, address[asking], asking)
        lost = asking[owner[address[asking]] != asking]
        gone = before[(before < len(h)) & (before != owner)]
        asking = np.concatenate([lost, gone])
        probes[asking] += 1
    return address, probes


def place(keys: DataFrame, slots: int, tables: int | None = None) -> DataFrame:
    """(key_str, table, address, probes) after inserting all keys in key order.

    Keys are dealt to ``tables`` tables by 32 bits of their md5, and each table, of at most ``slots`` keys,
    is filled by itself; None takes as many tables as the keys need (tables_for).  Probe addresses repeat
    after slots - 1 probes: a key that has found no place by then raises an error."""
    if tables is None:
        tables = tables_for(keys.count(), slots)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key_str")
        address, probes = first_come(pdf["h"].to_numpy(), slots)
        return pd.DataFrame({"key_str": pdf["key_str"], "table": pdf["table"], "address": address, "probes": probes})

    bits = F.conv(F.substring(F.md5(F.col("key_str").cast("binary")), 1, 8), 16, 10).cast("long")
    dealt = hashed(keys.select("key_str")).withColumn("table", F.pmod(bits, F.lit(tables)))
    return dealt.groupBy("table").applyInPandas(fill, "key_str string, table long, address long, probes long")


def collision_cdf(placed: DataFrame) -> DataFrame:
    """Keys by number of extra probes, with the running share."""
    n = placed.groupBy("probes").agg(F.count("*").alias("n"))
    run = Window.orderBy("probes").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per depth
    return n.select("probes", "n", (F.sum("n").over(run) / F.sum("n").over(Window.partitionBy())).alias("share"))


def load_factor(keys: DataFrame, slots: int, tables: int | None = None) -> DataFrame:
    """Keys placed, tables, and the share of all slots that they fill."""
    if tables is None:
        tables = tables_for(keys.count(), slots)
    return place(keys, slots, tables).agg(F.count("address").alias("filled"), F.lit(tables).cast("long").alias("tables"), (F.count("address") / (slots * tables)).alias("load"))
