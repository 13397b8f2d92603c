"""Lookups and cursors over the latest state of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import GEOMETRY
from tidelog.sources.log import writes

KEY = ("inode", "block")


def latest(log: DataFrame, key: tuple[str, ...] = KEY, version: str = "seq") -> DataFrame:
    """The newest version of every key.  max_by aggregates before the shuffle, so a hot key sends one
    row per task."""
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("v"))
    return newest.select(*key, "v.*").withColumn("is_deleted", F.col("op") == "DELETE")


def latest_state(log: DataFrame) -> DataFrame:
    return latest(writes(log))


def status(found: Column, deleted: Column) -> Column:
    return F.when(~found, "NOTFOUND").when(deleted, "DELETED").otherwise("FOUND")


def point_get(requests: DataFrame, state: DataFrame, key: tuple[str, ...] = KEY, zero_deleted: bool = False) -> DataFrame:
    """Each request with status FOUND, DELETED or NOTFOUND and its value.

    zero_deleted: the older convention, in which a deleted key is found and reads as zeros."""
    hit = state.select(*key, F.lit(True).alias("hit"), "is_deleted", F.col("value").alias("found_value"))
    out = requests.join(hit, list(key), "left")
    found = F.coalesce("hit", F.lit(False))
    deleted = F.coalesce("is_deleted", F.lit(False))
    if zero_deleted:
        return out.select(*requests.columns, F.when(found, "FOUND").otherwise("NOTFOUND").alias("status"), F.when(deleted, 0.0).otherwise(F.col("found_value")).alias("found_value"))
    return out.select(*requests.columns, status(found, deleted).alias("status"), F.when(~deleted, F.col("found_value")).alias("found_value"))


def multi_get(requests: DataFrame, state: DataFrame, length: Column | int = 8) -> DataFrame:
    """For each request (req, inode, block), the values of the next ``length`` blocks; misses are zero."""
    n = F.lit(length) if isinstance(length, int) else length
    wanted = requests.select("req", "inode", F.posexplode(F.sequence(F.col("block"), F.col("block") + n - 1)).alias("pos", "block"))
    live = state.filter(~F.col("is_deleted")).select("inode", "block", F.col("value").alias("v"))
    return wanted.join(live, ["inode", "block"], "left").select("req", "pos", "inode", "block", F.coalesce("v", F.lit(0.0)).alias("value"))


def cursor(state: DataFrame, n: int, start_block: int = 0, inclusive: bool = True, keys_only: bool = False, filter_first: bool = True, cut_values: bool = False, cap: int | None = None) -> DataFrame:
    """One page of each prefix (inode): its first n rows from start_block on, in key order, and
    whether more remain.  filter_first=False counts tombstones towards n before they are dropped.
    cut_values gives the first characters of a payload only, as many as GEOMETRY.scan_value_bytes.
    cap bounds n, as a store of a fixed page does (GEOMETRY.scan_row_cap); none is the default.

    Only n + 1 rows of a prefix can be in its page, so a rank limit lets Spark drop the others before
    the shuffle."""
    n = n if cap is None else min(n, cap)
    at = F.col("block") >= start_block if inclusive else F.col("block") > start_block
    rows = state.filter(at)
    if filter_first:
        rows = rows.filter(~F.col("is_deleted"))
    order = Window.partitionBy("inode").orderBy("block")
    ranked = rows.select("inode", "block", "key_str", "value", "payload", "is_deleted", F.row_number().over(order).alias("pos")).filter(F.col("pos") <= n + 1)
    ranked = ranked.withColumn("has_more", F.max("pos").over(Window.partitionBy("inode")) > n).filter((F.col("pos") <= n) & ~F.col("is_deleted"))
    payload = F.substring("payload", 1, GEOMETRY.scan_value_bytes) if cut_values else F.col("payload")
    page = ranked.select("inode", "pos", "block", "key_str", "value", payload.alias("payload"), "has_more")
    return page.drop("value", "payload") if keys_only else page


def next_page(state: DataFrame, inode: int, after_block: int | None, n: int, with_values: bool = True) -> DataFrame:
    """The next n live rows of a prefix behind the last key seen (None: from the start).  The cursor is
    the key itself, so there is nothing to create, keep or release."""
    rows = state.filter((F.col("inode") == inode) & ~F.col("is_deleted"))
    if after_block is not None:
        rows = rows.filter(F.col("block") > after_block)
    return rows.select("inode", "block", "key_str", *["value"] * with_values).orderBy("block").limit(n)


def ends(rows: DataFrame, by: str = "inode", order: str = "block") -> DataFrame:
    """Each prefix's first row (what a pop takes), its last key, and how many rows stay behind the first."""
    first = F.min_by(F.struct("key_str", "value"), order)
    found = rows.groupBy(by).agg(first.alias("first"), F.max_by("key_str", order).alias("last_key"), (F.count("*") - 1).alias("rest"))
    return found.select(by, F.col("first.key_str").alias("first_key"), F.col("first.value").alias("first_value"), "last_key", "rest")


def still_current(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs (inode, block, seq) that the state still holds."""
    return pairs.join(state.select(*KEY, "seq"), [*KEY, "seq"], "left_semi")


def range_get(state: DataFrame, start_key: str, n: int, inclusive: bool = True, cap: int | None = None) -> DataFrame:
    """The first n live rows (cap at most) from start_key on, within its prefix (the first ten digits)."""
    at = F.col("key_str") >= start_key if inclusive else F.col("key_str") > start_key
    rows = state.filter(at & F.col("key_str").startswith(start_key[:10]) & ~F.col("is_deleted"))
    return rows.orderBy("key_str").limit(n if cap is None else min(n, cap))


def bounds(probes: DataFrame, keys: DataFrame, by: str = "inode", at: str = "block") -> DataFrame:
    """For each probe, the greatest key <= it (floor) and the least key >= it (lower_bound) of its
    prefix: keys and probes in one ordered window, no range join."""
    both = keys.select(by, at, F.col(at).alias("k"), F.lit(None).cast("long").alias("probe")).unionByName(probes.select(by, at, F.lit(None).cast(keys.schema[at].dataType).alias("k"), F.col("probe").cast("long").alias("probe")))
    up = Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(by).orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    first = F.min("k").over(Window.partitionBy(by))
    found = both.select("probe", by, at, F.max("k").over(up).alias("strict_floor"), F.min("k").over(down).alias("lower_bound"), first.alias("first"))
    return found.filter("probe IS NOT NULL").select("probe", by, at, F.coalesce("strict_floor", "first").alias("floor"), "strict_floor", "lower_bound")
