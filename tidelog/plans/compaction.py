"""Level maintenance: which move a level needs, partial and full compaction, and level capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.merge import drop_tombstones, merge
from tidelog.operators.read import latest


def edges(upper: DataFrame, lower: DataFrame) -> tuple[tuple, tuple]:
    """Least and greatest key of both, by one job over the key column."""
    both = upper.select(F.lit(0).alias("side"), "key_str").unionByName(lower.select(F.lit(1).alias("side"), "key_str"))
    found = {r.side: (r.lo, r.hi) for r in both.groupBy("side").agg(F.min("key_str").alias("lo"), F.max("key_str").alias("hi")).collect()}
    return found.get(0, (None, None)), found.get(1, (None, None))


def _move(upper: tuple, lower: tuple) -> str:
    if lower[0] is None or upper[0] is None:
        return "empty"
    return "trivial" if upper[1] < lower[0] or lower[1] < upper[0] else "partial"


def decide(upper: DataFrame, lower: DataFrame) -> str:
    """empty (lower has no runs: move all), trivial (ranges are disjoint: move without a merge) or
    partial (merge the overlap)."""
    return _move(*edges(upper, lower))


def level_down(upper: DataFrame, lower: DataFrame, last_level: bool) -> DataFrame:
    """The lower level after the upper one has been merged into it.  Lower rows outside the upper's key
    range pass by without a shuffle.  The edges of both levels are read when this is called."""
    own, below = edges(upper, lower)
    how = _move(own, below)
    rows = lambda df: df.withColumn("is_deleted", F.col("op") == "DELETE")
    if how != "partial":
        return drop_tombstones(rows(upper.unionByName(lower)), last_level)
    inside = F.col("key_str").between(*own)
    merged = merge(upper, lower.filter(inside))
    return drop_tombstones(merged.unionByName(rows(lower.filter(~inside)).select(*merged.columns)), last_level)


def compact_all(levels: list[DataFrame]) -> DataFrame:
    """All levels, newest first, into one without tombstones: one aggregation, however many levels."""
    ranked = [df.withColumn("rank", F.lit(-k)) for k, df in enumerate(levels)]
    rows = ranked[0]
    for df in ranked[1:]:
        rows = rows.unionByName(df)
    return drop_tombstones(latest(rows, version="rank").drop("rank"))


def overfull(summary: DataFrame, first: int, factor: int) -> DataFrame:
    """Levels with more runs than first * factor**level, fullest (by share of capacity) first."""
    cap = F.lit(first) * F.pow(F.lit(factor), F.col("level"))
    return summary.withColumn("capacity", cap.cast("long")).filter(F.col("runs") > F.col("capacity")).orderBy(F.desc(F.col("runs") / F.col("capacity")), "level")


def cascade(levels: list[DataFrame], capacity: list[int]) -> list[DataFrame]:
    """Pushes levels down, from the top, while one holds more rows than its capacity."""
    out = list(levels)
    for k in range(len(out) - 1):
        if out[k].count() > capacity[k]:
            last = k + 1 == len(out) - 1
            out[k + 1] = level_down(out[k], out[k + 1], last).drop("is_deleted")
            out[k] = out[k].limit(0)
    return out
