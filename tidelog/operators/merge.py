"""Merging sorted runs, cutting them into segments, and pruning segments by their ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.read import KEY, latest
from tidelog.schema import GEOMETRY


def merge(upper: DataFrame, lower: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Newest wins, the upper run before the lower: one aggregation with partial results, no join."""
    both = upper.withColumn("rank", F.lit(1)).unionByName(lower.withColumn("rank", F.lit(0)))
    return latest(both, key, "rank").drop("rank")


def merge_join(upper: DataFrame, lower: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The same as a full outer join, for runs that are already partitioned by key."""
    rest = [c for c in upper.columns if c not in key]
    side = lambda df, n: df.select(*key, F.struct(*rest).alias(n))
    out = side(upper, "u").join(side(lower, "l"), list(key), "full_outer").select(*key, F.coalesce("u", "l").alias("v"))
    return out.select(*key, "v.*").withColumn("is_deleted", F.col("op") == "DELETE")


def invalidated(upper: DataFrame, lower: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Lower rows that the merge replaces."""
    return lower.join(upper.select(*key).distinct(), list(key), "left_semi")


def drop_tombstones(rows: DataFrame, last_level: bool = True) -> DataFrame:
    """Tombstones go only when rows reach the last level."""
    return rows.filter(~F.col("is_deleted")) if last_level else rows


def numbered(rows: DataFrame, group: str = "inode", order: str = "block", width: int = 1024) -> DataFrame:
    """Rows with ``pos``, their 0-based place in the whole table by (group, order); null groups come first.

    No window spans the table or a crowded group: rows are counted by group and ``width`` values of
    order, these counts are summed up within the group, the groups within blocks of ``width`` groups, the
    blocks within blocks of blocks, and a window numbers the rows of one such part of a group."""
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    groups = sizes.withColumn("coarse", F.floor(F.col(group) / width)).withColumn("outer", F.floor(F.col(group) / width**2))
    blocks = groups.groupBy("outer", "coarse").agg(F.sum("n").alias("n"))
    top = blocks.groupBy("outer").agg(F.sum("n").alias("n")).select("outer", before("outer").alias("b3"))
    blocks = blocks.select("outer", "coarse", before("outer", "coarse").alias("b2"))
    blocks = blocks.join(top, blocks["outer"].eqNullSafe(top["outer"])).select(blocks.coarse, (F.col("b2") + F.col("b3")).alias("b2"))
    groups = groups.select(group, "coarse", before("coarse", group).alias("b1"))
    groups = groups.join(blocks, groups["coarse"].eqNullSafe(blocks["coarse"])).select(F.col(group).alias("__group"), (F.col("b1") + F.col("b2")).alias("__start"))
    placed = numbered_within(rows, group, order, width)
    return placed.join(groups, placed[group].eqNullSafe(groups["__group"])).withColumn("pos", F.col("pos") + F.col("__start")).drop("__group", "__start")


def numbered_within(rows: DataFrame, group: str, order: str, width: int = 1024, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``pos``, their 0-based place in their group by order (a number) and ties.

    Rows are counted by group and stretches of ``width`` values of order, the counts are summed up within
    the group, and a window numbers the rows of one stretch, so a crowded group is many tasks."""
    part = F.floor(F.col(order) / width)
    counts = rows.groupBy(F.col(group).alias("__g"), part.alias("__p")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__g", "__p", F.coalesce(upto, F.lit(0)).alias("__before"))
    own = rows.withColumn("__part", part)
    at = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order, *ties)) - 1
    placed = own.join(starts, own[group].eqNullSafe(starts["__g"]) & own["__part"].eqNullSafe(starts["__p"]))
    return placed.withColumn("pos", F.col("__before") + at).drop("__part", "__g", "__p", "__before")


def segments(rows: DataFrame, size: int = GEOMETRY.segment_rows) -> DataFrame:
    """Sorted rows cut into segments of ``size`` rows: rows with their segment."""
    return numbered(rows).withColumn("segment", F.floor(F.col("pos") / size))


def segment_ranges(cut: DataFrame) -> DataFrame:
    return cut.groupBy("segment").agg(F.min("key_str").alias("min_key"), F.max("key_str").alias("max_key"), F.count("*").alias("n"))


def segments_by_bytes(rows: DataFrame, key_bytes: int = 20, entry_bytes: int = 4, limit: int = GEOMETRY.segment_key_bytes) -> DataFrame:
    """The other cut: as many rows as their key bytes fill."""
    return numbered(rows).withColumn("segment", F.floor(F.col("pos") * (key_bytes + entry_bytes) / limit))


def runs(items: DataFrame, level: str, run: str, key: str) -> DataFrame:
    """Run metadata of sorted runs: level, run_id, min_key, max_key, n."""
    return items.groupBy(F.col(level).alias("level"), F.col(run).alias("run_id")).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n"))


def overlaps(upper: DataFrame, lower: DataFrame, bucket: int) -> DataFrame:
    """Pairs of runs whose key ranges meet, as (upper_run, lower_run).

    A range join without a cross product: both sides are exploded into buckets of the key space and
    joined on the bucket; a pair counts in the bucket where the later of the two begins."""
    cover = lambda df, n: df.select(F.col("run_id").alias(f"{n}_run"), F.col("min_key").alias(f"{n}_min"), F.col("max_key").alias(f"{n}_max"), F.explode(F.sequence(F.floor(F.col("min_key") / bucket), F.floor(F.col("max_key") / bucket))).alias("bucket"))
    pairs = cover(upper, "upper").join(cover(lower, "lower"), "bucket").filter("upper_min <= lower_max AND lower_min <= upper_max")
    return pairs.filter(F.col("bucket") == F.floor(F.greatest("upper_min", "lower_min") / bucket)).select("upper_run", "lower_run")


def covering_runs(probes: DataFrame, run_table: DataFrame, bucket: int) -> DataFrame:
    """(probe, level, run_id) of all runs whose range holds the probe's key."""
    cover = run_table.select("level", "run_id", "min_key", "max_key", F.explode(F.sequence(F.floor(F.col("min_key") / bucket), F.floor(F.col("max_key") / bucket))).alias("bucket"))
    at = probes.withColumn("bucket", F.floor(F.col("key") / bucket))
    return at.join(cover, "bucket").filter("key BETWEEN min_key AND max_key").select("probe", "key", "level", "run_id")


def is_ordered(ranges: DataFrame) -> DataFrame:
    """Segments that overlap their predecessor (none, if the order holds); predecessors by number."""
    before = ranges.select((F.col("segment") + 1).alias("segment"), F.col("max_key").alias("before"))
    return ranges.join(before, "segment").filter("before >= min_key").select("segment", "min_key", "before")


def nth(rows: DataFrame, n: int) -> DataFrame:
    """The row at place n (from 0) of the sorted run."""
    return numbered(rows).filter(F.col("pos") == n)


def split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to and with key, and the rows behind it."""
    return rows.filter(F.col("key_str") <= key), rows.filter(F.col("key_str") > key)


def concatenate(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Both, if their key ranges are disjoint (a move without a merge); an error otherwise."""
    edge = lambda df: df.agg(F.min("key_str").alias("lo"), F.max("key_str").alias("hi")).first()
    a, b = edge(upper), edge(lower)
    if None not in (a.lo, b.lo) and a.lo <= b.hi and b.lo <= a.hi:
        raise ValueError("key ranges overlap; merge them")
    return upper.unionByName(lower)


def union_unique(a: DataFrame, b: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The union of maps; a key that both have raises an error when the result is computed."""
    both = a.unionByName(b)
    n = F.count("*").over(Window.partitionBy(*key))
    return both.withColumn("n", n).filter(F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate key")).cast("boolean")).otherwise(F.lit(True))).drop("n")


def fill_missing(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """new's values where they are set, old's otherwise."""
    return new.select(key, F.col(value).alias("new")).join(old.select(key, F.col(value).alias("old")), key, "full_outer").select(key, F.coalesce("new", "old").alias(value))
