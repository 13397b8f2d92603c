"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in shuffled order (by the md5 of the id), offered ``most``
times over.  Documents are served in quanta of at most ``quantum`` words, so that no long document
holds up the other sources.  A quantum's virtual finish time is the number of its source's words up
to its end, divided by the source's target.  All quanta of all sources are range-sorted by virtual
finish time (ties by source and place), their words are summed up in that order, and the order is
truncated where the running total meets the budget; the quantum in service there is taken in part.
What comes before the cut is the mixture, so every source gets its target but for a quantum or so.

Running total: the range sort deals the quanta to ranges, each range's words are summed (one row a
range), and the range that holds the cut follows from these sums.  That range is sorted into ranges
again until it has at most FEW rows, over which a window runs.  The cut itself is one row; a
document's share follows from comparing its quanta with it.

Targets: sources by code point (null last) weigh ``weights``, repeated; together they get ``share``
times all words.  No target exceeds ``most`` times its source's words: the excess is shared again by
weight until none does, which is the level L with sum(min(cap, L * weight)) = budget.  Sorting sources
by cap / weight, L is the largest of the levels that result if all sources before one are capped.

Running sums never gather a source: words are summed by source and two hash digits pairs of the shuffle
key (256 x 256 buckets), the sums are summed up over the buckets in two steps, and a window only runs
within a bucket.

Size: number of [^\\x20\\x09-\\x0D]+ in the text, whatever its length; null and empty texts have size 0
and are never taken.  Rows with one id are neighbours in the queue, by size and text.  An empty table
gives no rows.  Extra columns travel inside the ``row`` struct, so their names never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._scratch import written

WORDS = r"[^\x20\x09-\x0D]+"
#: What the quanta are sorted by.
ORDER = ("finish", "queue", "upto")
#: A range of this many rows is not divided again.
FEW = 4096


def _queued(docs: DataFrame, columns: list[str], doc_id: str, text: str, source: str) -> DataFrame:
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.struct(*(F.col(c) for c in columns)).alias("row"), F.col(source).alias("source"), F.xxhash64(text).alias("tie"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.col(doc_id).alias("id"),
    ).withColumns({"queue": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")), "b1": F.substring("key", 1, 2), "b2": F.substring("key", 3, 2)})


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """totals(source, queue, source_size), a row per source, with each source's target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = totals.withColumn("weight", pick).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_of, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("level", F.max("level").over(all_of))
    return levels.select("queue", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def quanta(copy, quantum: int):
    """Column: the quanta of a document's copy, as structs of ORDER's columns and words."""
    start = F.col("start") + copy * F.col("source_size")

    def one(k):
        words = F.least(F.lit(quantum).cast("long"), F.col("size") - k * quantum)
        upto = start + k * quantum + words
        return F.struct((upto / F.col("target")).alias("finish"), F.col("queue").alias("queue"), upto.alias("upto"), words.alias("words"))

    last = F.ceil(F.col("size") / quantum) - 1
    return F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), one)).otherwise(F.array())


def cut(served: DataFrame, budget: int) -> dict | None:
    """The quantum of served (ORDER's columns, words) in whose service the running total over the global
    order meets the budget: ORDER's columns and ``words``, how many of its words are taken; None if
    there is no such quantum, so that all are taken."""
    n = max(32, int(served.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    running = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row a range
    before, rows = 0, FEW + 1
    while rows > FEW:
        ranged = served.repartitionByRange(n, *ORDER).withColumn("range", F.spark_partition_id())
        ranged = written(ranged, "ranges")  # so that ranges stay what they are, whatever is computed again
        sums = ranged.groupBy("range").agg(F.sum("words").alias("n"), F.count("*").alias("rows")).withColumn("upto", running + before)
        at = sums.filter(F.col("upto") >= budget).orderBy("range").first()
        if at is None:
            return None
        before, rows = at["upto"] - at["n"], at["rows"]
        served = ranged.filter(F.col("range") == at["range"]).drop("range")
    total = F.sum("words").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before
    last = served.withColumn("total", total).filter(F.col("total") >= budget).orderBy("total").first()
    return {c: last[c] for c in ORDER} | {"words": budget - (last["total"] - last["words"])}


def schedule(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, quantum: int = 256) -> DataFrame:
    """One row per document: row (a struct of columns), size, source_size, target and copies, an array of
    (copy, finish, taken): each copy's virtual finish time, and the words that the mix takes of it."""
    queued = _queued(docs, columns, doc_id, text, source)
    sizes = written(queued if text not in columns else queued.drop("row"), "sizes")
    if text not in columns:
        queued = sizes
    bucket = ["queue", "b1", "b2"]
    sums = sizes.groupBy(*bucket).agg(F.sum("size").alias("n"), F.min("source").alias("source"))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.select(*bucket, F.coalesce(F.sum("n").over(upto("queue", "b1", "b2")), F.lit(0)).alias("in_b1"))
    outer = sums.groupBy("queue", "b1").agg(F.sum("n").alias("n")).select("queue", "b1", F.coalesce(F.sum("n").over(upto("queue", "b1")), F.lit(0)).alias("in_queue"))
    totals = sums.groupBy("queue").agg(F.sum("n").alias("source_size"), F.min("source").alias("source"))
    starts = inner.join(outer, ["queue", "b1"]).join(targets(totals, weights, share, most), "queue")
    starts = written(starts.select(*bucket, (F.col("in_queue") + F.col("in_b1")).alias("before"), "source_size", "target"), "starts")
    in_bucket = Window.partitionBy(*bucket).orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda t: t.join(starts, bucket).withColumn("start", F.col("before") + F.sum("size").over(in_bucket) - F.col("size"))
    narrow = written(place(sizes), "placed")
    placed = narrow if queued is sizes else place(queued)

    copies = F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))
    served = narrow.select(F.explode(F.flatten(F.transform(copies, lambda k: quanta(k, quantum)))).alias("q")).select("q.*")
    words = sizes.agg(F.sum("size")).first()[0] or 0
    budget = int(min(share, most) * words)
    last = cut(served, budget) if budget > 0 else None

    if budget <= 0:
        taken_of = lambda q: F.lit(0).cast("long")
    elif last is None:
        taken_of = lambda q: q["words"]
    else:
        edge = F.struct(*(F.lit(last[c]).cast(served.schema[c].dataType).alias(c) for c in ORDER))
        own = lambda q: F.struct(*(q[c].alias(c) for c in ORDER))
        taken_of = lambda q: F.when(own(q) < edge, q["words"]).when(own(q) == edge, F.lit(last["words"])).otherwise(F.lit(0)).cast("long")

    def copy(k):
        finish = F.when(F.col("target") > 0, (F.col("start") + k * F.col("source_size") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
        taken = F.aggregate(F.transform(quanta(k, quantum), taken_of), F.lit(0).cast("long"), lambda total, n: total + n)
        return F.struct(k.alias("copy"), finish.alias("finish"), taken.alias("taken"))

    return placed.select("row", "size", "source_size", "target", F.transform(copies, copy).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, quantum: int = 256, length: str | None = "n_chars") -> DataFrame:
    """The mixture as rows with the columns of docs: each taken copy is a row; of the copy that the
    budget cuts, the first words remain (joined by spaces, and length, if docs has that column, anew)."""
    taken = schedule(docs, docs.columns, doc_id, text, source, weights, share, most, quantum).select("row", "size", F.explode("copies").alias("copy")).filter("copy.taken > 0")
    words = F.filter(F.split(F.col(f"row.`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("copy.taken") == F.col("size"), F.col(f"row.`{text}`")).otherwise(F.array_join(F.slice(words, 1, F.col("copy.taken").cast("int")), " "))
    out = taken.select("row", "size", "copy", cut.alias("cut"))
    partial = F.col("copy.taken") < F.col("size")
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: F.col("cut")}
    if length in docs.columns:
        kept[length] = F.when(partial, F.length("cut").cast(docs.schema[length].dataType)).otherwise(F.col(f"row.`{length}`"))
    return out.select(*(e.alias(c) for c, e in kept.items()))


#: The same digest in DuckDB's SQL.
SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS queue, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM totals),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
started AS (SELECT s.*, source_size, target, (sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT queue, start, least(256, size - 256 * k) AS words, start + copy * source_size + least(size, 256 * (k + 1)) AS upto, target
  FROM started, (VALUES (0), (1)) c(copy), unnest(generate_series(0, (size + 255) // 256 - 1)) t(k)),
run AS (SELECT queue, start, words, sum(words) OVER (ORDER BY upto::DOUBLE / target, queue, upto ROWS UNBOUNDED PRECEDING) AS total FROM q),
t AS (SELECT queue, start, sum(greatest(0, least(words, (SELECT floor(1.5::DOUBLE * sum(size)) FROM sized) - total + words)))::BIGINT AS taken FROM run GROUP BY queue, start)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken FROM started LEFT JOIN t USING (queue, start)
"""
