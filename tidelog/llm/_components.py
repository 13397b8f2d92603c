"""Connected components by hooking to the smallest neighbour and contracting, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (u, v: longs); comp is a node of the component.

    In each round every node hooks to its smallest neighbour, hooks are followed once more, and the edges
    between different results go on; each round at least halves the nodes that still have edges."""
    edges = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"))
        hook = written(hook, "hooks")
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = written(hook.join(above, "up").select("node", F.col("top").alias("up")), "hooks")
        if labels is None:
            labels = hook.withColumnRenamed("up", "comp")
        else:
            labels = labels.join(hook.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
            labels = written(labels, "labels")
        end = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023,E731
        edges = edges.join(end("u"), "u").join(end("v"), "v").select(F.col("u_up").alias("u"), F.col("v_up").alias("v"))
        edges = written(edges.filter("u <> v").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return labels


def roots(pointers: DataFrame) -> DataFrame:
    """(node, comp) of every node of a forest (node, up: each node once, up smaller than node); comp is
    the root.  Pointers are doubled until none can be."""
    while True:
        above = pointers.select(F.col("node").alias("up"), F.col("up").alias("top"))
        doubled = written(pointers.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "pointers")
        pointers = doubled.select("node", "up")
        if doubled.filter("moved").isEmpty():
            own = pointers.select(F.col("up").alias("node")).distinct().withColumn("up", F.col("node"))
            return pointers.union(own).withColumnRenamed("up", "comp")


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp) after the components that edges (u, v) connect have become one; an end
    without a label is its own."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = edges.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("u_comp", "u").alias("u"), F.coalesce("v_comp", "v").alias("v"))
    moved = components(between)
    if moved.isEmpty():
        return labels
    into = moved.withColumnRenamed("node", "old").withColumnRenamed("comp", "new")
    new = labels.join(into, labels.comp == into.old, "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return written(new.union(moved.join(labels, "node", "left_anti")), "labels")
