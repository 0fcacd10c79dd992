"""Joins of sessions, messages and tool calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import settle


def count_join(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Left rows with the number of right rows of their key; 0 without any."""
    return left.join(right.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest_join(left: DataFrame, right: DataFrame, key: str, value: Column, order: Column, name: str) -> DataFrame:
    """Left rows with the value of their latest right row."""
    return left.join(right.groupBy(key).agg(F.max_by(value, order).alias(name)), key, "left")


def backfill(calls: DataFrame, results: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each result with the latest call of the same key before it: an as-of join by one window over both."""
    side = lambda df, call: df.withColumn("__call", F.lit(call))
    both = side(calls, 1).unionByName(side(results, 0))
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    called = F.last(F.when(F.col("__call") == 1, F.struct(*order)), ignorenulls=True).over(before)
    return both.withColumn("call", called).filter("__call = 0").drop("__call")


def sole_owner(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Keys that own exactly one distinct value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(name)).filter("__n = 1").drop("__n")


def changed(now: DataFrame, known: DataFrame, key: str, signature: str) -> DataFrame:
    """Rows that are new or whose signature differs."""
    old = known.select(F.col(key), F.col(signature).alias("__old"), F.lit(True).alias("__known"))
    return now.join(old, key, "left").filter(F.col("__known").isNull() | ~F.col(signature).eqNullSafe(F.col("__old"))).drop("__old", "__known")


#: Steps after which what was seen is written as one table again.
MERGE_STEPS = 16


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth) for every node that ``edges(parent, child)`` lead to from ``starts(start, node)``, each once at its least depth.

    A frontier is joined with the edges and what was seen is taken off, until
    nothing is new: no depth or row limit, and cycles end by themselves.
    """
    edges = settle(edges.select("parent", "child").filter("parent is not null and child <> parent").distinct(), "edges")
    frontier = settle(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)), "reach")
    seen, depth = [frontier], 0
    while frontier.head(1):
        depth += 1
        known = reduce(DataFrame.unionByName, seen).select("start", "node")
        fresh = frontier.join(edges, F.col("node") == F.col("parent")).select("start", F.col("child").alias("node")).distinct()
        # null starts are one start
        frontier = settle(fresh.alias("f").join(known.alias("k"), F.col("f.node").eqNullSafe(F.col("k.node")) & F.col("f.start").eqNullSafe(F.col("k.start")), "left_anti").withColumn("depth", F.lit(depth)), "reach")
        seen.append(frontier)
        if len(seen) > MERGE_STEPS:
            seen = [settle(reduce(DataFrame.unionByName, seen), "reach")]
    return reduce(DataFrame.unionByName, seen)


def descend(edges: DataFrame, root: Column) -> DataFrame:
    """(node, depth) reachable from the parents that ``root`` selects, each once at its least depth."""
    starts = edges.filter(root).select(F.lit(0).alias("start"), F.col("parent").alias("node"))
    return reach(edges, starts).select("node", "depth")
