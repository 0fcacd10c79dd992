"""Connected components of an edge table, by alternating stars.

Large-star hangs every larger neighbour of a node below the node's smallest
neighbour, small-star does the same for the smaller ones; repeated, every
component becomes a star around its smallest node.  Per node only a minimum is
needed, so hub nodes are handled with salted partial minima
(:func:`tidemark.llm.common.group_best`) and no neighbour list is ever built.
Edges that are few enough (:func:`tidemark.llm.common.is_light`, a fixed number
of rows) meet without an exchange; more are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, group_best, is_light, settle

#: Rounds after which the loop gives up with an error; stars need about log2 of the longest path.
MOST_ROUNDS = 64


def _is_settled(edges: DataFrame, light: bool) -> bool:
    """Whether every node hangs once, and below a node that hangs nowhere.

    One aggregate with partial sums on the map side; a round that would change
    nothing need not be run to find out."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = (ends.coalesce(1) if light else ends).groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.filter("below > 1 or below = 1 and above = 1").agg(F.count(F.lit(1))).first()[0] == 0


def _with_best(rows: DataFrame, key: str, order: str, light: bool) -> DataFrame:
    if light:
        return rows.withColumn("best", F.min(order).over(Window.partitionBy(key)))
    return group_best(rows, key, order, order, once=True)


def _large_star(edges: DataFrame, light: bool) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    best = _with_best(both.coalesce(1) if light else both, "x", "y", light)
    return best.filter("y > x").select(F.col("y").alias("u"), F.least("x", "best").alias("v")).distinct()


def _small_star(edges: DataFrame, light: bool) -> DataFrame:
    best = _with_best(edges, "u", "v", light)
    hung = best.filter("v <> best").select(F.col("v").alias("u"), F.col("best").alias("v"))
    own = edges.groupBy("u").agg(F.min("v").alias("v"))
    both = hung.unionByName(own)
    return (both.coalesce(1) if light else both).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``component`` is the smallest node reachable.  Null ends, loops and repeated
    edges are ignored; an empty table gives an empty table."""
    pairs = edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = settle(pairs, "edges")
    # stars keep or lower the number of edges, so few edges stay few
    light = is_light(now)
    for _ in range(MOST_ROUNDS):
        now = now.coalesce(1) if light else now
        if _is_settled(now, light):
            break
        after = settle(_small_star(_large_star(now, light), light), "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
