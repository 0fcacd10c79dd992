"""What subagents said, put together from the innermost outwards.

A subagent's answer is what its assistant said in order of time, with the
answers of the subagents it called standing at the time of their last text.
Every answer is made once, a level of calls at a time, and joined into those
that wait for it.  Only calls that lead in a circle depend on where a session
enters it: they are followed for each session in order of its calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relations import reach
from tidemark.operators.scratch import settle

KEY = ["root", "node"]


def followed(calls: pa.Table) -> pa.Table:
    """The calls (root, node, row, child) of one session that are followed, from those of its own (without a node) on.

    A call to a subagent that is still being followed leads back and is left
    out; one that was followed before is not followed again."""
    below: dict[str | None, list[tuple[int, str]]] = {}
    for node, row, child in zip(*(calls.column(c).to_pylist() for c in ("node", "row", "child")), strict=True):
        below.setdefault(node, []).append((row, child))
    for each in below.values():
        each.sort()
    inside: set[str] = set()
    done: set[str] = set()
    kept: list[tuple[str, int, str]] = []

    def rest(node: str) -> Iterator[tuple[int, str]]:
        inside.add(node)
        return iter(below.get(node, ()))

    for _, start in below.get(None, ()):
        path = [] if start in done else [(start, rest(start))]
        while path:
            node, coming = path[-1]
            for row, child in coming:
                if child in inside:
                    continue
                kept.append((node, row, child))
                if child not in done:
                    path.append((child, rest(child)))
                    break
            else:
                path.pop()
                inside.remove(node)
                done.add(node)
    root = calls.column("root")[0].as_py()
    return pa.table({"root": pa.array([root] * len(kept), pa.string()), "node": pa.array([x[0] for x in kept], pa.string()), "row": pa.array([x[1] for x in kept], pa.int64()), "child": pa.array([x[2] for x in kept], pa.string())})


def _nested(calls: DataFrame, done: DataFrame) -> DataFrame:
    """Answers as items of those who asked for them."""
    found = done.filter(F.size("said") > 0).select("root", F.col("node").alias("child"), "at", "model", "said")
    return calls.join(found, ["root", "child"]).select(*KEY, "at", "row", F.lit(2).alias("place"), "model", "said")


def _made(ready: DataFrame, items: DataFrame) -> DataFrame:
    """One answer for each node of ``ready``; its model is its own, else the first of its items'."""
    item = F.when(F.col("at").isNotNull(), F.struct("at", "row", "place", "model", "said"))
    packed = ready.join(items, KEY, "left").groupBy(*KEY, "own").agg(F.array_sort(F.collect_list(item)).alias("v"))
    first = F.get(F.filter(F.transform("v", lambda x: x["model"]), lambda m: m.isNotNull()), 0)
    rows = packed.select(*KEY, F.flatten(F.transform("v", lambda x: x["said"])).alias("said"), F.coalesce("own", first).alias("model"))
    return rows.withColumn("at", F.coalesce(F.array_max(F.transform("said", lambda p: p["at"])), F.lit(0)))


def answers(nodes: DataFrame, items: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, node, said, model, at) of the ``nodes(root, node, own)`` whose calls all end, and the nodes that are left.

    ``items`` (root, node, at, row, place, model, said) are what a node said
    itself.  As many steps as calls are nested; each reads the answers so far."""
    left, done = nodes, None
    while True:
        open_ = calls if done is None else calls.join(done.select("root", F.col("node").alias("child")), ["root", "child"], "left_anti")
        ready = left.join(open_.select(*KEY).distinct(), KEY, "left_anti")
        more = items if done is None else items.unionByName(_nested(calls, done))
        fresh = settle(_made(ready, more), "answers")
        if done is not None and not fresh.head(1):
            return done, left
        done = fresh if done is None else done.unionByName(fresh)
        left = settle(left.join(fresh.select(*KEY), KEY, "left_anti"), "waiting")
        if not left.head(1):
            return done, left


def completions(messages: DataFrame, calls: DataFrame, composers: DataFrame) -> DataFrame:
    """(session, row, child, kind, said, model, at): the answer to each call that has one.

    ``messages`` (session, at, home, place, model, said), ``calls`` (session,
    row, child), ``composers`` (session, own, kind): subagents that are not among
    these answer nothing.  A session is no subagent of itself: a call that leads
    back to it is followed once more."""
    known = composers.select(F.col("session").alias("child"), "own", "kind")
    asked = settle(calls.join(known, "child"), "calls")
    if not asked.head(1):
        none = F.lit(None)
        return messages.limit(0).select("session", F.col("home").alias("row"), none.cast("string").alias("child"), none.cast("string").alias("kind"), "said", "model", "at")
    shared = F.lit("").alias("root")
    nodes = settle(asked.select(shared, F.col("child").alias("node"), "own").distinct(), "nodes")
    items = settle(messages.select(F.col("session").alias("node"), "at", F.col("home").alias("row"), "place", "model", "said").join(nodes.drop("own"), "node"), "items")
    inner = asked.select(F.col("session").alias("node"), "row", "child").join(nodes.drop("own"), "node")
    done, left = answers(nodes, items, inner)
    given = done.drop("root").withColumnRenamed("node", "child")
    found = asked.drop("own").join(given, "child").select("session", "row", "child", "kind", "said", "model", "at")
    if not left.head(1):
        return found.filter(F.size("said") > 0)

    circles = settle(left.select("node"), "circles")
    ring = settle(inner.join(circles, "node").join(circles.withColumnRenamed("node", "child"), "child").select("node", "row", "child"), "ring")
    starts = asked.join(circles.withColumnRenamed("node", "child"), "child").select(F.col("session").alias("root"), F.lit(None).cast("string").alias("node"), "row", "child")
    entered = settle(reach(ring.select(F.col("node").alias("parent"), "child"), starts.select(F.col("root").alias("start"), F.col("child").alias("node"))).select(F.col("start").alias("root"), "node"), "entered")
    each = starts.unionByName(entered.join(ring, "node").select("root", "node", "row", "child"))
    kept = settle(each.groupBy("root").applyInArrow(followed, "root string, node string, row long, child string"), "followed")
    outside = _nested(inner.join(circles, "node", "left_semi"), done).drop("root")
    again = items.drop("root").join(circles, "node", "left_semi").unionByName(outside).join(entered, "node")
    told, _ = answers(entered.join(left.drop("root"), "node").select(*KEY, "own"), again, kept)
    back = asked.drop("own").join(told.select(F.col("root").alias("session"), F.col("node").alias("child"), "said", "model", "at"), ["session", "child"])
    return found.unionByName(back.select(*found.columns)).filter(F.size("said") > 0)
