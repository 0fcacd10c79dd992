"""Messages of a session out of its ordered items, by windows over the session.

An item is one row of ``ITEM``.  Kinds: ``turn`` (a part of a message of its
own that ends the assistant's group), ``reset`` (ends the group only),
``reasoning``, ``text``, ``plan`` and ``tool`` (the assistant's), ``image``
(a part of its record only), ``result`` (answers the latest call of its id), ``hidden`` (a call that is left out with
its results) and ``fragment`` (more argument text of the open call).

All windows are partitioned by session first, so the items shuffle once; only
answers are joined back to their calls.  A session without items gives no row;
null texts are empty parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = {
    "session": "string", "line": "long", "item": "long", "kind": "string", "role": "string", "text": "string", "tool": "string", "call_id": "string",
    "arguments": "string", "output": "array<string>", "status": "string", "at": "long", "message_id": "string", "model": "string", "usage": "string",
}
TALK = ("reasoning", "text", "plan")


def item(**columns: Column) -> list[Column]:
    """The columns of an item; those not given are null."""
    return [columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ITEM.items()]


def _numbered(items: DataFrame) -> DataFrame:
    """Items with their position in the session and the segment between two resets."""
    order = Window.partitionBy("session").orderBy("line", "item")
    same_turn = (F.lag("kind").over(order) == "turn") & (F.lag("line").over(order) == F.col("line"))
    opens = (F.col("kind") == "reset") | ((F.col("kind") == "turn") & ~F.coalesce(same_turn, F.lit(False)))
    placed = items.withColumns({"pos": F.row_number().over(order).cast("long"), "__opens": opens.cast("int")})
    return placed.withColumn("segment", F.sum("__opens").over(Window.partitionBy("session").orderBy("pos"))).drop("__opens")


def _grouped(rows: DataFrame, sticky: bool) -> DataFrame:
    """The message of each item where the assistant's talk and tools fold into groups.

    Reasoning goes on until text or a tool, text until a tool.  A tool joins
    the latest text of the segment, else it is a message.  After a tool new
    talk opens a message; with ``sticky`` it goes on in a group of reasoning
    that came after the text the tool joined.  After a plan tools stand alone.
    """
    order = Window.partitionBy("session", "segment").orderBy("pos")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda value, frame: F.last(value, ignorenulls=True).over(frame)
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind, p = F.col("kind"), F.col("__p")
    talk = kind.isin(*TALK)
    tail = F.struct("kind", "text", "at")
    rows = rows.withColumns({"__p": F.lag("kind").over(order), "__pp": F.lag("kind", 2).over(order), "__q": latest(F.when(talk, kind), before), "__tail": latest(F.when(talk, tail), before)})
    breaks = (kind == "tool") | ((kind == "reasoning") & yes(p == "text"))
    rows = rows.withColumn("__plan", latest(F.when(kind == "plan", True).when(breaks, False), before))
    rows = rows.withColumn("__lead", F.when((kind == "plan") | ((kind == "text") & yes(F.col("__plan"))), "plan").when(kind == "text", "text"))
    rows = rows.withColumn("__joins", yes(latest(F.col("__lead"), before) == "text"))
    edge = p.isNull() | p.isin("turn", "reset")
    goes_on = F.lit(sticky) & F.col("__joins") & yes(F.col("__q") == "reasoning")
    closed = (kind == "reasoning") & ((p == "text") | ((p == "plan") & yes(F.col("__pp") == "text")))
    start = F.when(kind == "turn", ~yes(p == "turn")).when(kind == "tool", ~F.col("__joins")).when(talk, edge | yes(closed) | (yes(p == "tool") & ~goes_on))
    rows = rows.withColumn("__start", yes(start))
    rows = rows.withColumn("__group", latest(F.when(F.col("__start") & (kind != "tool"), F.col("pos")), so_far))
    rows = rows.withColumn("message", F.when(kind != "tool", F.col("__group")).when(F.col("__start"), F.col("pos")).otherwise(latest(F.when(F.col("__lead") == "text", F.col("__group")), before)))
    repeat = talk & ~F.col("__start") & F.col("__tail").eqNullSafe(tail)
    return rows.filter((kind != "reset") & ~yes(repeat))


def _plain(rows: DataFrame, by_record: bool) -> DataFrame:
    """The message of each item: one for each record, or all of the assistant's between two turns."""
    order = Window.partitionBy("session", "segment").orderBy("pos")
    if by_record:
        start = F.coalesce(F.lag("line").over(order) != F.col("line"), F.lit(True))
    else:
        alike = (F.lag("kind").over(order).isin("turn", "reset")) == F.col("kind").isin("turn", "reset")
        start = ~F.coalesce(alike, F.lit(False))
    rows = rows.withColumn("__start", start)
    return rows.withColumn("message", F.last(F.when(F.col("__start"), F.col("pos")), ignorenulls=True).over(order)).filter("kind <> 'reset'")


def _answers(numbered: DataFrame) -> DataFrame:
    """Results and argument fragments with the position of their call; null for results without one."""
    by_id = Window.partitionBy("session", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = F.coalesce(F.trim("call_id") != "", F.lit(False))
    asked = F.last(F.when(F.col("kind") == "tool", F.col("pos")), ignorenulls=True).over(by_id)
    hidden = F.coalesce(F.max(F.col("kind") == "hidden").over(by_id), F.lit(False))
    results = numbered.filter(F.col("kind").isin("tool", "hidden", "result")).withColumns({"call": F.when(named, asked), "__hidden": named & hidden}).filter("kind = 'result' and not __hidden").drop("__hidden")
    in_segment = Window.partitionBy("session", "segment").orderBy("pos")
    opened = F.last(F.when(F.col("kind").isin("tool", "hidden"), F.struct("pos", "kind")), ignorenulls=True).over(in_segment)
    fragments = numbered.filter(F.col("kind").isin("tool", "hidden", "fragment")).withColumn("__open", opened)
    fragments = fragments.filter("kind = 'fragment' and __open.kind = 'tool'").withColumn("call", F.col("__open.pos")).drop("__open")
    return results.unionByName(fragments)


def assemble(items: DataFrame, grouping: str, answered: str | None = None) -> DataFrame:
    """Messages (session, seq, role, mode, message_id, at, model, usage, parts) of items.

    ``grouping``: ``groups`` or ``sticky`` (see ``_grouped``), ``record`` (a
    message for each record) or ``turn`` (one between two turns).  Outputs of
    a call are in order of arrival, its status the last one given, else
    ``answered`` once there is output.  A result without a call is a message
    of role ``tool``, none where it is empty.
    """
    if grouping not in ("groups", "sticky", "record", "turn"):
        raise ValueError(f"unknown grouping: {grouping}")
    numbered = _numbered(items)
    rows = numbered.filter(F.col("kind").isin(*TALK, "image", "tool", "turn", "reset"))
    rows = _grouped(rows, grouping == "sticky") if grouping in ("groups", "sticky") else _plain(rows, grouping == "record")
    answers = _answers(numbered)
    lone = answers.filter("call is null").select(*items.columns, "pos", F.explode("output").alias("__text"))
    lone = lone.withColumns({"message": F.col("pos"), "kind": F.lit("text"), "role": F.lit("tool"), "text": F.col("__text")}).drop("__text")
    ordered = lambda value: F.array_sort(F.collect_list(value))
    given = answers.filter("call is not null").groupBy("session", "call").agg(
        F.flatten(F.transform(ordered(F.when(F.col("kind") == "result", F.struct("pos", F.coalesce("output", F.array().cast("array<string>")).alias("output")))), lambda x: x["output"])).alias("outputs"),
        F.array_join(F.transform(ordered(F.when(F.col("kind") == "fragment", F.struct("pos", F.coalesce("arguments", F.lit("")).alias("more")))), lambda x: x["more"]), "").alias("__more"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("pos"))).alias("__status"))
    parts = rows.select(*items.columns, "pos", "message").unionByName(lone.select(*items.columns, "pos", "message"))
    parts = parts.join(given.withColumnRenamed("call", "pos"), ["session", "pos"], "left")
    done = F.coalesce(F.col("__status"), F.when(F.size("outputs") > 0, F.lit(answered)), F.col("status"))
    part = F.struct("pos", "kind", "text", "tool", "call_id", F.when(F.col("kind") == "tool", F.concat(F.coalesce("arguments", F.lit("")), F.coalesce("__more", F.lit("")))).alias("arguments"), F.coalesce("outputs", F.when(F.col("kind").isin("plan", "tool"), F.col("output"))).alias("outputs"), done.alias("status"), "at")
    tools = {"record": F.every(F.col("kind") == "tool"), "turn": F.some(F.col("kind") == "tool")}.get(grouping, F.min_by("kind", "pos") == "tool")
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("pos"))).alias(name)
    packed = parts.groupBy("session", "message").agg(
        F.min_by("role", "pos").alias("role"), F.when(tools, "tool").alias("mode"), F.min_by("message_id", "pos").alias("message_id"), F.min_by("at", "pos").alias("at"), first("model"), first("usage"), F.array_sort(F.collect_list(part)).alias("parts"))
    return packed.withColumnRenamed("message", "seq")
