"""Summaries joined level by level, with a merge from outside where a node grows large.

A level is one table: neighbours in order meet in groups, a group's items are
put together in order, and the table is written before the next level begins.
Nodes with many items go to a callable once each; its answers are files beside
the level, so a task that runs again reads them and asks only for what is missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.collect import GROUP, PM_FIELDS, _tidy, summary
from tidemark.operators.scratch import place, settle

#: A node with more items than this goes to the callable (a fixed value).
LARGE = 48

Merge = Callable[[list[dict[str, list[str]]]], str]


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their number ``n`` in the order, from 0; no task sees more than a range of them."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    spread = settle(spread, "ranged").withColumn("__part", F.shiftright("__id", 33))
    parts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("held"))
    # one row a task of the step before
    base = parts.select("__part", F.coalesce(F.sum("held").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return spread.join(F.broadcast(base), "__part").withColumn("n", F.col("base") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__id", "base")


def _size(fields: tuple[str, ...]) -> Column:
    return sum((F.size(name) for name in fields), F.lit(0))


def _asked(nodes: DataFrame, merge: Merge, fields: tuple[str, ...], folder: str) -> DataFrame:
    """(n, payload): what ``merge`` makes of each node's summaries; null where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for n, told in zip(batch["n"], batch["told"], strict=True):
                at = f"{base}/{n}.json"
                if fs.get_file_info(at).type == pafs.FileType.File:
                    with fs.open_input_stream(at) as source:
                        said = json.loads(source.read())
                else:
                    try:
                        said = merge(json.loads(told))
                    except (ValueError, OSError, RuntimeError):
                        said = None
                    # whole or not at all: a stopped task leaves no half answer
                    with fs.open_output_stream(f"{at}.new") as out:
                        out.write(json.dumps(said).encode())
                    fs.move(f"{at}.new", at)
                yield pd.DataFrame({"n": [n], "payload": [said]})

    told = F.to_json(F.transform("of", lambda x: F.struct(*[x[name].alias(name) for name in fields])))
    return nodes.select("n", told.alias("told")).mapInPandas(run, "n long, payload string")


def reduce_tree(rows: DataFrame, order: list[str], fields: tuple[str, ...] = PM_FIELDS, merge: Merge | None = None, group: int = GROUP, large: int = LARGE) -> DataFrame:
    """(the fields, sessions, depth): all summaries joined into one, ``group`` neighbours at a time; no row where there is none.

    Items keep their order, distinct by case, 12 a field.  A node with more than
    ``large`` items is what ``merge`` says (the text of a JSON object) of the
    summaries below it; where that fails or is no object, what was put together."""
    level = settle(numbered(rows.select(*order, *fields), order).select("n", *fields, F.lit(1).cast("long").alias("sessions")), "level")
    depth = 0
    while (count := level.count()) > 1:
        depth += 1
        node = F.struct("n", *fields, "sessions")
        packed = level.groupBy(F.floor(F.col("n") / group).alias("n")).agg(F.array_sort(F.collect_list(node)).alias("of"))
        joined = packed.select("n", "of", *[_tidy(F.flatten(F.col(f"of.{name}"))).alias(name) for name in fields], F.aggregate("of", F.lit(0).cast("long"), lambda a, x: a + x["sessions"]).alias("sessions"))
        if merge is not None:
            joined = settle(joined, "joined")
            answers = settle(_asked(joined.filter(_size(fields) > large).repartition(max(1, count // group), "n"), merge, fields, place(level.sparkSession, "answers")), "answered")
            spoken = answers.filter(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")).select("n", F.struct(*summary(F.col("payload"), fields)).alias("said"))
            joined = joined.join(spoken, "n", "left").select("n", *[F.coalesce(F.col(f"said.{name}"), F.col(name)).alias(name) for name in fields], "sessions")
        level = settle(joined.select("n", *fields, "sessions"), "level")
    return level.select(*[_tidy(F.col(name)).alias(name) for name in fields] if depth == 0 else fields, "sessions", F.lit(depth).alias("depth"))
