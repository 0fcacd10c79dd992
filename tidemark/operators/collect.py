"""Collect: events within a budget, chunks, merged summaries, tree reduction."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clip, collapse, distinct_folded, event_kind, find_paths

# fixed values of the collect step
EVENT_BUDGET, CHUNK_CHARS, GROUP, MOST_ITEMS = 12_000, 3_200, 8, 12


def admit(events: Column, budget: int = EVENT_BUDGET) -> Column:
    """Events (array of structs with ``size``) that fit the budget: too large ones are skipped, the first always stays."""
    none = F.struct(F.lit(0).cast("long").alias("used"), F.slice(events, 1, 0).alias("kept"))
    step = lambda acc, e: F.when((F.size(acc["kept"]) > 0) & (acc["used"] + e["size"] > budget), acc).otherwise(F.struct((acc["used"] + e["size"]).alias("used"), F.concat(acc["kept"], F.array(e)).alias("kept")))
    return F.aggregate(events, none, step)["kept"]


def chunk_numbers(sizes: Column, target: int = CHUNK_CHARS) -> Column:
    """Chunk number of each size in order: a new chunk where size + 1 would pass the target."""
    none = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        cut = (acc["used"] > 0) & (acc["used"] + size + 1 > target)
        chunk = F.when(cut, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(cut, size + 1).otherwise(acc["used"] + size + 1).cast("long").alias("used"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, none, step)["out"]


#: Characters an event counts beside its text and files (a fixed value); no event is smaller than one more.
EVENT_CHARS = 32


def events_of(messages: DataFrame, session: str, order: str) -> DataFrame:
    """(session, order, size, kind, role, text, files) of every text of a user or assistant that says something."""
    seen = messages.filter(F.col("role").isin("user", "assistant")).withColumn("kind", event_kind(F.col("role"), F.col("text"))).filter("kind is not null")
    event = seen.withColumn("text", clip(F.trim("text"), 280)).withColumn("files", find_paths(F.col("text")))
    size = F.length("text") + F.aggregate("files", F.lit(0), lambda a, x: a + F.length(x)) + EVENT_CHARS
    return event.select(session, order, size.cast("long").alias("size"), "kind", "role", "text", "files")


def session_events(messages: DataFrame, session: str, order: str, budget: int = EVENT_BUDGET) -> DataFrame:
    """Admitted events of each session: (session, order, kind, role, text, files).

    Where an event is admitted, so are all before it that are no larger.  Of one
    size only the first ``budget / size`` can be, and the others go before a
    session is gathered, most of them before the exchange."""
    rows = events_of(messages, session, order)
    n = F.row_number().over(Window.partitionBy(session, "size").orderBy(order, "kind", "role", "text"))
    most = max(1, budget // (EVENT_CHARS + 1))
    some = rows.withColumn("__n", n).filter((F.col("__n") <= most) & (F.col("__n") <= F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("size")))))
    packed = some.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, "size", "kind", "role", "text", "files"))).alias("events"))
    return packed.select(session, F.explode(admit(F.col("events"), budget)).alias("e")).select(session, f"e.{order}", "e.kind", "e.role", "e.text", "e.files")


def merge_items(rows: DataFrame, group: str, order: list[str], item: str, limit: int = MOST_ITEMS) -> DataFrame:
    """Items of each group in order, white space collapsed, distinct by case, at most ``limit``.

    Repeats meet before the limit, and a task sends no more than ``limit`` items of a group, so a hot group is never gathered."""
    plain = rows.select(group, *order, collapse(F.col(item)).alias("__item")).filter("__item <> ''")
    first = plain.groupBy(group, F.lower("__item").alias("__folded")).agg(F.min(F.struct(*order, "__item")).alias("__first"))
    ranked = first.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("__first"))).filter(F.col("__n") <= limit)
    packed = ranked.groupBy(group).agg(F.array_sort(F.collect_list("__first")).alias("__v"))
    return packed.select(group, F.transform("__v", lambda x: x["__item"]).alias("items"))


def tree_levels(n: Column, group: int = GROUP) -> Column:
    """Rounds of a reduction that joins ``group`` neighbours at a time."""
    return F.ceil(F.round(F.log(float(group), F.greatest(n, F.lit(1)).cast("double")), 9)).cast("int")


# fixed values: fields of a summary by mode
PM_FIELDS = ("topics", "decisions", "key_actions", "code_changes", "errors", "tools_used", "files", "artifacts", "open_questions", "notes")
INSIGHT_FIELDS = ("scene", "stuck", "turning")


def _tidy(items: Column, limit: int = MOST_ITEMS) -> Column:
    return distinct_folded(F.filter(F.transform(items, collapse), lambda x: x != ""), limit)


def summary(payload: Column, fields: tuple[str, ...] = PM_FIELDS) -> list[Column]:
    """The fields of a summary's JSON text (alone or in a fenced block) as arrays; a string is one item, other values none."""
    fenced = F.nullif(F.regexp_extract(payload, r"(?is)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    v = F.coalesce(F.try_parse_json(payload), F.try_parse_json(fenced))
    none = F.array().cast("array<string>")

    def items(name: str) -> Column:
        there = F.try_variant_get(v, f"$.{name}", "variant")
        listed = F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
        one = F.when(F.schema_of_variant(there) == "STRING", F.array(F.try_variant_get(v, f"$.{name}", "string")))
        return _tidy(F.coalesce(listed, one, none))

    return [items(name).alias(name) for name in fields]


def first_object(text: str) -> str:
    """The first JSON object in a text, as it stands there; ``ValueError`` where there is none."""
    at = text.find("{")
    while at >= 0:
        try:
            return text[at : json.JSONDecoder().raw_decode(text, at)[1]]
        except ValueError:
            at = text.find("{", at + 1)
    raise ValueError("no JSON object")


def summarise(chunks: DataFrame, ask: Callable[[str], str], retries: int = 1) -> DataFrame:
    """``chunks`` (session, chunk, prompt) with ``payload``, or ``error`` where every try failed.

    ``ask`` runs in the Python workers, a batch at a time; the payload is the
    first JSON object of the answer, and one without any counts as failed.
    """

    def answer(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(retries + 1):
            try:
                return first_object(ask(prompt)), None
            except (ValueError, OSError, RuntimeError) as failed:
                error = str(failed) or type(failed).__name__
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [answer(p or "") for p in batch["prompt"]]
            yield batch.drop(columns="prompt").assign(payload=[x for x, _ in found], error=[x for _, x in found])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    return chunks.select("session", "chunk", "prompt").mapInPandas(run, f"session {kinds['session']}, chunk {kinds['chunk']}, payload string, error string")


def merge_summaries(rows: DataFrame, group: list[str], order: list[str], fields: tuple[str, ...] = PM_FIELDS) -> DataFrame:
    """One summary for each group: its summaries' items in order, distinct by case, at most 12 a field."""
    gathered = [F.array_sort(F.collect_list(F.struct(*order, name))).alias(name) for name in fields]
    packed = rows.groupBy(*group).agg(*gathered)
    return packed.select(*group, *[_tidy(F.flatten(F.col(f"{name}.{name}"))).alias(name) for name in fields])


def reduce_summaries(rows: DataFrame, order: list[str], fields: tuple[str, ...] = PM_FIELDS, limit: int = MOST_ITEMS) -> DataFrame:
    """(field, n, item): what joining all summaries neighbour by neighbour leaves.

    The first items distinct by case of a whole are the first of its groups'
    first, so no tree is needed: every item's first place, then the best places.
    """
    piece = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("items")) for name in fields])).alias("f")
    rows = rows.select(*order, piece).select(*order, "f.field", F.posexplode("f.items").alias("at", "raw")).withColumn("item", collapse(F.col("raw"))).filter("item <> ''")
    first = rows.groupBy("field", F.lower("item").alias("folded")).agg(F.min(F.struct(*order, "at", "item")).alias("first"))
    n = F.row_number().over(Window.partitionBy("field").orderBy("first"))
    return first.withColumn("n", n).filter(F.col("n") <= limit).select("field", "n", "first.item")
