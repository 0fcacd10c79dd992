"""Projections of assembled messages, and the small views that listings and reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import distinct_folded

# fixed values: formats, and those that a provider does not write
FORMATS = ("json", "markdown", "raw", "print")
UNSUPPORTED = {"opencode": ("raw",), "zcode": ("raw",), "cursor": ("raw",)}


def part_texts(parts: Column) -> Column:
    """Texts of text, reasoning and plan parts, and of what a user says in a turn, trimmed, without blanks, in order."""
    told = F.filter(parts, lambda p: p["kind"].isin("text", "reasoning", "plan", "turn"))
    return F.filter(F.transform(told, lambda p: F.trim(p["text"])), lambda t: t != "")


def _state(part: Column, name: str) -> Column:
    """A value of a part's ``state`` (JSON text) as text."""
    return F.try_variant_get(F.try_parse_json(part["state"]), f"$.{name}", "string")


def tool_calls(parts: Column, fields: StructType) -> Column:
    """(tool, arguments, output) of tool parts, and (prompt, nickname) where the layout has them.

    Parts have ``arguments`` and ``output`` or ``outputs`` (a text, or texts to be
    joined), or a ``state`` that holds arguments, output and prompt; a state that
    is no object holds nothing.  Values that are no text are JSON."""
    names = set(fields.fieldNames())

    def of(p: Column, *found: str) -> Column:
        for name in found:
            if name in names:
                return F.array_join(p[name], "\n\n") if fields[name].dataType.typeName() == "array" else p[name].cast("string")
        return _state(p, found[0]) if "state" in names else F.lit(None).cast("string")

    more = ["prompt", "nickname"] if names & {"prompt", "nickname", "state"} else []

    def call(p: Column) -> Column:
        told = [p["tool"].alias("tool"), of(p, "arguments").alias("arguments"), of(p, "output", "outputs").alias("output")]
        return F.struct(*told, *[(F.trim(of(p, x)) if x in names or x == "prompt" else F.lit(None).cast("string")).alias(x) for x in more])

    return F.transform(F.filter(parts, lambda p: p["kind"] == "tool"), call)


def subagent_calls(calls: Column) -> Column:
    return F.filter(calls, lambda c: c["tool"] == "subagent")


def legacy_texts(content: Column) -> Column:
    """Texts of an older message's content: a string, or a list of strings and of objects with ``text``."""
    v = F.try_parse_json(content)
    get = lambda x, path="$", kind="string": F.try_variant_get(x, path, kind)
    item = lambda x: F.when(F.schema_of_variant(x) == "STRING", get(x)).otherwise(F.trim(get(x, "$.text")))
    listed = F.transform(get(v, "$", "array<variant>"), item)
    lone = F.array(F.when(F.schema_of_variant(v) == "STRING", get(v)).when(v.isNull(), content))
    return F.filter(F.coalesce(listed, lone), lambda t: t.isNotNull() & (F.trim(t) != ""))


def transcript(messages: DataFrame) -> DataFrame:
    """(session, seq, role, texts, calls) of assembled messages; a role that is missing reads ``unknown``.

    Where messages have ``content``, the form older than parts, its texts come
    after those of the parts; where they have ``nickname``, so does the view."""
    fields = messages.schema["parts"].dataType.elementType
    texts = part_texts(F.col("parts"))
    if "content" in messages.columns:
        texts = F.concat(texts, F.coalesce(legacy_texts(F.col("content")), F.array().cast("array<string>")))
    more = [F.trim("nickname").alias("nickname")] if "nickname" in messages.columns else []
    return messages.select("session", "seq", F.lower(F.coalesce("role", F.lit("unknown"))).alias("role"), texts.alias("texts"), tool_calls(F.col("parts"), fields).alias("calls"), *more)


def spoken(view: DataFrame) -> DataFrame:
    """(session, seq, role, text) of a transcript: texts, then arguments, output and prompt of each call, trimmed, without blank ones."""
    names = [x for x in view.schema["calls"].dataType.elementType.fieldNames() if x in ("arguments", "output", "prompt")]
    of_calls = F.flatten(F.transform("calls", lambda c: F.array(*[c[x] for x in names])))
    told = F.filter(F.transform(F.concat("texts", of_calls), lambda t: F.trim(t)), lambda t: t != "")
    return view.select("session", "seq", "role", F.array_join(told, "\n\n").alias("text"))


def searchable(messages: DataFrame) -> DataFrame:
    """(session, content) of assembled messages: what a search finds in a session, tools' arguments, outputs and prompts as well.

    A session without anything to say has empty content."""
    said = spoken(transcript(messages)).groupBy("session").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("seq", "text")))).alias("m"))
    return said.select("session", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("content"))


def corpus(messages: DataFrame, *key: str) -> DataFrame:
    """(key, content): the messages' texts in order, trimmed, blank ones left out."""
    key = key or ("provider", "session_id")
    said = messages.filter(F.trim("text") != "").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))).alias("m"))
    return said.select(*key, F.array_join(F.transform("m", lambda x: x["t"]), "\n\n").alias("content"))


def json_or_list(value: Column) -> Column:
    """A JSON list's items as text; text that is no JSON as one item; nothing else has items."""
    v = F.try_parse_json(value)
    items = F.try_variant_get(v, "$", "array<string>")
    return F.when(items.isNotNull(), F.filter(items, lambda x: x.isNotNull() & (x != ""))).when(v.isNull() & (F.trim(value) != ""), F.array(value)).otherwise(F.array().cast("array<string>"))


def event_line(kind: Column, role: Column, files: Column, text: Column) -> Column:
    """``[kind] role=… files=a,b text=…``"""
    named = F.when(F.size(files) > 0, F.concat(F.lit(" files="), F.array_join(files, ","))).otherwise("")
    return F.concat(F.lit("["), kind, F.lit("] role="), role, named, F.lit(" text="), text)


def signature(updated: Column, *stats: Column) -> Column:
    """Change signature of a session: microseconds and the files' (modified, size) as compact JSON; a missing file is null."""
    return F.to_json(F.struct(F.unix_micros(updated).alias("at"), F.array(*stats).alias("files")), {"ignoreNullFields": "false"})


def item_count(*fields: Column) -> Column:
    """Items over all fields of a summary."""
    return sum((F.when(f.isNull(), 0).otherwise(F.size(f)) for f in fields), F.lit(0))


def highlights(summaries: DataFrame, bucket: Column, order: list[str], first: dict[str, int], lines: int = 6, items: int = 4) -> DataFrame:
    """(bucket, lines): one line a session from the first items of its fields; distinct lines in order.

    A bucket keeps its first ``lines`` distinct lines: repeats are dropped before
    they are counted, so a hot bucket sends no more than that many a task."""
    from pyspark.sql import Window

    picked = F.concat(*[F.coalesce(F.slice(f, 1, n), F.array().cast("array<string>")) for f, n in first.items()])
    text = F.array_join(distinct_folded(F.filter(picked, lambda x: F.trim(x) != ""), items), "; ")
    line = F.concat("title", F.lit(": "), F.coalesce(F.nullif(text, F.lit("")), F.lit("(no highlights)")))
    rows = summaries.select(F.coalesce(bucket, F.lit("(unknown)")).alias("bucket"), line.alias("line"), F.struct(*order).alias("at"))
    once = rows.groupBy("bucket", F.lower("line").alias("folded")).agg(F.min_by("line", "at").alias("line"), F.min("at").alias("at"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("at"))).filter(F.col("n") <= lines)
    return ranked.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))


def run_overview(planned: DataFrame, display: str, session: str, chunks: str) -> DataFrame:
    """(name, sessions, chunks) of a collect run, by name, and in all under ``(all)``."""
    rolled = planned.rollup(display).agg(F.count_distinct(session).alias("sessions"), F.coalesce(F.sum(chunks), F.lit(0)).alias("chunks"), F.grouping(display).alias("__all"))
    return rolled.select(F.when(F.col("__all") == 1, "(all)").otherwise(F.col(display)).alias("name"), "sessions", "chunks")


def outcome(results: DataFrame) -> DataFrame:
    """(any_success, all_failed, paths) of exports (path, ok)."""
    some = F.coalesce(F.bool_or("ok"), F.lit(False))
    return results.agg(some.alias("any_success"), (~some & (F.count(F.lit(1)) > 0)).alias("all_failed"), F.count_if("ok").alias("paths"))


def capabilities(providers: DataFrame, provider: str = "provider") -> DataFrame:
    """(provider, supported, unsupported) output formats."""
    every = F.array(*map(F.lit, FORMATS))
    known = F.create_map(*[F.lit(x) for name, formats in UNSUPPORTED.items() for x in (name, ",".join(formats))])
    missing = F.filter(F.split(F.coalesce(known[F.col(provider)], F.lit("")), ","), lambda x: x != "")
    return providers.select(provider, F.array_except(every, missing).alias("supported"), missing.alias("unsupported"))
