"""Sinks: Markdown, JSON, list and head renderings of sessions, export targets and raw copies."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import body_text, clip, display_text, safe_name

# fixed values: export formats, their file suffixes and other names
FORMATS = ("json", "markdown", "print", "raw")
SUFFIXES = {"json": ".json", "markdown": ".md", "print": ".txt", "raw": ".raw.json"}
FORMAT_ALIASES = {"md": "markdown"}


def markdown(messages: DataFrame, session: str, order: str) -> DataFrame:
    """(session, markdown): numbered ``## n. Role`` sections without control characters."""
    packed = messages.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("m"))
    part = lambda x, i: F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), F.upper(F.substring(x["role"], 1, 1)), F.substring(x["role"], 2, 1000), F.lit("\n\n"), body_text(x["text"]))
    return packed.select(session, F.array_join(F.transform("m", part), "\n\n").alias("markdown"))


def write_json(messages: DataFrame, session: str, order: str, path: str) -> None:
    """One JSON object for each session, in files by the session's safe name."""
    packed = messages.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("messages"))
    packed.withColumn("name", safe_name(F.col(session).cast("string"))).write.mode("overwrite").json(path)


def parse_formats(raw: str) -> list[str]:
    """Formats of a comma list, ``md`` for markdown, each once."""
    found = [FORMAT_ALIASES.get(x.strip().lower(), x.strip().lower()) for x in raw.split(",")]
    if bad := [x for x in found if x not in FORMATS]:
        raise ValueError(f"unknown format: {bad[0] or '(empty)'}; known: {', '.join(FORMATS)}")
    return list(dict.fromkeys(found))


def short_path(path: Column) -> Column:
    """The last two parts of a path."""
    parts = F.filter(F.split(F.trim(path), r"[/\\]"), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.trim(path)).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"))


def _capped(value: Column, limit: int) -> Column:
    tidy = F.nullif(F.trim(value), F.lit(""))
    return F.when(F.length(tidy) <= limit, tidy).otherwise(F.concat(F.substring(tidy, 1, limit - 3), F.lit("...")))


def list_line(location: Column, model: Column, branch: Column, messages: Column, updated: Column, uri: Column, zone: str = "UTC") -> Column:
    """One line of a session's facts; those not known are left out, an unknown count is named so."""
    field = lambda name, value: F.concat(F.lit(name + "="), value)
    at = F.date_format(F.from_utc_timestamp(updated, zone), "yyyy-MM-dd HH:mm")
    count = F.coalesce(messages.cast("string"), F.lit("unknown"))
    return display_text(F.concat_ws(" | ", field("cwd", _capped(short_path(location), 32)), field("model", _capped(model, 24)), field("branch", _capped(branch, 24)), field("msgs", count), field("updated", at), field("uri", uri)))


def head_lines(fields: dict[str, Column]) -> Column:
    """``- label: value`` lines; a blank value shows as ``-``, lists as their first five items."""
    shown = []
    for label, value in fields.items():
        text = F.rtrim(clip(F.trim(value.cast("string")), 120))
        shown.append(F.concat(F.lit(f"- {label}: "), F.coalesce(F.nullif(display_text(text), F.lit("")), F.lit("-"))))
    return F.concat_ws("\n", F.lit("# Session Head\n"), *shown)


def few(values: Column) -> Column:
    """The first five items that are not blank, each at most 48 characters, as one text; null without any."""
    tidy = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_join(F.slice(F.transform(tidy, lambda x: clip(x, 48)), 1, 5), ", "), F.lit(""))


def ranked(found: DataFrame, *order: Column) -> DataFrame:
    """Results numbered from 1 in their order; ``found`` is a top-k result, so one task numbers it."""
    from pyspark.sql import Window

    return found.withColumn("n", F.row_number().over(Window.orderBy(*order)))


def export_plan(sessions: DataFrame, session: str, formats: list[str], root: str) -> DataFrame:
    """(session, format, target, collides): every session in every format; all claimants of one target collide.

    Targets are compared by lower case, as file systems without case do.
    """
    suffixes = F.create_map(*[F.lit(x) for name in formats for x in (name, SUFFIXES[name])])
    rows = sessions.select(session).withColumn("format", F.explode(F.array(*map(F.lit, formats))))
    rows = rows.withColumn("target", F.concat(F.lit(root.rstrip("/") + "/"), safe_name(F.col(session).cast("string")), suffixes[F.col("format")]))
    claims = rows.groupBy(F.lower("target").alias("__key")).agg(F.count(F.lit(1)).alias("__claims"))
    return rows.join(claims, F.lower(rows["target"]) == claims["__key"]).select(session, "format", "target", (F.col("__claims") > 1).alias("collides"))


def raw_copies(spark: SparkSession, root: str, target: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, copy, bytes) of byte-for-byte copies in the shared folder ``target``; a file appears whole or not at all."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(target, exist_ok=True)
        for batch in batches:
            done = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                digest, name = hashlib.sha256(path.encode()).hexdigest()[:16], path.rsplit("/", 1)[-1]
                goal = os.path.join(target, f"{digest}-{name}")
                part = f"{goal}.{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, goal)
                done.append((path, goal, len(content)))
            yield pd.DataFrame(done, columns=["path", "copy", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(copy, "path string, copy string, bytes long")


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row (file, content) as a UTF-8 text file below the shared ``folder``; returns the number of files.

    ``file`` may hold sub-folders.  A file appears whole or not at all, so a
    task may run again; of rows with the same name the last one written stays.
    """
    root = "file://" + folder if folder.startswith("/") else folder

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = (pafs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if root.startswith("file:") else pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"], strict=True):
                goal = f"{base}/{name}"
                fs.create_dir(goal.rsplit("/", 1)[0], recursive=True)
                part = f"{goal}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write((content or "").encode())
                fs.move(part, goal)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("file", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
