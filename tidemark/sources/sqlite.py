"""Sessions kept in SQLite files: tables session, message and part, or one of keys and values.

A Spark data source; each database file is one partition per table, read in
Arrow batches.  Conditions given to ``load`` are tested by SQLite.  (Spark 4.1
keeps the filters a Python source took for its next scan without filters, so
``pushFilters`` is not used.)  Values of a wrong type read as null, bytes that are no UTF-8 as replacement
characters.
"""

from __future__ import annotations

import contextlib
import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructType

# fixed values: columns of the store
SCHEMAS = {
    "session": "id string, title string, time_created long, time_updated long, slug string, directory string, version string, summary_files string",
    "message": "id string, session_id string, time_created long, data string",
    "part": "id string, message_id string, time_created long, data string",
    "cursorDiskKV": "row long, key string, value string",
}
COMPARED = ("=", "<>", ">", ">=", "<", "<=", "in", "has")
BATCH = 8192


def load(spark: SparkSession, path: str, table: str, *where: tuple[str, str, str | int | list]) -> DataFrame:
    """Rows of ``table`` in the databases of a comma list that meet all of ``where``, (column, comparison, value) each.

    A null meets no comparison; ``in`` takes a list.  ``has`` tests for a literal,
    case apart.  ``column:$.path`` is the value at a path of a JSON column.
    """
    for name, test, value in where:
        if name.partition(":")[0] not in {f.name for f in StructType.fromDDL(SCHEMAS[table])} or test not in COMPARED or (test == "in") != isinstance(value, list):
            raise ValueError(f"no such condition: {name} {test}")
    spark.dataSource.register(SqliteSessions)
    return spark.read.format("sqlite_sessions").option("path", path).option("table", table).option("where", json.dumps(where)).load()


def _folded(text: str) -> str:
    """As ``postings.fold`` does it."""
    return text.translate({0x130: "i", 0x1E9E: "ß"}).upper().lower().replace("ς", "σ")


def _has(text: object, literal: str) -> bool:
    return isinstance(text, str) and literal in _folded(text)


class SqliteSessions(DataSource):
    """``spark.read.format("sqlite_sessions").option("path", file).option("table", "message")``"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_sessions"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "session")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


@contextlib.contextmanager
def _local(path: str) -> Iterator[str]:
    """The database as a local file: a path as it is, a remote one as a copy for the time of one task."""
    if path.startswith("file:") or "://" not in path:
        yield path if not path.startswith("file:") else "/" + path.removeprefix("file:").lstrip("/")
        return
    fs, place = pafs.FileSystem.from_uri(path)
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, "copy.db")
        with fs.open_input_stream(place) as source, open(copy, "wb") as out:
            while piece := source.read(1 << 22):
                out.write(piece)
        yield copy


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for path in self.options["path"].split(",")]

    def _value(self, name: str, there: set[str]) -> str:
        if name == "row":
            return "rowid"
        if name not in there:
            return "null"
        if isinstance(self.schema[name].dataType, LongType):
            return f"case when typeof({name}) in ('integer', 'real') then cast({name} as integer) end"
        return f"cast({name} as text)"

    def _test(self, name: str, test: str, value: str | int | list, there: set[str]) -> tuple[str, list]:
        """A condition as SQL with its values."""
        column, _, path = name.partition(":")
        cell, values = self._value(column, there), []
        if path:
            cell, values = f"case when json_valid({cell}) then json_extract({cell}, ?) end", [path]
        if test == "in":
            return f"({cell}) in (select value from json_each(?))", [*values, json.dumps(value)]
        if test == "has":
            return f"has_literal({cell}, ?)", [*values, _folded(value)]
        return f"({cell}) {test} ?", [*values, value]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        table, since = self.options.get("table", "session"), int(self.options.get("since_ms", 0))
        if table not in SCHEMAS:
            raise ValueError(f"no such table: {table}")
        names = [f.name for f in self.schema]
        kinds = [pa.int64() if isinstance(f.dataType, LongType) else pa.string() for f in self.schema]
        with _local(partition.value) as path, contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            db.text_factory = lambda raw: raw.decode(errors="replace")
            db.create_function("has_literal", 2, _has, deterministic=True)
            if not db.execute("select 1 from sqlite_master where name = ?", (table,)).fetchone():
                return
            there = {r[1] for r in db.execute(f"pragma table_info({table})")}
            # lists go as one JSON value, so their length has no limit
            tests = [self._test(*told, there) for told in json.loads(self.options.get("where", "[]"))]
            if since and "time_created" in there:
                tests.append(("coalesce(time_created, 0) >= ?", [since]))
            where = f" where {' and '.join(t for t, _ in tests)}" if tests else ""
            found = db.execute(f"select {', '.join(self._value(n, there) for n in names)} from {table}{where}", [v for _, values in tests for v in values])
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def keyword_sessions(spark: SparkSession, path: str, literal: str) -> DataFrame:
    """(session_id) of the opencode layout's sessions that have a literal in their title or in the text of a part.

    SQLite tests for it, so other rows do not leave the store; what comes is
    tested again as every search tests."""
    from tidemark.functions.text import has_literal

    titled = load(spark, path, "session", ("title", "has", literal)).filter(has_literal(F.col("title"), literal)).select(F.col("id").alias("session_id"))
    said = load(spark, path, "part", ("data:$.text", "has", literal)).filter(has_literal(F.get_json_object("data", "$.text"), literal)).select(F.col("message_id").alias("id")).distinct()
    return titled.unionByName(load(spark, path, "message").select("id", "session_id").join(said, "id").select("session_id")).distinct()
