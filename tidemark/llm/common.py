"""Shared plumbing of the training-data operators.

Scratch tables stand in for lineage cuts: a table is written below the folder
named by ``spark.checkpoint.dir`` and read back, so that a lost executor never
invalidates what was already decided.  The setting is only filled in where it
is unset (tests, notebooks).
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Salts that spread one hot key; a key with a third of all rows leaves a 1/768 share for each salt.
SALTS = 256

#: White space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str, free: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return the table read back.

    With ``free`` the driver collects its garbage afterwards: shuffle files of
    steps that are over go at once, not when the heap happens to fill."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    if free:
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast (some 20 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small_side(rows: DataFrame) -> DataFrame:
    """``rows``, a settled table of a few numbers a row, to be broadcast if it counts few enough rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: Bytes of names that may be broadcast with them.
BROADCAST_BYTES = 32 << 20


def is_light(rows: DataFrame) -> bool:
    """Whether a settled table of numbers and names counts few enough rows and bytes to be broadcast, or to be one task's work."""
    names = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rows.schema if f.dataType.typeName() == "string"]
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(names, F.lit(0))), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def gathered(rows: DataFrame) -> DataFrame:
    """A settled table whose groups and joins need no exchange where it is light."""
    return rows.coalesce(1) if is_light(rows) else rows


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/tidemark/" in root:
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def position(columns: list[str], name: str) -> int | None:
    """Where a column stands: by its exact name, else by its name in any case."""
    return next((i for i, c in enumerate(columns) if c == name), next((i for i, c in enumerate(columns) if c.lower() == name.lower()), None))


def columns_of(names: list[str], *wanted: str) -> list[Column]:
    """The wanted columns of a table renamed ``__c0``, ``__c1``, ... in order; null where there is none."""
    places = [position(names, c) for c in wanted]
    return [F.lit(None) if at is None else F.col(f"__c{at}") for at in places]


def pick(df: DataFrame, *names: str, rest: bool = False) -> DataFrame:
    """The named columns, found by position so that extra columns whose names
    differ only in case cannot make them ambiguous.  A column that is missing
    reads as null.  With ``rest`` all other columns follow under neutral names."""
    columns = df.columns
    plain = df.toDF(*[f"__c{i}" for i in range(len(columns))])
    found = []
    for name in names:
        at = position(columns, name)
        found.append((F.lit(None) if at is None else F.col(f"__c{at}")).alias(name))
    return plain.select(*found, *([F.col(c) for c in plain.columns] if rest else []))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows kept back from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_column(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def group_best(rows: DataFrame, key: str, order: str, unique: str, salts: int = SALTS, once: bool = False) -> DataFrame:
    """Adds ``best`` (smallest ``order`` of the key's rows) and ``group_size``.

    Rows of a key meet in three bounded steps: (key, salt) partial minima, a
    window over at most ``salts`` partials a key, and a join back on
    (key, salt); no task ever holds a whole hot key.  ``unique`` only spreads
    the rows of a key over the salts.  With ``once``, for rows that have no other
    columns, they shuffle once, for the partial minima and for the join alike."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(unique)), F.lit(salts)).cast("int"))
    if once:
        salted = salted.repartition(key, "__salt")
    partial = salted.groupBy(key, "__salt").agg(F.min(order).alias("__b"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(key)
    spread = partial.select(key, "__salt", F.min("__b").over(whole).alias("best"), F.sum("__n").over(whole).alias("group_size"))
    return salted.join(spread, [key, "__salt"]).drop("__salt")


#: Keys that may be broadcast as heavy: those that hold more than this share of all rows, so there are never more of them.
HEAVY_KEYS = 1 << 14


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side``, a settled table of one row a key that says in ``weight`` how many rows have that key.

    Keys with more than 1 / HEAVY_KEYS of the ``total`` rows are broadcast, which
    their number bounds; the others are shuffled and no task meets a hot one.
    ``weight`` is left out of the result; keys must not be null."""
    heavy = side.filter(F.col(weight) * HEAVY_KEYS > total).drop(weight)
    light = side.filter(F.col(weight) * HEAVY_KEYS <= total).drop(weight)
    of_heavy = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return of_heavy.unionByName(rest.join(light, keys))


def sized(total_bytes: int | None, each: int, least: int = 1) -> int:
    """Number of parts so that each holds about ``each`` bytes."""
    return max(least, -(-int(total_bytes or 0) // each))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def give_back() -> None:
    """Return to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """``run``, a function for mapInArrow, that gives its memory back when a task ends.

    Python workers outlive tasks and steps: without this each keeps the largest
    heap of all steps it has worked for."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def released_group(run: Callable) -> Callable:
    """The same for applyInArrow, after each group."""

    def group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return group


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
