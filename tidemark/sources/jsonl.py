"""Sessions kept as JSON lines: one file a session.

Folders that tasks can open are listed by tasks and read by ranges of their files
(``listed``, ``records_in``): many small files share a task, and no listing comes
to the driver.  Files elsewhere are read as text in splits of
``spark.sql.files.maxPartitionBytes``, so a long file is many tasks and never one cell.  Lines are numbered inside their
split; what the splits before hold is added from one row a split, so no task
sees a whole long file.  Bad lines are counted and skipped, and an unfinished
last line is ignored.  ``records_in`` reads only the files it is given, by
ranges that are planned from their sizes.
"""

from __future__ import annotations

import fnmatch
import itertools
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.operators.scratch import settle

RECORDS = "path string, line long, record string, bad long"
# fixed values: bytes of a file that is listed as a whole, and of the first and last part read of a longer one
WHOLE_BYTES, END_BYTES = 256 << 10, 64 << 10
#: Line number of the last record of a file of which only the ends were read.
TAIL = 1 << 40


def parse(line: bytes) -> str | None:
    """The line's JSON object as compact text; null for anything else."""
    try:
        value = json.loads(line.decode())
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None


@F.pandas_udf(StringType())
def _object(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: parse(bytes(x)))


def file_path() -> Column:
    """Path of a row's file in the form that ``files`` lists it."""
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def _reader(spark: SparkSession, kind: str, pattern: str, since: str | None):
    reader = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.option("modifiedAfter", since) if since else reader


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl", since: str | None = None) -> DataFrame:
    """(path, modified, size) of the files; their contents are not read.  With ``since`` (``yyyy-MM-dd'T'HH:mm:ss``) files not modified after it are not listed."""
    if _by_tasks(root, pattern, since):
        return listed(spark, root, pattern)
    found = _reader(spark, "binaryFile", pattern, since).load(root)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def _by_tasks(root: str, pattern: str, since: str | None) -> bool:
    """Whether tasks can list a folder themselves: a plain folder that Python sees as well, all its files."""
    if since or not root.startswith(("/", "file:/")) or set(root + pattern) & set("{}[]?\\,") or "*" in root:
        return False
    return pafs.LocalFileSystem().get_file_info(_local(root)).type == pafs.FileType.Directory


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def listed(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """As ``files``, listed by tasks, a level of folders at a time; the driver sees no file.

    Hidden and empty files and hidden folders are left out, as by Spark's readers."""
    schema = "path string, folder boolean, modified long, size long"

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, hidden = pafs.LocalFileSystem(), lambda n: n[0] == "." or n[0] == "_" and "=" not in n or n.endswith("._COPYING_")
        for batch in batches:
            rows = []
            for path in batch["path"]:
                for x in fs.get_file_info(pafs.FileSelector(_local(path))):
                    is_folder = x.type == pafs.FileType.Directory
                    if not hidden(x.base_name) and (is_folder or x.size and fnmatch.fnmatchcase(x.base_name, pattern)):
                        rows.append((f"file:{x.path}", is_folder, (x.mtime_ns or 0) // 1_000_000, None if is_folder else x.size))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["path", "folder", "modified", "size"]).astype({"size": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "folder", "modified", "size"]).astype({"size": "Int64"})

    level, found = spark.createDataFrame([(root,)], "path string"), []
    while level is not None:
        rows = settle(level.mapInPandas(children, schema), "listed")
        found.append(rows.filter("not folder"))
        folders = rows.filter("folder").select("path")
        level = folders.repartition(4 * spark.sparkContext.defaultParallelism) if folders.head(1) else None
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select("path", F.timestamp_millis("modified").alias("modified"), "size")


def texts_of(held: DataFrame) -> DataFrame:
    """``held(path, ...)`` with the whole text of each file as ``value``; for files of one short record."""
    schema = StructType([*held.schema.fields, StructField("value", StringType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for path in batch["path"]:
                with open_file(path) as source:
                    values.append(source.read().decode(errors="replace"))
            yield batch.assign(value=values)

    return held.mapInPandas(read, schema)


def records(spark: SparkSession, root: str, pattern: str = "*.jsonl", since: str | None = None) -> DataFrame:
    """(path, line, record, bad) of every file below ``root``; with ``since``, of the files modified after it."""
    if _by_tasks(root, pattern, since):
        return records_in(listed(spark, root, pattern).select("path", "size"))
    lines = _reader(spark, "text", pattern, since).option("lineSep", "\n").load(root)
    lines = lines.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("place"), (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("alone"), F.col("value").cast("binary").alias("raw"))
    filled = F.decode("raw", "ISO-8859-1").rlike(r"[^ \t\r\x0B\f]")
    lines = lines.select("path", "start", "size", "place", "alone", F.octet_length("raw").alias("bytes"), filled.alias("filled"), _object("raw").alias("record"))
    return _numbered(lines, _held(lines.filter(~F.col("alone"))))


def _held(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes") + 1).alias("held"))


def _numbered(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(path, line, record, bad) of lines (path, start, size, place, bytes, filled, record): ``start`` names the split, ``place`` orders its lines.

    ``splits`` gives (path, start, n, held), the lines and bytes of each split of files that have several."""
    inside = Window.partitionBy("path", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("path", "start", "size", "filled", "record", F.count(F.lit(1)).over(inside).alias("n"), F.sum(F.col("bytes") + 1).over(inside).alias("upto"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("path", "start", F.sum("n").over(before).alias("lines_before"), F.sum("held").over(before).alias("bytes_before"))
    rows = rows.join(bases, ["path", "start"], "left")
    line = F.col("n") + F.coalesce("lines_before", F.lit(0))
    end = F.col("upto") + F.coalesce("bytes_before", F.lit(0))
    # past the file's end: the last line has no line feed
    whole = F.col("filled") & (F.col("record").isNotNull() | (end <= F.col("size")))
    return rows.filter(whole).select("path", line.alias("line"), "record", F.when(F.col("record").isNull(), line).alias("bad"))


#: Bytes of a range that is read by one task of ``records_in``, and bytes of lines that it holds at once.
RANGE, HELD = 64 << 20, 4 << 20


def range_lines(source, start: int, stop: int, size: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a seekable file that begin in ``[start, stop)``; the last one is read to its end."""
    # a line that begins at ``start`` has a line feed before it
    at = max(start - 1, 0)
    source.seek(at)
    begins, rest, read = (0 if start == 0 else None), b"", at
    while read < size and (begins is None or begins < stop):
        some = source.read(min(step, size - read))
        if not some:
            break
        read += len(some)
        rest += some
        if begins is None:
            cut = rest.find(b"\n")
            if cut < 0:
                rest = b""
                continue
            begins, rest = read - len(rest) + cut + 1, rest[cut + 1 :]
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if begins >= stop:
                return
            yield line
            begins += len(line) + 1
    if rest and begins is not None and begins < stop:
        yield rest


def open_file(path: str):
    """A seekable file of the store that a path names."""
    fs, place = (pafs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") else pafs.FileSystem.from_uri(path)
    return fs.open_input_file(place)


def records_in(held: DataFrame, count=None) -> DataFrame:
    """(path, line, record, bad) of the files (path, size) of ``held`` and of no other.

    ``held`` is a listing that was cut down by names or headers before; ranges of
    its files are dealt to tasks.  The lines of files of several ranges are
    counted first, which reads those files twice.  ``count`` is an accumulator of
    the bytes read."""
    spark = held.sparkSession
    ranges = held.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(RANGE).cast("long"))).alias("start"))
    # one number for each file: how many tasks read them
    total, many = held.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = int(min(max(1, many, total // RANGE), max(spark.sparkContext.defaultParallelism, total // RANGE)))
    width = RANGE

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["size"], batch["start"], strict=True):
                with open_file(path) as source:
                    for place, line in enumerate(range_lines(source, start, min(start + width, size), size)):
                        if count is not None:
                            count.add(min(len(line) + 1, size))
                        yield path, start, size, place, line

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (path, start), lines in itertools.groupby(read(batches), lambda r: r[:2]):
            n = held_bytes = 0
            for *_, line in lines:
                n, held_bytes = n + 1, held_bytes + len(line) + 1
            yield pd.DataFrame([(path, start, n, held_bytes)], columns=["path", "start", "n", "held"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "start", "size", "place", "bytes", "filled", "record"]
        rows, size = [], 0
        for path, start, whole, place, line in read(batches):
            rows.append((path, start, whole, place, len(line), bool(line.strip(b" \t\r\x0b\f")), parse(line)))
            size += len(line) + 1
            if size >= HELD:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    lines = ranges.repartition(tasks, "path", "start").mapInPandas(scan, "path string, start long, size long, place long, bytes int, filled boolean, record string")
    long_ = ranges.filter(F.col("size") > width).repartition(tasks, "path", "start")
    return _numbered(lines, long_.mapInPandas(sizes, "path string, start long, n long, held long"))


def ends_of(source, size: int, most: int) -> list[tuple[int, str]]:
    """(line, object) of a readable, seekable file: all of a short one, else the first ``most`` lines within the first part and the last whole line of the last part.

    A first line longer than that part gives an empty object; blank and bad lines give none.
    """
    if size <= WHOLE_BYTES:
        return [(n, found) for n, line in enumerate(source.read(size).split(b"\n"), 1) if line.strip() and (found := parse(line))]
    first = source.read(END_BYTES)
    if b"\n" not in first:
        heads = [(1, "{}")]
    else:
        whole = [(n, x) for n, x in enumerate(first.split(b"\n")[:-1], 1) if x.strip()][:most]
        heads = [(n, found) for n, x in whole if (found := parse(x))]
    source.seek(size - END_BYTES)
    lines = source.read(END_BYTES).split(b"\n")
    # before the first line feed and after the last one stand parts of lines
    last = next((x for x in reversed(lines[1:-1]) if x.strip()), None)
    tail = parse(last) if last is not None else None
    return heads + ([(TAIL, tail)] if tail else [])


def ends(spark: SparkSession, root: str, most: int, pattern: str = "*.jsonl", since: str | None = None) -> DataFrame:
    """Records of the files' ends, read by ranges: at most 256 KiB a file, whatever its size; ``bad`` is null.

    For listings: ``most`` is the number of first lines a layout looks at.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size"], strict=True):
                with open_file(path) as source:
                    rows += [(path, line, found, None) for line, found in ends_of(source, size, most)]
            yield pd.DataFrame(rows, columns=["path", "line", "record", "bad"])

    return files(spark, root, pattern, since).select("path", "size").mapInPandas(scan, RECORDS)


def bad_lines(rows: DataFrame, samples: int = 5) -> DataFrame:
    """Bad lines of each file: their number and the first few."""
    return rows.filter("bad is not null").groupBy("path").agg(F.count(F.lit(1)).alias("bad"), F.slice(F.array_sort(F.collect_list("bad")), 1, samples).alias("samples"))


def pi_sessions(rows: DataFrame) -> DataFrame:
    """Sessions of the pi layout: a ``session`` record first, a title from the last ``session_info``, messages counted."""
    j = lambda p: F.get_json_object("record", p)
    kind, at = j("$.type"), F.coalesce(F.try_to_timestamp(j("$.timestamp")))
    good = rows.filter("record is not null").select("path", "line", kind.alias("kind"), at.alias("at"), j("$.id").alias("id"), j("$.cwd").alias("cwd"), j("$.name").alias("name"))
    packed = good.groupBy("path").agg(
        F.min_by("kind", "line").alias("first"), F.min_by("id", "line").alias("session_id"), F.min_by("cwd", "line").alias("cwd"), F.min_by("at", "line").alias("created_at"),
        F.max("at").alias("updated_at"), F.max_by("name", F.when(F.col("kind") == "session_info", F.col("line"))).alias("title"), F.count_if(F.col("kind") == "message").alias("message_count"))
    return packed.filter("first = 'session'").drop("first")
