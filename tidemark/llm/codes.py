"""Codes of vectors by parts: Lloyd rounds over weighted distinct integer parts.

Components become integers, vectors are cut into equal parts, and equal parts of
a position are one row with a weight.  A round sends the codebooks, whose size
only parameters fix, to the tasks, assigns the distinct rows and adds up
(position, entry) sums inside each task before they meet.  Codes and errors are
found once for each distinct part and joined back to the vectors; parts that
very many vectors share are broadcast, all others shuffled
(:func:`tidemark.llm.common.join_counted`).

Defined results: vectors that are null or hold null or non-finite components
are dropped, and so are those whose length is not the table's: the most
frequent length above zero that the number of parts divides, of equally frequent
ones the largest.  Rows with null or repeated ids are coded like any other; where
ids tie for the first entries, null ids come last and equal ids in order of their
components; with fewer vectors than entries the codebooks are shorter.  Of
entries at the same distance the first is taken.  Null labels count as one
label.  An empty table gives an empty table; extra columns are ignored, whatever
their names.  Components whose integer is 2**24 or more are refused with an
error: sums of squares are exact below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, pick, settle

#: Integers stay below this, so that exact sums of squares fit 64 bits.
LARGEST = 1 << 24
#: Rows whose distances to all entries are taken at once.
BLOCK = 2048

_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


#: Added to integers, whose big-endian bytes then sort as the integers do.
_SHIFT = 1 << 31


def _packed(x: np.ndarray) -> bytes:
    return (x + _SHIFT).astype(">u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").astype(np.int64) - _SHIFT


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            flat = np.floor(batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(flat) and np.abs(flat).max() >= LARGEST:
                raise ValueError("a component is too large for exact sums of squares")
            width = len(flat) // max(1, batch.num_rows)
            raw = _packed(flat)
            blobs = [raw[i : i + 4 * width] for i in range(0, len(raw), 4 * width)] if width else []
            yield batch.set_column(at, "embedding", pa.array(blobs, pa.binary()))

    return run


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (the first of equally near ones) and its squared distance, exactly."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    largest = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    # whole numbers in floats are exact up to 2**53
    kind = np.float64 if 4 * x.shape[1] * largest**2 < 2**53 else np.int64
    book = book.astype(kind)
    norms = (book * book).sum(1)
    for i in range(0, len(x), BLOCK):
        some = x[i : i + BLOCK].astype(kind)
        far = norms - 2 * (some @ book.T)
        code[i : i + BLOCK] = best = far.argmin(1)
        error[i : i + BLOCK] = far[np.arange(len(some)), best] + (some * some).sum(1)
    return code, error


def _by_part(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, row numbers, integers) of a batch of (part, piece, weight)."""
    part = batch.column(0).to_numpy()
    x = _unpacked(b"".join(batch.column(1).to_pylist())).reshape(-1, width)
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        yield int(p), rows, x[rows]


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for p, rows, x in _by_part(batch, width):
                code, _ = _nearest(x, books[p])
                np.add.at(count[p], code, weight[rows])
                np.add.at(total[p], code, x * weight[rows, None])
        part, entry = np.nonzero(count)
        sums = [pa.array(total[part, entry, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *sums], ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    return run


def _assign(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, rows, x in _by_part(batch, books.shape[2]):
                code[rows], error[rows] = _nearest(x, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["part", "piece", "weight", "entry", "error"])

    return run


def _moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry that is used becomes the floor of its parts' mean."""
    width = books.shape[2]
    names = [f"s{i}" for i in range(width)]
    partial = distinct.mapInArrow(_sums(books), "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names))
    out = books.copy()
    # one row for each entry of each position: parameters fix their number
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():
        out[row.part, row.entry] = [row[s] // row.n for s in names]
    return out


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each kept row of (vec_id, embedding, label)."""
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: at most 256 entries")
    spark = vectors.sparkSession
    rows = pick(vectors, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        # a key that is never null
        F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label"),
    )
    sound = rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = F.size("embedding")
    common = sound.filter((size > 0) & (size % parts == 0)).groupBy(size.alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], _RESULT)
    dim, n = common.dim, common["count"]
    width = dim // parts
    plain = sound.filter(size == dim).withColumn("row", F.monotonically_increasing_id())
    kept = settle(plain.mapInArrow(_integers(scale), "vec_id long, embedding binary, label string, row long"), "vectors")

    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    books = np.stack([_unpacked(r.embedding).reshape(parts, width) for r in first]).transpose(1, 0, 2)
    cut = kept.select("row", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "embedding")
    cut = cut.select("row", "part", F.expr(f"substring(embedding, part * {4 * width} + 1, {4 * width})").alias("piece"))
    distinct = settle(cut.groupBy("part", "piece").agg(F.count(F.lit(1)).alias("weight")), "parts")
    for _ in range(rounds):
        books = _moved(distinct, books)

    coded = settle(distinct.mapInArrow(_assign(books), "part int, piece binary, weight long, entry long, error long"), "part-codes")
    joined = join_counted(cut, coded, ["part", "piece"], "weight", n * parts)
    # eight codes make a 64-bit word; words are put together by a bitwise or, which starts inside each task
    here = joined.select("row", "part", "entry", "error", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("string").alias("label"))
    own = kept.select("row", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("error"), "vec_id", "label")
    words = range(-(-parts // 8))
    bits = [F.bit_or(F.when(F.floor(F.col("part") / 8) == w, F.expr("shiftleft(entry, 8 * (7 - part % 8))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    whole = here.unionByName(own).groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("error").alias("error"), *bits)
    code = F.substring(F.concat(*[F.lpad(F.lower(F.hex(f"w{w}")), 16, "0") for w in words]), 1, 2 * parts)
    found = settle(whole.select("vec_id", "label", code.alias("code"), "error"), "vector-codes")

    labels = settle(found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight")), "label-errors")
    told = ",".join(map(str, books.ravel().tolist()))
    digest = F.lit(hashlib.sha256(told.encode()).hexdigest())
    return join_counted(found, labels, ["label"], "weight", n).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
