"""Sharding by histogram sort.

Rows are ordered by (text hash, id, row number), so equal texts are neighbours
and even one text that fills several shards can be cut.  The driver holds one
open key interval for each of the n-1 boundaries and repeats: draw a few probe
keys inside the open intervals, count exactly the bytes below every probe over
all partitions, narrow the intervals.  An interval closes when a probe is
within ``tolerance`` of its target or no key is left inside, so every splitter
ends at the best key there is.  Then rows are exchanged once.

Only bounded samples of keys (about ``PROBES`` for each interval and round) and
their counts reach the driver, whatever the number of rows.

Defined results: null text has size 1 and hashes as its own text; null ids sort
first; repeated rows are told apart by their row number; texts of any length are
one size each and never cut; an empty table gives an
empty table; the other columns of ``docs`` pass through, those named like a
result column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, settle, sized

#: Sampled keys for each open interval and round.
PROBES = 64
#: Rows of a slot block: each shard is numbered in blocks so that no task holds a whole shard.
BLOCK_ROWS = 20_000

Key = tuple[int, int, int]


def _literal(key: Key) -> F.Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(("h", "id", "row"), key, strict=True)])


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))


def _below(order: tuple[np.ndarray, ...], probe: Key) -> int:
    """Position of ``probe`` among lexicographically sorted keys."""
    lo, hi = 0, len(order[0])
    for column, value in zip(order, probe, strict=True):
        part = column[lo:hi]
        lo, hi = lo + int(np.searchsorted(part, value, "left")), lo + int(np.searchsorted(part, value, "right"))
    return lo


def _count(probes: list[Key]):
    """Rows and bytes below each probe, of one partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes = np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
        for batch in batches:
            keys = _keys(batch)
            order = np.lexsort(keys[::-1])
            keys = tuple(k[order] for k in keys)
            total = np.concatenate(([0], np.cumsum(batch.column(3).to_numpy()[order])))
            at = np.array([_below(keys, p) for p in probes], np.int64)
            rows += at
            sizes += total[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(probes))), pa.array(rows), pa.array(sizes)], ["probe", "rows", "bytes"])

    return run


def splitters(thin: DataFrame, shards: int, tolerance: float = 0.0005) -> list[Key]:
    """Keys at which the bytes of ``thin(h, id, row, size)`` fall into ``shards`` near equal parts; rows at or above the i-th key lie right of boundary i."""
    total_rows, total = thin.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    low: Key = (-(2**63), -(2**63), -1)
    high: Key = (2**63 - 1, 2**63 - 1, 2**63 - 1)
    goal = [total * (i + 1) / shards for i in range(shards - 1)]
    slack = tolerance * total / shards
    left = [(low, 0, 0)] * (shards - 1)
    right = [(high, total_rows, total)] * (shards - 1)
    done = [total_rows == 0] * (shards - 1)
    turn = 0
    while not all(done):
        turn += 1
        spans = sorted({(left[i][0], right[i][0], right[i][1] - left[i][1]) for i in range(shards - 1) if not done[i]})
        cond, key = F.lit(False), F.struct("h", "id", "row")
        for lo, hi, rows in spans:
            here = (key > _literal(lo)) & (key < _literal(hi))
            chance = min(1.0, PROBES * (shards if turn == 1 else 1) / max(1, rows))
            drawn = F.lit(True) if chance >= 1 else F.pmod(F.xxhash64("h", "id", "row", F.lit(turn)), F.lit(1 << 40)) < int(chance * (1 << 40))
            cond = cond | (here & drawn)
        probes: list[Key] = sorted({(r[0], r[1], r[2]) for r in thin.filter(cond).select("h", "id", "row").collect()})
        counted = {}
        if probes:
            for r in thin.select("h", "id", "row", "size").mapInArrow(_count(probes), "probe long, rows long, bytes long").groupBy("probe").agg(F.sum("rows"), F.sum("bytes")).collect():
                counted[probes[r[0]]] = (r[1], r[2])
        for i in range(shards - 1):
            if done[i]:
                continue
            small = right[i][1] - left[i][1] <= PROBES * (shards if turn == 1 else 1)
            for p in probes:
                if left[i][0] < p < right[i][0]:
                    if counted[p][1] <= goal[i]:
                        left[i] = max(left[i], (p, *counted[p]))
                    else:
                        right[i] = min(right[i], (p, *counted[p]))
            done[i] = small or min(abs(left[i][2] - goal[i]), abs(right[i][2] - goal[i])) <= slack
    return [min(left[i], right[i], key=lambda x: abs(x[2] - goal[i]))[0] for i in range(shards - 1)]


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.0005) -> DataFrame:
    """All columns of ``docs`` and size, text_crc32, law, shard, slot (gapless in each shard)."""
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    spark, names = docs.sparkSession, docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    doc_id, text = columns_of(names, "doc_id", "text")
    text = text.cast("string")
    numbered = settle(plain.select("*", doc_id.cast("long").isNull().alias("__null"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__size0"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__crc"), F.xxhash64(text).alias("h"), F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("id"), F.monotonically_increasing_id().alias("row")).withColumn("size", F.col("__size0") + 1), "numbered")
    thin = numbered.select("h", "id", "row", "size")
    cuts = splitters(thin, shards, tolerance)
    shard = F.lit(0)
    for cut in sorted(cuts):
        shard = shard + (F.struct("h", "id", "row") >= _literal(cut)).cast("int")
    rows = thin.count()
    blocks = sized(rows, BLOCK_ROWS * shards)
    placed = numbered.withColumns({"__shard": shard, "__block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")})
    counts = placed.groupBy("__shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__shard", "__block").orderBy("h", "id", "row")
    dealt = placed.withColumn("__slot", F.row_number().over(within)).join(F.broadcast(base) if blocks * shards <= 100_000 else base, ["__shard", "__block"])
    kept = [F.col(f"__c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in made]
    return dealt.select(*kept, F.col("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), (F.col("__base") + F.col("__slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
