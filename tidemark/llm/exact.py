"""Exact dedup against a store of historical digests behind minimal perfect hashes.

Digests are SHA-256 of the text with every white-space run replaced by one
space.  Distinct historical digests are dealt to shards by their leading bytes;
each shard gets a minimal perfect hash (levels of collision-free bits, the slot
is the rank of the bit) whose slots hold the full digest, the winner's locator
and the number of rows.  New digests are looked up shard by shard; a slot
counts only if all 32 bytes agree.  Members join the historical winner's group,
nonmembers are grouped on their own.

The winner of a group is the smallest (doc_id, row) over both sides, so the
cut between history and new rows never changes the answer.

Defined results: null text counts as empty; a null id sorts after all others;
of rows that repeat an id and a text exactly one is kept; texts of any length are
digested whole; an empty table gives an empty table; extra columns, whatever
their names, are ignored (``keep_distinct`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SALTS, SPACE, columns_of, discard, pick, settle, sized
from tidemark.llm.tokens import mix

#: Digests of a shard (32 bytes of digest and 32 of locator each).
SHARD_DIGESTS = 100_000
#: Bits for each key of a level; more bits, fewer levels.
GAMMA = 2.0


def normalised_digest(text) -> F.Column:
    """SHA-256, as 32 bytes, of the text with white-space runs made one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests: ``slots`` maps members
    one to one onto 0..n-1 and strangers anywhere (or to -1)."""

    def __init__(self, digests: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = np.arange(len(digests))
        words = digests.view("<u8").reshape(-1, 4)
        while len(left):
            size = max(64, int(GAMMA * len(left)) + 1)
            at = self._place(words[left], len(self.levels), size)
            hits = np.bincount(at, minlength=size)
            bits = hits == 1
            self.levels.append(bits)
            left = left[~bits[at]]
        self._rank()

    def _rank(self) -> None:
        base, self.ranks = 0, []
        for bits in self.levels:
            self.ranks.append(np.cumsum(bits) - 1 + base)
            base += int(bits.sum())

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        return (mix(words[:, 1] ^ mix(words[:, 2] + seed)) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        words = digests.view("<u8").reshape(-1, 4)
        out = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(words[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def dumps(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def loads(cls, raw: bytes) -> PerfectHash:
        self = cls.__new__(cls)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, n, 8)
        self.levels, at = [], 8 * (n + 1)
        for size in sizes.tolist():
            packed = np.frombuffer(raw, np.uint8, -(-size // 8), at)
            self.levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        self._rank()
        return self


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    chunks = [c.cast(pa.binary(32)) for c in column.chunks if len(c)]
    flat = [np.frombuffer(c.buffers()[1], np.uint8)[32 * c.offset : 32 * (c.offset + len(c))] for c in chunks]
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint8)).reshape(-1, 32).copy()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


_STORE = "shard int, hash binary, digests binary, locators binary"


def _build(table: pa.Table) -> pa.Table:
    digests = _digests(table.column("digest"))
    ph = PerfectHash(digests)
    slot = ph.slots(digests)
    kept = np.empty_like(digests)
    kept[slot] = digests
    locators = np.empty((len(digests), 4), np.int64)
    locators[slot] = np.stack([_numbers(table, c) for c in ("unnamed", "id", "row", "size")], 1)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "hash": [ph.dumps()], "digests": [kept.tobytes()], "locators": [locators.tobytes()]})


_GROUP = "digest binary, unnamed long, id long, row long, size long, historical boolean"


def _look_up(store: pa.Table, fresh: pa.Table) -> pa.Table:
    """One row for each distinct digest of a shard."""
    new = np.stack([_numbers(fresh, c) for c in ("unnamed", "id", "row", "size")], 1) if fresh.num_rows else np.zeros((0, 4), np.int64)
    digests = _digests(fresh.column("digest")) if fresh.num_rows else np.zeros((0, 32), np.uint8)
    if store.num_rows:
        ph = PerfectHash.loads(store.column("hash")[0].as_py())
        kept = np.frombuffer(store.column("digests")[0].as_py(), np.uint8).reshape(-1, 32)
        old = np.frombuffer(store.column("locators")[0].as_py(), np.int64).reshape(-1, 4).copy()
        slot = ph.slots(digests)
        member = slot >= 0
        member[member] = (kept[slot[member]] == digests[member]).all(1)
        at, rows = slot[member], new[member]
        wins = (rows[:, 0] < old[at, 0]) | (rows[:, 0] == old[at, 0]) & ((rows[:, 1] < old[at, 1]) | (rows[:, 1] == old[at, 1]) & (rows[:, 2] < old[at, 2]))
        old[at, 3] += rows[:, 3]
        old[at[wins], :3] = rows[wins, :3]
    else:
        kept, old, member = np.zeros((0, 32), np.uint8), np.zeros((0, 4), np.int64), np.zeros(len(digests), bool)
    every, rows = np.concatenate([kept, digests[~member]]), np.concatenate([old, new[~member]])
    return pa.table({"digest": pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(every), [None, pa.py_buffer(every.tobytes())]).cast(pa.binary()), **{c: rows[:, i] for i, c in enumerate(("unnamed", "id", "row", "size"))}, "historical": np.arange(len(every)) < len(kept)})


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    order = F.min(F.struct("unnamed", "id", "row")).alias("o")
    grouped = rows.groupBy("digest").agg(order, F.count(F.lit(1)).alias("size"))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return grouped.select(shard.alias("shard"), "digest", "o.unnamed", "o.id", "o.row", "size")


def build_store(rows: DataFrame, shards: int) -> DataFrame:
    """The historical store of thin rows (digest, unnamed, id, row)."""
    return settle(_distinct(rows, shards).groupBy("shard").applyInArrow(_build, _STORE), "store")


def look_up(store: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """Groups of all digests of the store and of new thin rows."""
    return store.groupBy("shard").cogroup(_distinct(fresh, shards).groupBy("shard")).applyInArrow(_look_up, _GROUP)


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").isNull().cast("long").alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row", "digest")


def _grouped(rows: DataFrame) -> DataFrame:
    """Settled (doc_id, row, digest, ...) rows with the winner and size of their group."""
    thin = _thin(rows)
    first = thin.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    shards = sized(first[2], SHARD_DIGESTS, least=32)
    cut = ((first[0] or 0) + (first[1] or 0)) // 2
    store = build_store(thin.filter(F.col("id") <= cut), shards)
    groups = look_up(store, thin.filter(F.col("id") > cut), shards)
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    keys = rows.groupBy("digest", salt).agg(F.lit(1).alias("one")).select("digest", "salt").join(groups, "digest")
    named = keys.select("digest", "salt", F.when(F.col("unnamed") == 0, F.col("id")).alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"), "historical")
    return rows.withColumn("salt", salt).join(named, ["digest", "salt"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, historical) of every row of ``docs(doc_id, text)``."""
    thin = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), normalised_digest(F.col("text").cast("string")).alias("digest"))
    out = _grouped(settle(thin, "digests"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``."""
    columns = [f"__c{i}" for i in range(len(docs.columns))]
    doc_id, text = columns_of(docs.columns, "doc_id", "text")
    numbered = settle(docs.toDF(*columns).withColumns({"__row": F.monotonically_increasing_id(), "__digest": normalised_digest(text.cast("string"))}), "numbered")
    kept = _grouped(numbered.select(doc_id.cast("long").alias("doc_id"), F.col("__row").alias("row"), F.col("__digest").alias("digest"))).filter("row = keep_row").select("row")
    return numbered.join(kept, numbered["__row"] == kept["row"], "left_semi").select(*columns).toDF(*docs.columns)
