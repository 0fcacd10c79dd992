"""Alignment of two tokenizers over a corpus by a dictionary of token groups.

Every text is encoded by both tokenizers; byte offsets where a token of each
ends cut the tokens into groups.  A document is kept as its distinct groups with
their counts.  Distinct groups of the corpus are interned; links (overlapping
pairs of tokens) are expanded once for each of them and multiplied by how often
it occurs, which gives the count of every id pair.  What a group's links are worth
is then joined back by group: groups that very many documents share are
broadcast, the others shuffled (:func:`tidemark.llm.common.join_counted`).

Defined results: null or empty texts, and those that a tokenizer does not give
back byte for byte, have no tokens: zeros and an empty digest.  A text of any
length is encoded whole; strings of special tokens inside a text are plain text.
Rows with null or repeated ids are documents like any other; pairs that tie for
an id's highest count are all best.  An empty table gives an empty table; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, pick, settle

#: The pattern of the byte-level tokenizer that cuts texts before its merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of texts that are encoded together, groups in a batch that leaves a task, and keys of one token a side that a task keeps.
TEXTS, BATCH, CACHE_PAIRS = 1 << 18, 1 << 15, 1 << 18

_DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())])))])
_DOCS_SQL = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<struct<key:string,n:long>>"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printing bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """The byte-level tokenizer of a tokenizers file, by the ranks that its vocabulary holds."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letter = byte_letters()
        special = {t["id"] for t in told["added_tokens"]}
        ranks = {bytes(letter[c] for c in entry): i for entry, i in told["model"]["vocab"].items() if i not in special}
        self.coder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """A sentencepiece model; pieces of the kind <0xHH> are bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


_loaded: dict[tuple[str, str], tuple] = {}


def tokenizers(a: str, b: str) -> tuple:
    """Both tokenizers with the lengths and names of their ids, once for each worker."""
    if (a, b) not in _loaded:
        both = []
        for coder in (ByteTokens(a), PieceTokens(b)):
            both.append((coder, np.array([len(x) for x in coder.bytes], np.int64), [str(i) for i in range(len(coder.bytes))]))
        _loaded[a, b] = tuple(both)
    return _loaded[a, b]


def _edges(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin and end, as token numbers of either side."""
    place = np.searchsorted(ends_b, ends_a)
    place[place == len(ends_b)] = 0
    here = np.flatnonzero(ends_b[place] == ends_a)
    return np.concatenate(([0], here + 1)), np.concatenate(([0], place[here] + 1))


class Namer:
    """Keys ``a1,a2|b1`` of a text's groups; those of one token a side are put together once."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.pairs: dict[int, str] = {}

    def _pair(self, code: int) -> str:
        found = self.pairs.get(code)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[code] = f"{code >> 32}|{code & 0xFFFFFFFF}"
        return found

    def keys(self, ids_a: list[int], ids_b: list[int]) -> list[str]:
        x, y = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        at_a, at_b = _edges(np.cumsum(self.a[1][x]), np.cumsum(self.b[1][y]))
        lone = (np.diff(at_a) == 1) & (np.diff(at_b) == 1)
        out = np.empty(len(lone), object)
        out[lone] = list(map(self._pair, ((x[at_a[:-1][lone]] << 32) | y[at_b[:-1][lone]]).tolist()))
        told_a, told_b = self.a[2], self.b[2]
        many = np.flatnonzero(~lone)
        for i, lo, hi, low, high in zip(many.tolist(), at_a[many].tolist(), at_a[many + 1].tolist(), at_b[many].tolist(), at_b[many + 1].tolist(), strict=True):
            out[i] = f"{','.join([told_a[k] for k in ids_a[lo:hi]])}|{','.join([told_b[k] for k in ids_b[low:high]])}"
        return out.tolist()


def _groups(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        namer = Namer(a, b)
        rows: list[tuple] = []
        names: list[str] = []
        counts: list[int] = []
        ends = [0]

        def full() -> pa.RecordBatch:
            groups = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["key", "n"])
            plain = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOCS, strict=False)]
            out = pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), groups)], schema=_DOCS)
            rows.clear(), names.clear(), counts.clear()
            ends[1:] = []
            return out

        def add(row: int, doc_id: int | None, text: str, ids_a: list[int], ids_b: list[int]) -> None:
            raw = b" " + text.encode()
            if not text or b"".join([a[0].bytes[i] for i in ids_a]) != raw or b"".join([b[0].bytes[i] for i in ids_b]) != raw:
                rows.append((row, doc_id, 0, 0, 0, ""))
            else:
                keys = namer.keys(ids_a, ids_b)
                rows.append((row, doc_id, len(ids_a), len(ids_b), len(keys), hashlib.sha256(";".join(keys).encode()).hexdigest()))
                found = Counter(keys)
                names.extend(found)
                counts.extend(found.values())
            ends.append(len(names))

        for batch in batches:
            row, doc_id = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # texts are made Python strings a few at a time
            size = np.cumsum(np.fromiter(((n or 0) for n in pc.binary_length(batch.column(2)).to_pylist()), np.int64, batch.num_rows))
            at = 0
            while at < batch.num_rows:
                base = int(size[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(size, base + TEXTS, "right")))
                texts = [t or "" for t in batch.column(2).slice(at, upto - at).to_pylist()]
                for r in zip(row[at:upto], doc_id[at:upto], texts, a[0].encode(texts), b[0].encode(texts), strict=True):
                    add(*r)
                    if len(names) > BATCH:
                        yield full()
                at = upto
        if rows:
            yield full()

    return run


def group_links(ids_a: list[int], ids_b: list[int], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Counter:
    """How often each id pair overlaps inside a group: both sides are walked once."""
    ends_a, ends_b = np.cumsum(sizes_a[ids_a]).tolist(), np.cumsum(sizes_b[ids_b]).tolist()
    found: Counter = Counter()
    i = j = 0
    while i < len(ids_a) and j < len(ids_b):
        found[ids_a[i], ids_b[j]] += 1
        step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
        i += step_a
        j += step_b
    return found


def _expand(path_a: str, path_b: str):
    names = ["group", "a", "b", "n", "freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        for batch in batches:
            rows: list[tuple] = []
            for group, key, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = ([int(i) for i in side.split(",")] for side in key.split("|"))
                rows += [(group, x, y, n, freq) for (x, y), n in group_links(left, right, a[1], b[1]).items()]
                if len(rows) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, weight): the links of an id pair in the corpus, and in how many distinct groups it occurs."""
    return links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("freq")).alias("count"), F.count(F.lit(1)).alias("weight"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of (doc_id, text).

    The paths name a byte-level tokenizers file and a sentencepiece model that every executor has."""
    plain = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = settle(plain.mapInArrow(_groups(path_a, path_b), _DOCS_SQL), "aligned", codec="zstd")
    held = coded.select("row", F.explode("groups").alias("g")).select("row", "g.key", F.col("g.n").alias("times"))

    counted = held.groupBy("key").agg(F.sum("times").alias("freq"), F.count(F.lit(1)).alias("weight"))
    groups = settle(counted.withColumn("group", F.monotonically_increasing_id()), "groups")
    links = settle(groups.select("group", "key", "freq").mapInArrow(_expand(path_a, path_b), "group long, a long, b long, n long, freq long"), "links")
    pairs = settle(pair_counts(links), "pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    ranked = settle(pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"), "weight"), "ranked-pairs")
    each = join_counted(links, ranked, ["a", "b"], "weight", _total(ranked)).groupBy("group")
    worth = each.agg(F.sum("n").alias("n_links"), F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    worth = settle(groups.select("group", "key", "weight").join(worth, "group").drop("group"), "group-worth")

    sums = ["n_links", "n_best", "count_sum"]
    of_docs = join_counted(held, worth, ["key"], "weight", _total(worth)).select("row", *[(F.col(c) * F.col("times")).alias(c) for c in sums])
    own = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    nothing = coded.select("row", *[F.lit(0).cast("long").alias(c) for c in sums], *own)
    rows = nothing.unionByName(of_docs, allowMissingColumns=True).groupBy("row").agg(*[F.max(c).alias(c) for c in own], *[F.sum(c).alias(c) for c in sums])
    return rows.select("doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256")


def _total(side: DataFrame) -> int:
    return side.agg(F.sum("weight")).first()[0] or 0
