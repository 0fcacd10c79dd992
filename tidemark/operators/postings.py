"""A search index that is kept: positions of trigrams and of CJK characters, sessions' texts, and versions.

A folder holds segments and states.  A refresh writes the changed sessions'
texts and postings as one new segment, then a state, which says for every
session the segment that holds it, and last the file ``current``, which replaces
the one before by a rename.  What a changed session left in older segments is
no longer named by the state and so is not found; ``compact`` drops it.  Readers
open a version once and see nothing else, whatever is written meanwhile.  A
folder of another format reads as empty, so the next refresh builds it anew.

The texts of a segment are numbered.  A row of postings holds the places of one
token in a block of texts, packed; a block is closed after ``BLOCK`` places, so
rows grow with blocks and tokens, not with texts and their tokens.  The task that
reads a block writes its postings, sorted by token: nothing is shuffled, a token
is read by ranges of the files, and one that very many sessions hold lies in many
rows of bounded size.  Trigrams with a space or a CJK character are not kept: no
query asks for them (``search.access_path``).  A phrase is found by positions,
ranks come from postings and the state alone, and with a limit only the texts of
the rows that stay are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.operators import scratch
from tidemark.operators.index import KEY, RETENTION, evict, stale
from tidemark.operators.search import B, CJK, K1, LEAST_IDF, TextQuery, access_path, literal_rank, top

#: Goes up whenever the layout changes.
FORMAT = 2
#: Largest limit for which the rows that stay are named to the reader of texts.
NAMED = 1000
#: Places after which a block of postings is closed; a text lies in one block.
BLOCK = 2_000_000

DOCS = "provider string, session_id string, segment string, number long, title string, content string, grams long, words long"
STATE = "provider string, session_id string, segment string, number long, signature string, last_seen timestamp, updated_at {at}, created_at {at}, grams long, words long"
# of a token in a block: the texts, how many places each has, the first of them and the steps between the others; ``kinds`` gives the widths
POSTINGS = "token long, segment string, block long, kinds string, texts binary, counts binary, firsts binary, steps binary"
PACKED = ("texts", "counts", "firsts", "steps")
FIELDS = ("title", "content")
# letters and digits; a word ends between two CJK characters as well
_OTHER = r"[^\p{L}\p{N}\p{Co} ]"


def fold(text: Column) -> Column:
    """Text so that what differs only in case is equal, character by character as patterns without case see it."""
    return F.translate(F.lower(F.upper(F.translate(text, "İẞ", "iß"))), "ς", "σ")


def gram_codes(text: str) -> np.ndarray:
    """A number for each three neighbouring characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _starts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of text whose words are set apart by spaces: where words begin, and which characters are letters and CJK."""
    letter, cjk = points != 32, (points >= ord(CJK[0])) & (points <= ord(CJK[-1]))
    starts = letter.copy()
    starts[1:] &= ~letter[:-1] | (cjk[1:] & cjk[:-1])
    return starts, letter, cjk


def _word_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code point, place among all words) of the words that are one CJK character."""
    points = _points(text)
    starts, letter, cjk = _starts(points)
    alone = starts & cjk
    alone[:-1] &= ~letter[1:] | cjk[1:]
    return points[alone], (np.cumsum(starts) - 1)[alone]


def _asked_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, place) of the trigrams without a space and without a CJK character."""
    code = gram_codes(text)
    points = _points(text)
    no = (points == 32) | ((points >= ord(CJK[0])) & (points <= ord(CJK[-1])))
    at = np.flatnonzero(~(no[:-2] | no[1:-1] | no[2:])) if len(code) else np.zeros(0, np.int64)
    return code[at], at


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Pieces of ``values`` between ``cuts``."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _packed(segment: str, block: int, codes: list[np.ndarray], owns: list[int], places: list[np.ndarray]) -> pa.RecordBatch:
    """The rows of a block: ``owns`` is, for each text, twice its number in the block plus its field."""
    code, at = np.concatenate(codes), np.concatenate(places).astype(np.int64)
    own = np.repeat(np.array(owns, np.int64), [len(c) for c in codes])
    order = np.argsort(code, kind="stable")
    code, own, at = code[order], own[order], at[order]
    other = np.concatenate(([True], code[1:] != code[:-1]))
    first = other | np.concatenate(([True], own[1:] != own[:-1]))
    begins, heads = np.flatnonzero(other), np.flatnonzero(first)
    tokens = np.append(np.searchsorted(heads, begins), len(heads))
    more = np.append(begins, len(code)) - tokens  # places that are not the first of their text
    steps = np.diff(at, prepend=0)[~first]
    arrays = [_narrow(v) for v in (own[heads], np.diff(np.append(heads, len(code))), at[heads], steps)]
    n = len(begins)
    kinds = "".join(str(v.itemsize) for v in arrays)
    columns = [pa.array(code[begins]), pa.array([segment] * n), pa.array([block] * n, pa.int64()), pa.array([kinds] * n), *[_binary(v, more if i == 3 else tokens) for i, v in enumerate(arrays)]]
    return pa.RecordBatch.from_arrays(columns, ["token", "segment", "block", "kinds", *PACKED])


def _unpacked(kinds: str, *packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of each place of a row."""
    own, count, first, step = (np.frombuffer(raw, f"<u{kind}").astype(np.int64) for kind, raw in zip(kinds, packed, strict=True))
    at = np.empty(int(count.sum()), np.int64)
    heads = np.cumsum(count) - count
    rest = np.ones(len(at), bool)
    rest[heads] = False
    at[rest] = step
    at[heads] = 0
    run = np.cumsum(at)
    return np.repeat(own, count), run + np.repeat(first - run[heads], count)


def _positions(words: bool, limit: int):
    """Rows (segment, number, texts of the fields) to packed postings."""
    cut = _word_codes if words else _asked_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, owns, places, size, block, last = [], [], [], 0, 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                segment, number = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if size and (size >= limit or segment != last or not 0 <= number - block < 1 << 30):
                    yield _packed(last, block, codes, owns, places)
                    codes, owns, places, size = [], [], [], 0
                for k in range(len(FIELDS)):
                    code, at = cut(batch.column(2 + k)[row].as_py())
                    if len(code):
                        block, last = (block, last) if size else (number, segment)
                        codes.append(code)
                        owns.append(2 * (number - block) + k)
                        places.append(at)
                        size += len(code)
        if size:
            yield _packed(last, block, codes, owns, places)

    return run


def _letters(text: Column) -> Column:
    """Text with a space for every character that is in no word."""
    return F.regexp_replace(text, _OTHER, " ")


def postings_of(docs: DataFrame, words: bool, limit: int = BLOCK) -> DataFrame:
    """``POSTINGS`` of titles and contents: where each token stands; by characters, or by words."""
    # without a character of several bytes there is no CJK word
    texts = [F.when(F.octet_length(c) > F.length(c), _letters(F.col(c))).otherwise("") if words else fold(F.col(c)) for c in FIELDS]
    return docs.select("segment", "number", *[t.alias(c) for t, c in zip(texts, FIELDS, strict=True)]).mapInArrow(_positions(words, limit), POSTINGS)


def _by_session(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows to (token, segment, number, field, at)."""
    for batch in batches:
        for token, segment, block, kinds, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, at = _unpacked(kinds, *packed)
            heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            n, cuts = len(heads), pa.array(np.append(heads, len(own)).astype(np.int32))
            columns = [pa.array([token] * n, pa.int64()), pa.array([segment] * n), pa.array(block + own[heads] // 2), pa.array((own[heads] % 2).astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "segment", "number", "field", "at"])


@dataclass(frozen=True)
class Snapshot:
    """One version of an index; every table it gives is that version's."""

    spark: SparkSession = field(compare=False)
    root: str
    version: int = 0
    segments: tuple[str, ...] = ()
    n: int = 0
    grams: int = 0
    words: int = 0
    at: str = "timestamp"

    def _read(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        return self._read(STATE.format(at=self.at), *([f"{self.root}/state/{self.version:08d}"] if self.version else []))

    def packed(self, name: str) -> DataFrame:
        """``docs``, ``grams`` or ``words`` of all segments as they are stored, with what the state no longer names."""
        return self._read(DOCS if name == "docs" else POSTINGS, *[f"{self.root}/{name}/{s}" for s in self.segments])

    def table(self, name: str) -> DataFrame:
        """As ``packed``, but postings by session: (key, segment, token, field, at)."""
        if name == "docs":
            return self.packed(name)
        rows = self.packed(name).mapInArrow(_by_session, "token long, segment string, number long, field int, at array<int>")
        return rows.join(self.packed("docs").select(*KEY, "segment", "number"), ["segment", "number"]).select("token", *KEY, "segment", "field", "at")

    def live(self, name: str) -> DataFrame:
        return self.table(name).join(self.state().select(*KEY, "segment"), [*KEY, "segment"], "left_semi")

    def corpus(self) -> DataFrame:
        """(key, title, content, updated_at, created_at) of every session."""
        return self.table("docs").drop("number", "grams", "words").join(self.state().select(*KEY, "segment", "updated_at", "created_at"), [*KEY, "segment"]).drop("segment")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> Snapshot:
    """The version that ``current`` names; an empty one where there is none of this format."""
    root = root.rstrip("/")
    at, fs = _file(spark, f"{root}/current")
    if not fs.exists(at):
        return Snapshot(spark, root)
    stream = fs.open(at)
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    if told.pop("format", None) != FORMAT:
        return Snapshot(spark, root)
    return Snapshot(spark, root, **(told | {"segments": tuple(told["segments"])}))


def _publish(snapshot: Snapshot) -> Snapshot:
    """Make a version the current one: a file is written whole, then renamed over the one before."""
    told = {"format": FORMAT} | {k: getattr(snapshot, k) for k in ("version", "segments", "n", "grams", "words", "at")}
    spark, jvm = snapshot.spark, snapshot.spark._jvm
    new, fs = _file(spark, f"{snapshot.root}/.current-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(json.dumps(told).encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target, _ = _file(spark, f"{snapshot.root}/current")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, target, how)
    return snapshot


def _next_version(old: Snapshot) -> int:
    """A version above the current one and above any that another format or a stopped run left."""
    at, fs = _file(old.spark, f"{old.root}/state")
    found = [int(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
    return max([old.version, *found]) + 1


def _write_segment(docs: DataFrame, root: str, segment: str, parts: int) -> DataFrame:
    """Texts and both kinds of postings of a segment, sorted; the texts read back."""
    docs = docs.withColumn("segment", F.lit(segment)).select("provider", "session_id", "segment", "title", "content", *[_size(w).alias(n) for n, w in (("grams", False), ("words", True))])
    # written first: dealing by ranges looks at its input twice, and texts may be dear to make
    docs = scratch.settle(docs, "texts")
    dealt = docs.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).withColumn("number", F.monotonically_increasing_id())
    dealt.select([c.split()[0] for c in DOCS.split(", ")]).write.parquet(f"{root}/docs/{segment}")
    docs = docs.sparkSession.read.schema(DOCS).parquet(f"{root}/docs/{segment}")
    for name, words in (("grams", False), ("words", True)):
        postings_of(docs, words).sortWithinPartitions("token", "block").write.parquet(f"{root}/{name}/{segment}")
    return docs


@F.pandas_udf(LongType())
def _words(letters: pd.Series) -> pd.Series:
    return letters.map(lambda x: int(_starts(_points(x))[0].sum()), na_action="ignore")


def _size(words: bool) -> Column:
    count = (lambda c: _words(_letters(c))) if words else (lambda c: F.greatest(F.length(fold(c)) - 2, F.lit(0)))
    return reduce(add, [count(F.col(c)) for c in FIELDS]).cast("long")


def _kept(old: Snapshot, state: DataFrame, version: int, segments: tuple[str, ...]) -> Snapshot:
    """Write a state and make it current."""
    path = f"{old.root}/state/{version:08d}"
    state.write.parquet(path)
    state = old.spark.read.schema(state.schema).parquet(path)
    n, grams, words, used = state.agg(F.count(F.lit(1)), F.coalesce(F.sum("grams"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.collect_set("segment")).first()
    at = state.schema["updated_at"].dataType.simpleString()
    # a segment of which nothing is left is not read any more
    return _publish(Snapshot(old.spark, old.root, version, tuple(s for s in segments if s in set(used)), n, grams, words, at))


def _once(seen: DataFrame) -> DataFrame:
    return seen.groupBy(*KEY).agg(F.max(F.struct("signature", "title", "updated_at", "created_at")).alias("s")).select(*KEY, "s.*")


def _standing(old: Snapshot, seen: DataFrame, now: Column, rebuild: bool, days: int) -> DataFrame:
    """What is kept of the old state: not what is out of date, nor, with ``rebuild``, anything of the providers seen."""
    if not old.version:
        return seen.sparkSession.createDataFrame([], STATE.format(at=seen.schema["updated_at"].dataType.simpleString()))
    state = evict(old.state(), now, days)
    return state.join(seen.select("provider").distinct(), "provider", "left_anti").select(*state.columns) if rebuild else state


def due(spark: SparkSession, root: str, seen: DataFrame, now: Column, rebuild: bool = False, days: int = RETENTION) -> DataFrame:
    """The keys of ``seen`` that ``refresh`` would read."""
    seen = _once(seen)
    return stale(_standing(current(spark, root), seen, now, rebuild, days), seen).select(*KEY)


def refresh(spark: SparkSession, root: str, seen: DataFrame, corpus: DataFrame, now: Column, rebuild: bool = False, days: int = RETENTION, parts: int | None = None) -> Snapshot:
    """The index after a scan that saw ``seen`` (key, signature, title, updated_at, created_at); ``corpus`` gives key and content.

    Only sessions that are new or whose signature changed are read and written;
    one whose text cannot be read (null or absent) stays as it was and is tried
    again.  Seen sessions get ``now`` as last seen; those unseen for more than
    ``days`` go.  With ``rebuild`` all sessions of the providers seen are taken
    anew.  Repeated keys count once, by the greatest values."""
    old = current(spark, root)
    # numbers and names only; read several times below
    seen = scratch.settle(_once(seen), "seen")
    state = _standing(old, seen, now, rebuild, days)
    version = _next_version(old)
    segment = f"{version:08d}-{uuid.uuid4().hex[:8]}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = stale(state, seen)
    text = corpus.groupBy(*KEY).agg(F.max("content").alias("content")).filter(F.col("content").isNotNull())
    docs = _write_segment(todo.select(*KEY, F.coalesce("title", F.lit("")).alias("title")).join(text, KEY), old.root, segment, parts)
    fresh = docs.select(*KEY, "segment", "number", "grams", "words").join(seen.drop("title"), KEY).withColumn("last_seen", now)
    kept = state.join(docs.select(*KEY), KEY, "left_anti").join(seen.select(*KEY, F.lit(True).alias("here")), KEY, "left")
    kept = kept.withColumn("last_seen", F.when(F.col("here"), now).otherwise(F.col("last_seen"))).drop("here")
    return _kept(old, kept.unionByName(fresh.select(*kept.columns)), version, (*old.segments, segment))


def compact(spark: SparkSession, root: str, parts: int | None = None) -> Snapshot:
    """The same sessions in one segment; what older segments hold of changed ones is dropped."""
    old = current(spark, root)
    version = _next_version(old)
    segment = f"{version:08d}-{uuid.uuid4().hex[:8]}"
    docs = _write_segment(old.live("docs").select(*KEY, "title", "content"), old.root, segment, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _kept(old, old.state().drop("segment", "number").join(docs.select(*KEY, "segment", "number"), KEY), version, (segment,))


def clear(spark: SparkSession, root: str, provider: str) -> Snapshot:
    """Without a provider's sessions."""
    old = current(spark, root)
    return _kept(old, old.state().filter(~F.col("provider").eqNullSafe(F.lit(provider))), _next_version(old), old.segments)


def _phrase(spark: SparkSession, literal: str, words: bool) -> list[tuple[int, int]]:
    """(offset, token) pairs that together stand for a literal: each CJK character, or trigrams that cover it."""
    if words:
        return [(i, ord(c)) for i, c in enumerate(literal)]
    folded = spark.range(1).select(fold(F.lit(literal))).first()[0]
    codes = gram_codes(folded).tolist()
    return [(i, codes[i]) for i in dict.fromkeys([*range(0, len(codes), 3), len(codes) - 1])]


def _phrases_in(phrases: list[list[tuple[int, int]]]):
    """The rows of a block to (segment, number, tf0, tf1, ...) of the texts that hold one of the phrases."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        held = {}
        for i, token in enumerate(rows["token"]):
            own, at = _unpacked(rows["kinds"][i], *(rows[c][i] for c in PACKED))
            held[token] = (own << 32) | at
        none, block = np.zeros(0, np.int64), rows["block"][0]
        found = [reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), [held.get(t, none) - o for o, t in p]) >> 33 for p in phrases]
        texts = np.unique(np.concatenate(found))
        tf = [np.bincount(np.searchsorted(texts, f), minlength=len(texts)).astype(np.float64) for f in found]
        return pa.table({"segment": pa.array(rows["segment"][:1] * len(texts), pa.string()), "number": texts + block, **{f"tf{i}": t for i, t in enumerate(tf)}})

    return run


def phrase_counts(snapshot: Snapshot, query: TextQuery, words: bool) -> DataFrame:
    """(key, segment, updated_at, created_at, grams, words, tf0, tf1, ...): how often each literal occurs in a session of the version, for sessions that hold one."""
    phrases = [_phrase(snapshot.spark, x, words) for x in query.literals]
    tokens = sorted({t for p in phrases for _, t in p})
    hits = snapshot.packed("words" if words else "grams").filter(F.col("token").isin(tokens))
    schema = ", ".join(["segment string, number long", *[f"tf{i} double" for i in range(len(phrases))]])
    found = hits.groupBy("segment", "block").applyInArrow(_phrases_in(phrases), schema)
    state = snapshot.state().select(*KEY, "segment", "number", "updated_at", "created_at", "grams", "words")
    return state.join(found, ["segment", "number"]).drop("number")


def _ranked(snapshot: Snapshot, query: TextQuery, words: bool) -> DataFrame:
    """(key, segment, updated_at, created_at, rank) of sessions that hold every literal, by BM25 among all sessions."""
    counts = phrase_counts(snapshot, query, words).withColumn("len", F.col("words" if words else "grams").cast("double"))
    rows = scratch.settle(counts.drop("grams", "words"), "phrase-counts")
    held = rows.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query.literals))]).first()
    mean = (snapshot.words if words else snapshot.grams) / max(snapshot.n, 1)
    rank = F.lit(0.0)
    for i, df in enumerate(held):
        tf, idf = F.col(f"tf{i}"), max(float(np.log((snapshot.n - df + 0.5) / (df + 0.5))), LEAST_IDF)
        rank = rank + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    every = reduce(and_, [F.col(f"tf{i}") > 0 for i in range(len(held))])
    return rows.filter(every).select(*KEY, "segment", "updated_at", "created_at", F.round(rank, 6).alias("rank"))


def _order() -> list[Column]:
    return [F.desc("rank"), F.desc("updated_at"), F.desc("created_at"), F.asc("provider"), F.asc("session_id")]


def _with_texts(snapshot: Snapshot, found: DataFrame, named: bool) -> DataFrame:
    """``found`` with title and content; few rows are named to the reader, so files and row groups without them are skipped."""
    docs = snapshot.table("docs").drop("number", "grams", "words")
    if named:
        found = scratch.settle(found, "found")
        ids = found.select(*KEY, "segment").collect()
        for i, c in enumerate((*KEY, "segment")):
            docs = docs.filter(F.col(c).isin(sorted({r[i] for r in ids})))
        found = F.broadcast(found)
    return docs.join(found, [*KEY, "segment"]).drop("segment")


def search(snapshot: Snapshot, query: TextQuery, scope: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(key, title, content, updated_at, created_at, rank, snippet) of sessions that match, as ``search.search`` over ``snapshot.corpus()``.

    Trigrams and CJK words are answered from postings, other queries by a scan of
    the index's texts.  A row of CJK words whose literals only stand apart
    (marks between them) counts for the ranks but is no match."""
    path = access_path(query)
    if not query.literals or not snapshot.n:
        found = snapshot.corpus().limit(0).withColumn("rank", F.lit(0.0))
    elif path == "scan":
        found = literal_rank(snapshot.corpus(), query)
    else:
        words = path == "words"
        found = _ranked(snapshot, query, words)
        if scope is not None:
            found = found.join(scope.select(*KEY).distinct(), KEY, "left_semi")
        few = limit is not None and limit <= NAMED and not words
        found = _with_texts(snapshot, top(found, limit, *_order()) if few else found, few)
        if words:
            found = found.filter(query.matches(F.col("title"), F.col("content")))
        scope = None
    if scope is not None:
        found = found.join(scope.select(*KEY).distinct(), KEY, "left_semi")
    found = found.select(*KEY, "title", "content", "updated_at", "created_at", "rank")
    if limit is not None:
        found = top(found, limit, *_order())
    shown = query.best_snippet(F.col("title"), F.col("content")) if query.literals else F.lit(None).cast("string")
    return found.withColumn("snippet", F.coalesce(shown, F.col("title")))
