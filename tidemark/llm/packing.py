"""Concatenate and cut.

Pass one tokenises every document once and writes its ids with the running
token offset inside its partition.  The partition totals are prefix-summed into
a global offset for each partition (one number for each task of pass one), and
pass two cuts the one long stream into windows of ``window`` ids: a document
that crosses window edges gives one boundary record for each window it touches.
Only the very last window can be short.

Words are cut at ASCII white space and tokenised once for each distinct word of
a task; white space never joins two pieces of this vocabulary.

Defined results: null text is empty and gives the end id alone; rows with null
or repeated ids are packed like any other; a text of any length is encoded whole
and cut where windows end; documents have no order but that of the table's files;
an empty table gives an empty table; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, released, settle

END = 2
#: Words a task keeps encoded; the cache is emptied beyond, which costs time only.
CACHE_WORDS = 1_000_000

#: Texts that are taken together, and words whose ids are gathered at once.
TEXTS, GATHER = 128, 1 << 18

_CODED = "part int, doc_id long, start long, n long, ids binary"
_CODED_SCHEMA = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _byte_marks() -> dict[int, int]:
    """The byte-level alphabet of the pre-tokenizer: bytes that print stand for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return dict(zip((b for b in range(256) if b not in plain), itertools.count(256), strict=False))


_MARKS = _byte_marks()
#: What the pre-tokenizer keeps together, for lower-cased ASCII without white space.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_TAIL = ".,;:!?"


class WordEncoder:
    """Ids of whole texts, by words; each distinct word is encoded once.

    Words are numbered as they come; number n has the ids
    ``store[first[n] : first[n + 1]]``, so a block of texts is put together by one
    gather.  Normaliser and pre-tokenizer do nothing but fold case and cut for
    ASCII words and for Latin letters with ``.,;:!?`` behind them: their pieces go
    straight to the tokenizer's model.  Any other word, and any that may hold a
    special token, goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.pieces: dict[str, bytes] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, "<u2")

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            marks = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(_MARKS)
            found = self.pieces[piece] = array("H", [t.id for t in self.model.tokenize(marks)]).tobytes()
        return found

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        stem = word.rstrip(_TAIL)
        if word.isascii():
            if stem.isalpha():
                return self._piece(stem.lower()) + self._piece(word[len(stem) :]) if len(stem) < len(word) else self._piece(stem.lower())
            if not any(special in word for special in self.specials):
                return b"".join(map(self._piece, _PIECES.findall(word.lower())))
        elif stem.isalpha() and max(stem) < "\u0250":
            # a capital may fold into a letter and a mark
            folded = unicodedata.normalize("NFC", stem).lower()
            if folded.isalpha():
                return self._piece(folded) + self._piece(word[len(stem) :]) if len(stem) < len(word) else self._piece(folded)
        return self._whole(word)

    def _learn(self, words: list[str], known: int) -> None:
        coded = [self._word(w) if w else b"" for w in words]
        total, start = known + len(words), int(self.first[known])
        ends = start + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // 2
        if total >= len(self.first):
            self.first = np.resize(self.first, 2 * total)
        if ends[-1] > len(self.store):
            self.store = np.resize(self.store, 2 * int(ends[-1]))
        self.first[known + 1 : total + 1] = ends
        self.store[start : ends[-1]] = np.frombuffer(b"".join(coded), "<u2")

    def _gather(self, numbers: np.ndarray) -> bytes:
        start = self.first[numbers]
        length = self.first[numbers + 1] - start
        before = np.cumsum(length) - length
        return self.store[np.repeat(start - before, length) + np.arange(length.sum())].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit bytes."""
        if len(self.number) > CACHE_WORDS:
            self._empty()
        known = len(self.number)
        split = [_spaced(text).split(" ") for text in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
        fresh = len(self.number) - known
        if fresh:
            self._learn(list(itertools.islice(reversed(self.number), fresh))[::-1], known)
        raw = b"".join(self._gather(numbers[at : at + GATHER]) for at in range(0, len(numbers), GATHER))
        upto = np.concatenate(([0], np.cumsum(self.first[numbers + 1] - self.first[numbers])))
        cuts = (2 * upto[np.concatenate(([0], np.cumsum(sizes)))]).tolist()
        return [raw[lo:hi] for lo, hi in itertools.pairwise(cuts)]


def _spaced(text: str) -> str:
    """Text with a space for each ASCII white space."""
    for c in "\n\t\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return text


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = WordEncoder(path)
        part, start = TaskContext.get().partitionId(), 0
        end = np.array([END], "<u2").tobytes()
        rows: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CODED_SCHEMA)], schema=_CODED_SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                coded = coder.encode([t or "" for t in some.column(1).to_pylist()])
                for doc_id, raw in zip(some.column(0).to_pylist(), coded, strict=True):
                    short = raw + end
                    rows.append((part, doc_id, start, len(short) // 2, short))
                    start += len(short) // 2
                    size += len(short)
                if size > 4 << 20:
                    yield full()
                    rows, size = [], 0
        if rows:
            yield full()

    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _cut(window: int, with_ids: bool):
    fields = [*[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, at, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                edges = [at, *range((at // window + 1) * window, at + n, window), at + n]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    piece = ids[lo - at : hi - at]
                    rows.append((doc_id, lo - at, hi - lo, zlib.crc32(piece.tobytes()), n, lo // window, lo % window, piece.astype(np.int32) if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and, on request, the ids.

    ``tokenizer`` is the path of a tokenizers file that every executor has; its
    ids must fit 16 bits (checked)."""
    from tokenizers import Tokenizer

    if Tokenizer.from_file(tokenizer).get_vocab_size() > 65536:
        raise ValueError("ids must fit 16 bits")
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    coded = settle(plain.mapInArrow(released(_encode(tokenizer)), _CODED), "coded")
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row for each task of pass one, a list that the driver's scheduler holds as well
    stream = coded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    return stream.mapInArrow(released(_cut(window, with_ids)), _PIECE if with_ids else _PIECE.rpartition(",")[0])
