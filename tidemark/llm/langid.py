"""Language identification by compression.

For each language a bounded sample of its labelled texts becomes a zstandard
raw-content dictionary.  A text belongs to the language whose dictionary
compresses it best; the score is how far the runner-up lies behind, and a text
whose margin is too narrow is rejected.

Only letters count: everything else is made one space and case is folded.  The
text is compressed in blocks of ``BLOCK`` characters, all of them, so that the
dictionary and not the text's own past decides.  Where that leaves less than
``CLEAR`` bits a character between the two best, the text's distinct words are
compressed once more with a fixed filler behind them: alone, a few words would be
stored raw whatever the dictionary.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; texts of any length are compressed whole; of languages that
compress a text equally well the one with more labelled rows is named (and the
row rejected); with no language to learn every row is ``und``; rows with null
ids are learned from and predicted as any other, rows that repeat id and text are
learned from once and predicted each; an empty table gives an empty table; extra
columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, columns_of, held_out, pick, position, released

#: Bound of the training sample: texts of a language that are asked for, and characters kept of them.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 160_000
#: Characters of one sampled text.
SNIPPET = 1_200
BLOCK = 2_000
LEVEL = 3
#: Bits a character that need no second look.
CLEAR = 0.25
FILLER = " " + "zq" * 40
#: Bits a character by which the best language must win after the second look.
MARGIN = 0.01

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


class Compressors:
    """One dictionary for each language; ``sizes`` are compressed bytes of a whole text."""

    def __init__(self, samples: dict[str, bytes]):
        import zstandard as zstd

        self.languages = list(samples)  # the most frequent first, which wins ties
        self.tools = []
        for language in self.languages:
            dictionary = zstd.ZstdCompressionDict(samples[language], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.tools.append(zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, plain: str) -> np.ndarray:
        blocks = [plain[i : i + BLOCK].encode() for i in range(0, len(plain), BLOCK)]
        return np.array([sum(len(tool.compress(b)) for b in blocks) for tool in self.tools], float)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        plain = letters(text or "")
        if not self.languages or not any(map(str.isalpha, plain)):
            return "und", 0.0, True
        sizes = self.sizes(plain)
        order = np.argsort(sizes, kind="stable")
        best = self.languages[order[0]]
        if len(order) == 1:
            return best, 1.0, False
        gain = 8 * (sizes[order[1]] - sizes[order[0]]) / len(plain)
        if gain < CLEAR:
            plain = f" {' '.join(dict.fromkeys(plain.split(' ')))} "
            sizes = self.sizes(plain + FILLER)
            order = np.argsort(sizes, kind="stable")
            best, gain = self.languages[order[0]], 8 * (sizes[order[1]] - sizes[order[0]]) / len(plain)
        return best, float(-np.expm1(-4 * gain)), bool(gain < MARGIN)


def _joined(sample_chars: int):
    """Sorted (lang, snippet) rows into one dictionary for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = lambda: pa.RecordBatch.from_arrays([pa.array([language], pa.string()), pa.array([" ".join(parts).encode()], pa.binary())], ["lang", "sample"])
        language, parts, size = None, [], 0
        for batch in batches:
            for name, snippet in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != language:
                    if size >= 8:
                        yield close()
                    language, parts, size = name, [], 0
                if size < sample_chars and (plain := letters(snippet)):
                    parts.append(plain)
                    size += len(plain)
        if size >= 8:
            yield close()

    return run


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries from rows that are not held out, one for every language.  Only the texts of a language are bounded: about ``sample_texts`` snippets are drawn, and the executors join them to the ``sample_chars`` characters a language that reach the driver."""
    plain = pick(docs, "doc_id", "text", "lang").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = plain.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("row", F.xxhash64("doc_id", "text"))
    # rows that repeat id and text are one
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("row").alias("distinct")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return {}
    limits = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 1.25 * sample_texts / r.distinct) * (1 << 40))) for r in counts], "lang string, below long")
    limits = F.broadcast(limits) if len(counts) <= BROADCAST_ROWS else limits
    key = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1 << 40))
    # the snippet starts at a hashed place, so that common openings do not fill the sample
    start = F.pmod(F.xxhash64("row", F.lit(5)), F.greatest(F.length("text") - SNIPPET, F.lit(1))).cast("int") + 1
    drawn = rows.join(limits, "lang").filter(key < F.col("below")).select("lang", key.alias("key"), F.substring("text", start, F.lit(SNIPPET)).alias("snippet")).distinct()
    sorted_ = drawn.repartition("lang").sortWithinPartitions("lang", "key", "snippet").select("lang", "snippet")
    found = dict(tuple(r) for r in sorted_.mapInArrow(_joined(sample_chars), "lang string, sample binary").collect())
    # the most frequent first
    return {r.lang: bytes(found[r.lang]) for r in counts if r.lang in found}


_PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def _predict(samples: dict[str, bytes], at: int, whole: bool = False):
    """Adds the prediction for column ``at``, which is left out unless ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(samples)
        for batch in batches:
            found = [tools.classify(t.as_py()) for t in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if whole or i != at]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], [*(batch.schema.names[i] for i in kept), "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs(doc_id, text)``."""
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = plain.mapInArrow(released(_predict(samples, 1)), _PREDICTED)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns; a text that is a string already is sent once."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    first, at = docs.toDF(*names), position(docs.columns, "text")
    plain = at is not None and docs.schema[at].dataType.typeName() == "string"
    if not plain:
        (text,) = columns_of(docs.columns, "text")
        first, at = first.withColumn("__text", text.cast("string")), len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema if f.name in names) + ", lang_pred string, score double, rejected boolean"
    return first.mapInArrow(released(_predict(samples, at, whole=plain)), schema).filter("not rejected").select(*names).toDF(*docs.columns)
