"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are computed once.  On a bounded, hashed sample
of labelled rows boosted trees are grown; every path of a tree is a conjunctive
rule; lasso logistic regression keeps few of them.  What is left is compiled
into one Spark column expression over the statistics.

Defined results: null text counts as empty and is scored by its statistics;
texts of any length are measured whole; rows with null labels teach nothing, and
of labels that repeat an id the largest counts; without labels of both kinds the
score is the share of label 1 (0.5 with no label); a score of exactly 0.7 is
predicted 1; repeated rows are scored each, and learned from once; an empty table
gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, pick, settle, small_side
from tidemark.llm.learners import Rule, apply_rule, boosted_rules, lasso_logistic
from tidemark.llm.tokens import word_hashes

#: Bound of the labelled rows that reach the driver.
SAMPLE_ROWS = 20_000
PENALTY = 0.0005

STATISTICS = ("words", "word_bytes", "upper", "digits", "symbols", "marks", "bars", "distinct", "pairs", "top_word", "lines", "distinct_lines", "stops", "wide", "longest", "line_words")

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]()"]] = True


def statistics(text: str) -> list[float]:
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = word_hashes(raw)
    k = max(1, len(words))
    _, each = np.unique(words, return_counts=True)
    pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    return [
        float(np.log1p(len(words))),
        sum(map(len, raw.split())) / k,
        float(count[_UPPER].sum() / letters),
        float(count[_DIGIT].sum() / n),
        float(count[_SYMBOL].sum() / k),
        float(count[ord("!")] / k),
        float(count[ord("|")] / k),
        len(each) / k,
        len(np.unique(pairs)) / max(1, len(pairs)),
        float(each.max() / k) if len(each) else 0.0,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        float(count[ord(".")] / k),
        float(count[128:].sum() / n),
        float(min(200, max(map(len, raw.split()), default=0))),
        len(words) / max(1, len(lines)),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py() or "") for t in batch.column(1)], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], ["doc_id", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every row of ``docs(doc_id, text)``."""
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            hit = F.lit(True)
            for f, low, cut in rule:
                hit = hit & ((F.col(STATISTICS[f]) <= cut) if low else (F.col(STATISTICS[f]) > cut))
            z = z + F.when(hit, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        return RuleModel((), float(np.log(p / (1 - p))))
    rules = boosted_rules(x, y)
    hits = {}
    for rule in rules:
        hit = apply_rule(rule, x)
        if 0 < hit.sum() < len(hit):
            hits.setdefault(hit.tobytes(), (rule, hit))
    chosen = list(hits.values())
    matrix = np.stack([h for _, h in chosen], 1).astype(float) if chosen else np.zeros((len(y), 0))
    weights, intercept = lasso_logistic(matrix, y, penalty)
    return RuleModel(tuple((rule, float(w)) for (rule, _), w in zip(chosen, weights, strict=True) if abs(w) > 1e-6), intercept)


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the ids that may be learned from, one row each: of several labels the largest."""
    plain = pick(labels, "doc_id", label).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    return plain.filter("doc_id is not null and label is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled(features: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE_ROWS) -> list:
    """At most ``most`` distinct rows (features, label) that may be learned from, drawn by hash."""
    known = settle(known_labels(labels, label), "known")
    n = known.count()
    if n > most:
        # a fifth more ids than rows are asked for; ids that repeat have many rows: the bound is set on rows
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 40)) < int(min(1, 1.2 * most / n) * (1 << 40)))
    rows = features.join(small_side(known), "doc_id")
    columns = [c for c in rows.columns if c != "doc_id"]
    drawn = rows.select(*columns, F.xxhash64("doc_id", *columns).alias("__key")).dropDuplicates(["__key"])
    return drawn.orderBy("__key").limit(most).drop("__key").collect()


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""
    measured = settle(measure(docs), "statistics")
    rows = np.array(labelled(measured, labels, "quality", sample_rows), float).reshape(-1, len(STATISTICS) + 1)
    model = fit(rows[:, :-1], (rows[:, -1] > 0).astype(float))
    scored = measured.select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
