"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata.

The lexicon is learned from a bounded sample of labelled texts: words, and word
beginnings shared by several words, whose *distinct contexts* (neighbouring
words) lie in toxic texts far more often than chance allows.  Counting contexts
and not occurrences keeps a text that was copied many times from filling the
lexicon with its own words.

All entries lie in one trie.  A state of the automaton is the set of trie nodes
that the letters read so far can stand for, each with the edits it took
(insertion, deletion, substitution, swap of neighbours); how many edits an entry
allows follows its length.  States are determined as texts reach them and kept,
so a word costs one step a letter.  Words that the sample knows from clean texts
are no misspellings.  Hits are weighed in a window of their neighbours and set
apart when quoted or reported; a small logistic model turns the window scores
into a probability.

Defined results: null text counts as empty and scores as a text without hits;
texts of any length are read whole; null labels teach nothing, and of labels
that repeat an id the largest counts; without labels of both kinds the score is
the share of label 1 (0.5 with no label); of entries equally near a word the one
of larger weight counts; repeated rows are scored each, and learned from once;
an empty table gives an empty table; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window

from tidemark.llm.common import held_out, pick, settle, small_side
from tidemark.llm.learners import logistic
from tidemark.llm.quality import known_labels, labelled

#: Bounds of the labelled texts that the lexicon is learned from.
TOXIC_TEXTS, CLEAN_TEXTS = 4_000, 8_000
#: Lengths of word beginnings.
STEMS = (4, 5, 6, 7)
#: Words on either side of a hit that make its window.
WINDOW = 20
#: Words, and automaton states, that a worker keeps.
CACHE_WORDS, CACHE_STATES = 400_000, 100_000
#: Hits of whole words, of beginnings, of words of 5 letters or more one edit away, of all others with edits; quoted hits; window scores.
FEATURES = ("exact", "stem", "near", "loose", "quoted", "window", "rate")

# fixed values: words that introduce reported speech, and quotation marks
_REPORTED = frozenset("said says wrote writes called quoted quote reported dit écrit cité sagte schrieb zitiert dijo escribió citado".split())
_OPEN, _CLOSE = "\"'“„«‘‹", "\"'”“»’›"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‹›…–—¡¿"


def plain_word(token: str) -> str:
    return token.strip(_EDGE).lower()


def word_edits(length: int) -> int:
    """Edits that an entry of this length allows."""
    return 0 if length < 4 else 1 if length < 8 else 2


def stem_edits(length: int) -> int:
    return 0 if length < 6 else 1


class Lexicon:
    """Trie over words and beginnings, and the automaton of all texts within their edits."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], innocent: frozenset[str] = frozenset()):
        self.innocent = innocent
        self.children: list[dict[str, int]] = [{}]
        self.reach = [0]  # most edits that an entry below a node allows
        self.word: dict[int, tuple[int, int, float]] = {}  # node: edits, letters, weight
        self.stem: dict[int, tuple[int, int, float]] = {}
        for entries, ends, edits in ((words, self.word, word_edits), (stems, self.stem, stem_edits)):
            for entry, weight in entries.items():
                most, node = edits(len(entry)), 0
                self.reach[0] = max(self.reach[0], most)
                for c in entry:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.reach.append(0)
                    node = self.children[node][c]
                    self.reach[node] = max(self.reach[node], most)
                ends[node] = (most, len(entry), weight)
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, float] | None] = []
        self._number(self._closed({(0, "", False): 0}))

    def _number(self, state: frozenset) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.found.append(self._accepted(state))
        return at

    def _closed(self, held: dict) -> frozenset:
        """Adds what letters left out of an entry lead to."""
        fresh = list(held.items())
        while fresh:
            (node, awaited, past), edits = fresh.pop()
            if not awaited and not past and edits == held[node, awaited, past]:
                for child in self.children[node].values():
                    if edits < self.reach[child] and held.get((child, "", False), 9) > edits + 1:
                        held[child, "", False] = edits + 1
                        fresh.append(((child, "", False), edits + 1))
        return frozenset((*k, e) for k, e in held.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        """The state after one more letter.  Its members are (node, letter awaited for a swap, beginning passed, edits)."""
        held: dict = {}

        def add(node: int, awaited: str, past: bool, edits: int) -> None:
            if (past or edits <= self.reach[node]) and held.get((node, awaited, past), 9) > edits:
                held[node, awaited, past] = edits

        for node, awaited, past, edits in state:
            if past:
                add(node, "", True, edits)
                continue
            if awaited:
                if awaited == c:
                    add(node, "", False, edits)
                continue
            if node in self.stem and edits <= self.stem[node][0]:
                add(node, "", True, edits)
            below = self.children[node]
            if c in below:
                add(below[c], "", False, edits)
            if edits < self.reach[node]:
                add(node, "", False, edits + 1)
                for x, child in below.items():
                    if x != c:
                        add(child, "", False, edits + 1)
                        if c in self.children[child]:
                            add(self.children[child][c], x, False, edits + 1)
        return self._closed(held)

    def _accepted(self, state: frozenset) -> tuple[int, float] | None:
        best = None
        for node, awaited, past, edits in state:
            if awaited:
                continue
            most, letters, weight = self.stem[node] if past else self.word.get(node, (-1, 0, 0.0))
            if edits <= most:
                kind = int(past) if not edits else 2 if edits == 1 and letters >= 5 and not past else 3
                if best is None or (edits, past, -weight) < best[0]:
                    best = (edits, past, -weight), (kind, weight)
        return best and best[1]

    def look_up(self, token: str) -> tuple[int, float] | None:
        """(index of the feature, weight) of the nearest entry."""
        word = plain_word(token)
        if len(word) < 3:
            return None
        if len(self.states) > CACHE_STATES:
            self._forget()
        state = 0
        for c in word:
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = self._number(self._step(self.states[state], c))
            state = after
            if not self.states[state]:
                return None
        found = self.found[state]
        return None if found is None or found[0] >= 2 and word in self.innocent else found


def quoted(words: list[str], at: int) -> bool:
    """The hit stands inside quotation marks, or speech is reported just before it."""
    if words[at][0] in _OPEN and words[at].rstrip(".,;:!?")[-1] in _CLOSE and len(words[at]) > 2:
        return True
    for i in range(at, max(-1, at - WINDOW), -1):
        if i < at and words[i].rstrip(".,;:!?")[-1:] in tuple(_CLOSE) and words[i][0] not in _OPEN:
            break
        if words[i][0] in _OPEN:
            return any(w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for w in words[at : at + WINDOW])
    return any(plain_word(w) in _REPORTED for w in words[max(0, at - 4) : at])


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def features(self, text: str) -> list[float]:
        words = text.split()
        known, hit = self.known, False
        for word in set(words):
            if word not in known:
                if len(known) > CACHE_WORDS:
                    known.clear()
                known[word] = self.lexicon.look_up(word)
            hit = hit or known[word] is not None
        if not hit:
            return [0.0] * len(FEATURES)
        hits = [(i, found) for i, w in enumerate(words) if (found := known[w] if w in known else self.lexicon.look_up(w))]
        sums, marked = [0.0] * 5, []
        for i, (kind, weight) in hits:
            if quoted(words, i):
                sums[4] += weight
            else:
                sums[kind] += weight
                marked.append((i, weight))
        window, lo, total = 0.0, 0, 0.0
        for i, weight in marked:
            total += weight
            while marked[lo][0] < i - WINDOW:
                total -= marked[lo][1]
                lo += 1
            window = max(window, total)
        rate = sum(w for _, w in marked) / max(20, len(words)) * 100
        return [math.log1p(s) for s in (*sums, window, rate)]


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word, context) of each text."""
    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1), strict=True):
            words = [w for w in map(plain_word, (text.as_py() or "").split()) if w]
            rows = {(w, f"{a} {b}") for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False) if len(w) >= 3}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([label.as_py()] * len(rows), pa.int32())], ["word", "context", "label"])


def _evidence(toxic: float, clean: float, share: float) -> float:
    """Log likelihood ratio of the observed split against the split of all contexts."""
    n = toxic + clean
    return sum(k * math.log(k / (n * p)) for k, p in ((toxic, share), (clean, 1 - share)) if k)


def choose(counts: list[tuple[str, int, int, int]], contexts: tuple[int, int], bar: float, purity: float) -> dict[str, float]:
    """Terms whose contexts are toxic beyond chance, with their weights; ``counts`` are (term, toxic, clean, words)."""
    share = contexts[0] / max(1, sum(contexts))
    good = []
    for term, toxic, clean, _ in counts:
        even = toxic / max(1, contexts[0]) / (toxic / max(1, contexts[0]) + clean / max(1, contexts[1]) + 1e-12)
        if toxic >= 3 and even >= purity and (proof := _evidence(toxic, clean, share)) >= bar:
            good.append((proof, term, math.log((toxic + 0.5) / (clean + 0.5) * (contexts[1] + 1) / (contexts[0] + 1))))
    return {term: round(min(6.0, max(0.5, weight)), 6) for _, term, weight in sorted(good, reverse=True)}


def _misread(words: dict[str, float], stems: dict[str, float]):
    """The words that the automaton takes for entries with edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, stems)
        for batch in batches:
            hit = [w for w in batch.column(0).to_pylist() if (found := lexicon.look_up(w)) and found[0] >= 2]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], ["word"])

    return run


def learn_lexicon(docs: DataFrame, labels: DataFrame, toxic_texts: int = TOXIC_TEXTS, clean_texts: int = CLEAN_TEXTS) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """(words, beginnings, innocent words), the first two with weights, from at most so many distinct labelled texts that are not held out."""
    known = known_labels(labels, "toxic").select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}, {}, frozenset()
    # about a fifth more ids than are asked for; ids that repeat have many texts: the bound is set on texts
    key = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40))
    below = lambda most, label: F.lit(int(min(1, 1.2 * most / n[label]) * (1 << 40)))
    known = settle(known.filter(key < F.when(F.col("label") == 1, below(toxic_texts, 1)).otherwise(below(clean_texts, 0))), "known")
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    drawn = plain.join(small_side(known), "doc_id").select("label", "text", F.xxhash64("text").alias("key"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    texts = drawn.dropDuplicates(["label", "key"]).withColumn("first", first).filter(F.col("first") <= F.when(F.col("label") == 1, toxic_texts).otherwise(clean_texts)).filter(F.col("first") <= max(toxic_texts, clean_texts))
    pairs = texts.select("label", "text").repartition(64, "text").mapInArrow(_context, "word string, context string, label int").distinct()
    words = settle(pairs.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")), "words")
    total = words.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0)), F.count_if(F.col("toxic") >= 3)).first()
    bar = math.log(total[2] + 1) + 4
    seen = [tuple(r) for r in words.filter("toxic >= 3 and toxic >= clean").select("word", "toxic", "clean", F.lit(1)).collect()]
    chosen = choose(seen, total[:2], bar, 0.95)
    stems = words.select(F.explode(F.array(*[F.substring("word", 1, k) for k in STEMS])).alias("stem"), "word", "toxic", "clean").filter("length(word) > length(stem)").distinct()
    grouped = stems.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > F.col("clean")).alias("words"))
    begin = choose([tuple(r) for r in grouped.filter("length(stem) >= 4 and words >= 4 and toxic >= 4 * clean").collect()], total[:2], bar + 4, 0.95)
    # a word that occurs in clean texts more than in toxic ones is itself, not a misspelling
    innocent = words.filter("clean >= 2 and clean > toxic").select("word").mapInArrow(_misread(chosen, begin), "word string")
    return chosen, begin, frozenset(r[0] for r in innocent.collect())


def _score(lexicon: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker keeps the states that its earlier tasks determined
        name = hash((frozenset(lexicon[0].items()), frozenset(lexicon[1].items()), lexicon[2]))
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(Lexicon(*lexicon))
        scorer = _scorers[name]
        for batch in batches:
            rows = np.array([scorer.features(t.as_py() or "") for t in batch.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return run


_scorers: dict[int, Scorer] = {}


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = TOXIC_TEXTS + CLEAN_TEXTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""
    lexicon = learn_lexicon(docs, labels)
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = settle(plain.mapInArrow(_score(lexicon), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)), "hits")
    rows = np.array(labelled(found, labels, "toxic", sample_rows), float).reshape(-1, len(FEATURES) + 1)
    y = (rows[:, -1] > 0).astype(float)
    if len(y) and 0 < y.mean() < 1:
        weights = logistic(rows[:, :-1], y)
    else:
        p = min(0.98, max(0.02, y.mean() if len(y) else 0.5))
        weights = np.array([0.0] * len(FEATURES) + [math.log(p / (1 - p))])
    z = F.lit(float(weights[-1]))
    for name, weight in zip(FEATURES, weights, strict=False):
        z = z + F.col(name) * float(weight)
    scored = found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
