"""Literal and ranked search over a corpus (id, title, content, updated)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import WHITE, has_literal, literal_pattern, snippet

# fixed values of the ranking formula
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class TextQuery:
    """Literals of a query: one phrase, or its terms in order without repeats."""

    literals: tuple[str, ...]

    @classmethod
    def phrase(cls, raw: str) -> TextQuery:
        tidy = " ".join(raw.split())
        return cls((tidy,) if tidy else ())

    @classmethod
    def terms(cls, raw: str) -> TextQuery:
        return cls(tuple(dict.fromkeys(raw.split())))

    def matches(self, *fields: Column) -> Column:
        """Every literal occurs in one of the fields."""
        out = F.lit(bool(self.literals))
        for literal in self.literals:
            hit = F.lit(False)
            for field in fields:
                hit = hit | has_literal(field, literal)
            out = out & hit
        return out

    def best_snippet(self, *fields: Column) -> Column:
        """Snippet of the first literal found in the field with most literals."""
        count = [sum((has_literal(f, x).cast("int") for x in self.literals), F.lit(0)) for f in fields]
        ranked = F.array_sort(F.array(*[F.struct((-c).alias("c"), F.lit(i).alias("i")) for i, c in enumerate(count)]))
        best = F.element_at(ranked, 1)["i"]
        out = F.lit(None).cast("string")
        for i, field in enumerate(fields):
            out = F.when(best == i, F.coalesce(*[snippet(field, x) for x in self.literals])).otherwise(out)
        return out


KEY = ["provider", "session_id"]
# fixed value: characters that are words of their own
CJK = "一-鿿"
_LETTER = rf"[[\p{{L}}\p{{N}}]&&[^{CJK}]]"


def access_path(query: TextQuery) -> str:
    """Which index answers a query: words (CJK), trigrams, or a scan."""
    cjk = lambda s: all("一" <= c <= "鿿" for c in s)
    some = lambda s: any(cjk(c) for c in s)
    if query.literals and all(map(cjk, query.literals)):
        return "words"
    if query.literals and all(not some(x) and len(x) >= 3 and " " not in x for x in query.literals):
        return "trigrams"
    return "scan"


def split_cjk(text: Column) -> Column:
    """Neighbouring CJK characters set apart by a space."""
    return F.regexp_replace(text, f"(?<=[{CJK}])(?=[{CJK}])", " ")


def join_cjk(snippet: Column) -> Column:
    """Undoes ``split_cjk`` in a snippet: neighbouring highlights of CJK characters become one, and spaces between such characters go."""
    tidy = F.trim(F.regexp_replace(snippet, WHITE, " "))
    merged = F.regexp_replace(tidy, rf"(?<=\*\*[{CJK}]{{1,255}})\*\*\s+\*\*(?=[{CJK}]+\*\*)", "")
    return F.regexp_replace(merged, rf"(?<=[{CJK}])\s+(?=(\*\*)?[{CJK}])|(?<=[{CJK}]\*\*)\s+(?=[{CJK}])", "")


def tokens(text: Column, words: bool) -> Column:
    """Number of trigrams, or of words where each CJK character is one."""
    if words:
        return F.regexp_count(split_cjk(text), F.lit(r"[\p{L}\p{N}]+"))
    return F.greatest(F.length(text) - 2, F.lit(0))


def occurrences(text: Column, literal: str, words: bool) -> Column:
    """How often a literal occurs, overlaps included; as words only where no letter of another script touches it."""
    found = literal_pattern(literal)
    return F.regexp_count(text, F.lit(f"(?<!{_LETTER})(?={found}(?!{_LETTER}))" if words else f"(?={found})"))


def literal_rank(corpus: DataFrame, query: TextQuery) -> DataFrame:
    """Matching rows with rank 1.0 where the title holds every literal, else 0.0."""
    title, content = F.col("title"), F.col("content")
    return corpus.filter(query.matches(title, content)).withColumn("rank", F.when(query.matches(title), 1.0).otherwise(0.0))


def _counted(corpus: DataFrame, query: TextQuery, words: bool) -> DataFrame:
    fields = [F.col("title"), F.col("content")]
    add = lambda f: sum((F.coalesce(f(x), F.lit(0)) for x in fields), F.lit(0)).cast("double")
    return corpus.withColumns({"__len": add(lambda x: tokens(x, words)), **{f"__tf{i}": add(lambda f, x=x: occurrences(f, x, words)) for i, x in enumerate(query.literals)}})


def _scored(rows: DataFrame, columns: list[str], query: TextQuery, totals: DataFrame) -> DataFrame:
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(query.literals)):
        t, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.greatest(F.ln((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
        every = every & (t > 0)
    # the totals are one row
    return rows.filter(every).crossJoin(F.broadcast(totals)).select(*columns, F.round(score, 6).alias("rank"))


def _found_in(query: TextQuery) -> list[Column]:
    return [F.count_if(F.col(f"__tf{i}") > 0).cast("double").alias(f"__df{i}") for i in range(len(query.literals))]


def bm25(corpus: DataFrame, query: TextQuery, words: bool = False) -> DataFrame:
    """Matching rows with their BM25 rank, by a scan; length counts trigrams, or words, of title and content."""
    rows = _counted(corpus, query, words)
    totals = rows.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__len").alias("__avg"), *_found_in(query))
    return _scored(rows, corpus.columns, query, totals)


def gram_table(corpus: DataFrame, *key: str) -> DataFrame:
    """(gram, key): the distinct trigrams of each row's title and content, to be stored beside an index."""
    # one pass over a text: a substring counts its characters from the text's beginning.  No gram begins inside a character of two code units
    cut = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1))
    grams = F.array_distinct(F.concat(*[cut(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in ("title", "content")]))
    return corpus.select(F.explode(grams).alias("gram"), *(key or KEY))


def size_table(corpus: DataFrame, *key: str) -> DataFrame:
    """(key, size): trigrams of each row, to be stored beside an index."""
    return corpus.select(*(key or KEY), sum((F.coalesce(tokens(F.col(c), False), F.lit(0)) for c in ("title", "content")), F.lit(0)).cast("double").alias("size"))


def indexed(corpus: DataFrame, grams: DataFrame, sizes: DataFrame, query: TextQuery, *key: str) -> DataFrame:
    """As ``bm25`` by trigrams, from stored tables: only rows that hold all trigrams of a literal are read.

    A literal without a trigram is not in the tables; such a query is a scan."""
    if any(len(x) < 3 for x in query.literals):
        return bm25(corpus, query)
    key = list(key or KEY)
    parts = [sorted({x.lower()[i : i + 3] for i in range(len(x) - 2)}) for x in query.literals]
    held = [F.count_if(F.col("gram").isin(p)) == len(p) for p in parts]
    near = grams.filter(F.col("gram").isin(sorted({g for p in parts for g in p}))).groupBy(*key).agg(reduce(or_, held).alias("__near"))
    rows = _counted(corpus.join(near.filter("__near").select(*key), key, "left_semi"), query, False)
    totals = sizes.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("size").alias("__avg")).crossJoin(rows.agg(*_found_in(query)))
    return _scored(rows, corpus.columns, query, totals)


def search(corpus: DataFrame, query: TextQuery, scope: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rows of (provider, session_id, title, content, created_at, updated_at, ...) that match, with (rank, snippet).

    Words and trigrams rank by BM25 among all rows, other queries by the title;
    all by a scan: ``postings.search`` answers the same from a kept index.
    ``scope`` keeps only its keys, before the limit; no query finds nothing.
    """
    path = access_path(query)
    if not query.literals:
        found = corpus.limit(0).withColumn("rank", F.lit(0.0))
    else:
        found = literal_rank(corpus, query) if path == "scan" else bm25(corpus, query, path == "words")
    if scope is not None:
        found = found.join(scope.select(*KEY).distinct(), KEY, "left_semi").select(*found.columns)
    if limit is not None:
        found = top(found, limit, F.desc("rank"), F.desc("updated_at"), F.desc("created_at"), F.asc("provider"), F.asc("session_id"))
    shown = query.best_snippet(F.col("title"), F.col("content")) if query.literals else F.lit(None).cast("string")
    return found.withColumn("snippet", F.coalesce(shown, F.col("title")))


def top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """First ``limit`` rows of a total order; limits above an INT mean none."""
    return rows.orderBy(*order).limit(limit) if limit < 2**31 else rows.orderBy(*order)
