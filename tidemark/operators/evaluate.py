"""Queries over sessions: scopes, role evidence, keyword and ranked search, limits and look-ups.

``sessions`` has (provider, session_id, title, working_directory, created_at,
updated_at), ``messages`` (provider, session_id, seq, role, text).  Branches are
chosen when the plan is built; each is filters, one join and at most one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import excerpt
from tidemark.operators import postings
from tidemark.operators.filters import PROVIDERS, QuerySpec, path_scope
from tidemark.operators.search import KEY, TextQuery, search, top
from tidemark.operators.views import corpus

# fixed values: URI schemes that differ from their provider's name, and prefixes before an id
SCHEMES = {"claude": "claudecode"}
PREFIXES = {"codex": ("threads/",)}


def recency() -> list:
    return [F.desc("updated_at"), F.desc("created_at"), F.asc("provider"), F.asc("session_id")]


def per_source(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` latest rows of each provider; Spark keeps that many a task before the exchange."""
    n = F.row_number().over(Window.partitionBy("provider").orderBy(*recency()))
    return rows.withColumn("__n", n).filter(F.col("__n") <= limit).drop("__n")


def scoped(spec: QuerySpec, sessions: DataFrame) -> DataFrame:
    """Sessions of the query's providers whose folder is the path, above or below it."""
    rows = sessions
    if spec.providers is not None:
        rows = rows.filter(F.col("provider").isin(*spec.providers))
    return rows if spec.path is None else rows.filter(path_scope(F.col("working_directory"), spec.path))


def _by_role(rows: DataFrame, messages: DataFrame, roles: tuple[str, ...], query: TextQuery) -> DataFrame:
    """Sessions with a message of one of the roles that matches; the first of them is the evidence."""
    role = F.lower(F.coalesce("role", F.lit("unknown")))
    said = messages.withColumn("role", role).filter(F.col("role").isin(*roles))
    if query.literals:
        said = said.filter(query.matches(F.col("text")))
    first = said.groupBy(*KEY).agg(F.min_by(F.struct("role", "text"), "seq").alias("__e"))
    shown = query.best_snippet(F.col("__e.text")) if query.literals else excerpt(F.col("__e.text"))
    return rows.join(first, KEY).withColumns({"matched_role": F.col("__e.role"), "snippet": shown, "rank": F.lit(0.0)}).drop("__e")


def matches(spec: QuerySpec, sessions: DataFrame, messages: DataFrame, ranked: bool = False, index: postings.Snapshot | None = None) -> DataFrame:
    """Sessions that a query selects, with (matched_role, snippet, rank).

    With ``ranked`` the keyword's terms are searched and the best come first, and
    a blank keyword finds nothing; else it is one phrase and the latest come
    first, and without one every session in scope is found.  A limit is global;
    under roles each provider sends its latest ``limit`` matches to it.  Keywords
    are looked up in ``index`` where one is given (titles and texts are those it
    holds), else in the messages.
    """
    query = TextQuery.terms(spec.keyword) if ranked else TextQuery.phrase(spec.keyword)
    rows, none = scoped(spec, sessions), F.lit(None).cast("string")
    if spec.roles is not None:
        found = _by_role(rows, messages, spec.roles, query)
        found = found if spec.limit is None else per_source(found, spec.limit)
    elif not query.literals:
        found = rows.withColumns({"matched_role": none, "snippet": F.col("title"), "rank": F.lit(0.0)})
        found = found.limit(0) if ranked else found
    else:
        # ranks are those among all sessions; the scope applies to what was found
        kept = rows.select(*KEY)
        if index is not None:
            found = postings.search(index, query, kept).select(*KEY, "rank", "snippet")
            found = rows.join(found, KEY).withColumn("matched_role", none)
            return _limited(found.select(*sessions.columns, "matched_role", "snippet", "rank"), spec.limit, ranked)
        # a session without texts is found by its title, and counts
        texts = sessions.join(corpus(messages), KEY, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "content")})
        found = search(texts, query, None if rows is sessions else kept).withColumn("matched_role", none).drop("content")
    return _limited(found.select(*sessions.columns, "matched_role", "snippet", "rank"), spec.limit, ranked)


def _limited(found: DataFrame, limit: int | None, ranked: bool) -> DataFrame:
    return found if limit is None else top(found, limit, *([F.desc("rank")] if ranked else []), *recency())


def find(sessions: DataFrame, session_id: str, provider: str | None = None) -> DataFrame:
    """The session of that id, of one provider or of the first in registration order that has it."""
    rows = sessions.filter(F.col("session_id") == session_id)
    if provider is not None:
        return rows.filter(F.col("provider") == provider).limit(1)
    place = F.nullif(F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider")), F.lit(0))
    return top(rows, 1, F.asc_nulls_last(place), F.asc("provider"))


def split_uri(uri: str) -> tuple[str, str]:
    """(provider, id) of ``scheme://id``."""
    scheme, mark, rest = uri.partition("://")
    provider = SCHEMES.get(scheme.lower(), scheme.lower())
    if not mark or provider not in PROVIDERS or not rest:
        raise ValueError(f"not a session URI: {uri}")
    for prefix in PREFIXES.get(provider, ()):
        rest = rest.removeprefix(prefix)
    return provider, rest


def find_uri(sessions: DataFrame, uri: str) -> DataFrame:
    provider, session_id = split_uri(uri)
    return find(sessions, session_id, provider)


def summary(spec: QuerySpec) -> str:
    """The query in words; a keyword alone stands for itself."""
    if spec.keyword and (spec.path, spec.providers, spec.roles, spec.limit) == (None,) * 4:
        return spec.keyword
    parts = [
        f"path={spec.path}" if spec.path is not None else "", f"keyword={spec.keyword}" if spec.keyword else "", f"providers={','.join(sorted(spec.providers))}" if spec.providers else "",
        f"roles={','.join(sorted(spec.roles))}" if spec.roles else "", f"limit={spec.limit}" if spec.limit is not None else "",
    ]
    return "; ".join(filter(None, parts)) or "all sessions"
