"""Query specifications and the predicates they stand for."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import TextQuery

# fixed values: providers in registration order, their aliases, and marks of injected context
PROVIDERS = ("opencode", "zcode", "codex", "kimi", "claudecode", "cursor", "pi")
ALIASES = {"claude": "claudecode"}
INJECTED = ("agents.md instructions for", "<instructions>", "<environment_context>", "<permissions instructions>", "<collaboration_mode>")


@dataclass(frozen=True)
class QuerySpec:
    keyword: str = ""
    providers: tuple[str, ...] | None = None
    roles: tuple[str, ...] | None = None
    path: str | None = None
    limit: int | None = None


def _names(raw: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.strip().casefold() for x in raw.split(",") if x.strip()))


def parse_providers(raw: str) -> tuple[str, ...]:
    found = tuple(dict.fromkeys(ALIASES.get(x, x) for x in _names(raw)))
    if unknown := sorted(set(found) - set(PROVIDERS)):
        raise ValueError(f"unknown provider: {', '.join(unknown)}; known: {', '.join(sorted(PROVIDERS))}")
    return found


def parse_limit(raw: str) -> int:
    if not raw.strip().isdigit() or not 0 < (n := int(raw)) < 2**63:
        raise ValueError("limit must be a positive whole number")
    return n


def scope_path(raw: str, cwd: str = "/", home: str | None = None) -> str:
    """A query's path as ``text.normal_path`` makes one of a column; the caller's folder and home are parameters."""
    given = raw.strip()
    if not given:
        raise ValueError("empty path")
    if home is not None and (given == "~" or given.startswith("~/")):
        given = home + given[1:]
    whole = posixpath.normpath(posixpath.join(cwd, given))
    # two slashes at the beginning mean one
    return "/" + whole.lstrip("/")


def parse_uri(uri: str, cwd: str = "/") -> QuerySpec:
    """``agents://<path>?q=&providers=&roles=&limit=``"""
    parts = urlsplit(uri)
    if parts.scheme != "agents":
        raise ValueError("not a query URI")
    raw = unquote(parts.netloc + parts.path)
    given = dict(parse_qsl(parts.query))
    path = scope_path(raw, cwd) if raw else None
    return QuerySpec(" ".join(given.get("q", "").split()), parse_providers(given["providers"]) if "providers" in given else None, _names(given["roles"]) if "roles" in given else None, path, parse_limit(given["limit"]) if "limit" in given else None)


def parse_query(raw: str, cwd: str = "/") -> QuerySpec:
    """``words``, ``provider,…:words``, or ``provider: role: path: limit:`` tokens among words.

    A colon is part of the words unless several names or a known one come
    before it; words among tokens are one phrase.
    """
    text = raw.strip()
    if not text:
        raise ValueError("empty query")
    given: dict[str, str] = {}
    words = []
    for token in text.split():
        name, colon, value = token.partition(":")
        key = {"cwd": "path"}.get(name.lower(), name.lower())
        if colon and key in ("provider", "role", "path", "limit"):
            if key in given or not value:
                raise ValueError(f"repeated or empty: {key}")
            given[key] = value
        else:
            words.append(token)
    if given:
        path = given.get("path")
        place = None if path is None else scope_path(path, cwd)
        return QuerySpec(" ".join(words), parse_providers(given["provider"]) if "provider" in given else None, _names(given["role"]) if "role" in given else None, place, parse_limit(given["limit"]) if "limit" in given else None)
    scope, colon, rest = text.partition(":")
    names = _names(scope)
    if colon and names and (len(names) > 1 or ALIASES.get(names[0], names[0]) in PROVIDERS):
        if not rest.strip():
            raise ValueError("empty keyword")
        return QuerySpec(rest.strip(), parse_providers(scope))
    return QuerySpec(text)


def date_range(since: date | None, until: date | None, today: date, days: int | None = None) -> tuple[date, date]:
    """First and last day, both included: today, the last ``days`` and today, up to today, or from the month's first."""
    if since is None and until is None:
        return today - timedelta(days=days or 0), today
    start, end = since or (until or today).replace(day=1), until or today
    if start > end:
        raise ValueError("the first day comes after the last")
    return start, end


def checked_days(days: int | None, today: date) -> int:
    """A number of days back: 7 without one; positive and not before the first day of the calendar."""
    days = 7 if days is None else days
    if not 0 < days < today.toordinal():
        raise ValueError("days must be a positive number below today's date")
    return days


def under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or lies below it."""
    return (path == root) | F.when(root == "/", path.startswith("/")).otherwise(path.startswith(F.concat(root, F.lit("/"))))


def path_scope(path: Column, scope: str) -> Column:
    """Equal, ancestor or descendant; a null path never matches."""
    return F.coalesce(under(path, F.lit(scope)) | under(F.lit(scope), path), F.lit(False))


def denied(path: Column, roots: list[str]) -> Column:
    """Equal to or below one of the roots; a null path is not denied."""
    out = F.lit(False)
    for root in roots:
        out = out | under(path, F.lit(root))
    return F.coalesce(out, F.lit(False))


def not_injected(role: Column, text: Column) -> Column:
    marked = F.lit(False)
    for mark in INJECTED:
        marked = marked | F.contains(F.lower(text), F.lit(mark))
    return ~((role == "developer") | ((role == "user") & F.coalesce(marked, F.lit(False))))


def recent(at: Column, now: Column, days: int) -> Column:
    return at >= now - F.make_interval(days=F.lit(days))


def role_evidence(messages: DataFrame, session: str, order: str, query: TextQuery, roles: list[str] | None) -> DataFrame:
    """First message of each session, in the given roles, that matches the query: (session, role, order)."""
    hit = query.matches(F.col("text"))
    if roles:
        hit = hit & F.lower("role").isin(roles)
    return messages.filter(hit).groupBy(session).agg(F.min_by("role", order).alias("role"), F.min(order).alias(order))
