"""The registered providers: where their archives lie, whether they are there, and their sessions and messages.

A provider is a plain record; ``register`` takes further ones.  Roots come from
environment variables and the home folder, both of which are parameters: on a
cluster the caller names the folders that hold the archives.  A provider whose
archive cannot be listed is reported and left out; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import basename, title
from tidemark.operators import index, postings, views
from tidemark.operators.filters import PROVIDERS
from tidemark.operators.scratch import settle
from tidemark.sources import jsonl, sessions, sqlite, stores, transcripts

HEAD = ["provider", "session_id", "title", "created_at", "updated_at", "source_path", "working_directory", "model", "message_count", "uri"]
Env = Mapping[str, str]


@dataclass(frozen=True)
class Provider:
    """``roots`` gives (label, path) candidates in order; ``heads`` sessions with ``key``; ``messages`` assembled ones with the same key as ``session``.

    ``some`` gives the messages of the sessions in ``keys(key)`` and opens no file
    of another; ``count`` is an accumulator of the bytes read."""

    name: str
    display: str
    roots: Callable[[Env, str], list[tuple[str, str]]]
    heads: Callable[[SparkSession, str, str | None], DataFrame]
    messages: Callable[[SparkSession, str], DataFrame]
    files: bool = True
    some: Callable[[SparkSession, str, DataFrame, object], DataFrame] | None = None


def _under(variable: str, default: str, rest: str) -> Callable[[Env, str], list[tuple[str, str]]]:
    label = f"{variable}/{rest}" if rest else variable
    return lambda env, home: [(label, f"{env.get(variable) or f'{home}/{default}'}/{rest}".rstrip("/"))]


def _data_home(env: Env, home: str) -> str:
    """Folder of programs' data."""
    return env.get("XDG_DATA_HOME") or env.get("LOCALAPPDATA") or env.get("APPDATA") or f"{home}/.local/share"


def _listed(spark: SparkSession, root: str, since: str | None) -> tuple[DataFrame, DataFrame]:
    return jsonl.records(spark, root, since=since), jsonl.files(spark, root, since=since)


def _claude(spark: SparkSession, root: str, since: str | None) -> DataFrame:
    return sessions.claude_sessions(*_listed(spark, root, since), sessions.index_titles(spark, root)).withColumn("key", F.col("source_path"))


def _codex(spark: SparkSession, root: str, since: str | None) -> DataFrame:
    return sessions.codex_sessions(*_listed(spark, root, since)).withColumn("key", F.col("source_path"))


def _pi(spark: SparkSession, root: str, since: str | None) -> DataFrame:
    rows = jsonl.pi_sessions(jsonl.records(spark, root, since=since))
    shown = title(F.col("title"), basename(F.col("cwd")))
    return rows.select(
        F.lit("pi").alias("provider"), "session_id", shown.alias("title"), "created_at", "updated_at", F.col("path").alias("source_path"), F.nullif(F.trim("cwd"), F.lit("")).alias("working_directory"),
        F.lit(None).cast("string").alias("model"), "message_count", F.concat(F.lit("pi://"), "session_id").alias("uri"), F.col("path").alias("key"))


def _folder(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_extract(path, r"^(?:file:)?/*(.*)/[^/]+$", 1))


def _kimi(spark: SparkSession, root: str, since: str | None) -> DataFrame:
    heads = sessions.kimi_sessions(spark, root, since=None if since is None else F.lit(since).cast("timestamp"))
    return heads.withColumn("key", F.col("source_path"))


def _kimi_of(records: DataFrame) -> DataFrame:
    return transcripts.kimi_messages(records).withColumn("session", _folder(F.col("session")))


def _by_file(assemble: Callable[[DataFrame], DataFrame], pattern: str = "*.jsonl", key: Callable[[Column], Column] = lambda path: path):
    """Messages of a layout with one file a session: of all of them, and of some."""

    def whole(spark: SparkSession, root: str) -> DataFrame:
        return assemble(jsonl.records(spark, root, pattern))

    def some(spark: SparkSession, root: str, keys: DataFrame, count=None) -> DataFrame:
        held = jsonl.files(spark, root, pattern).withColumn("key", key(F.col("path"))).join(keys.select("key").distinct(), "key", "left_semi")
        # both written: assembling asks for the listing and for the records many times
        return assemble(settle(jsonl.records_in(settle(held.select("path", "size"), "held"), count), "records"))

    return {"messages": whole, "some": some}


def _relational(name: str):
    def heads(spark: SparkSession, root: str, since: str | None) -> DataFrame:
        return sessions.relational_sessions(sqlite.load(spark, root, "session"), sqlite.load(spark, root, "message"), name).withColumn("key", F.col("session_id"))

    return heads


def _keyed(spark: SparkSession, root: str, since: str | None) -> DataFrame:
    pairs = sqlite.load(spark, root, "cursorDiskKV")
    # heads go by request id, messages by composer
    first = pairs.filter(F.col("key").startswith("bubbleId:")).select(F.split("key", ":")[1].alias("key"), F.nullif(F.trim(F.get_json_object("value", "$.requestId")), F.lit("")).alias("request")).filter("request is not null").distinct()
    heads = sessions.keyed_sessions(pairs)
    return heads.join(first.groupBy("request").agg(F.min("key").alias("key")), heads["session_id"] == F.col("request"), "left").withColumn("key", F.coalesce("key", "session_id")).drop("request")


REGISTRY: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    """A provider more; its name must be new."""
    if provider.name in REGISTRY:
        raise ValueError(f"provider is there already: {provider.name}")
    REGISTRY[provider.name] = provider


def _relational_messages(spark: SparkSession, root: str) -> DataFrame:
    return stores.relational_messages(sqlite.load(spark, root, "message"), sqlite.load(spark, root, "part"))


_BUILT_IN = (
    Provider("opencode", "OpenCode", lambda env, home: [("data home opencode.db", f"{_data_home(env, home)}/opencode/opencode.db")], _relational("opencode"), _relational_messages, False),
    Provider("zcode", "ZCode", lambda env, home: [("~/.zcode db.sqlite", f"{home}/.zcode/cli/db/db.sqlite")], _relational("zcode"), _relational_messages, False),
    Provider("codex", "Codex", _under("CODEX_HOME", ".codex", "sessions"), _codex, **_by_file(lambda records: transcripts.codex_enriched(transcripts.codex_messages(records)))),
    Provider("kimi", "Kimi", _under("KIMI_SHARE_DIR", ".kimi", "sessions"), _kimi, **_by_file(_kimi_of, "context.jsonl", _folder)),
    Provider("claudecode", "Claude Code", _under("CLAUDE_CONFIG_DIR", ".claude", "projects"), _claude, **_by_file(transcripts.claude_messages)),
    Provider("cursor", "Cursor", lambda env, home: [("global state.vscdb", f"{home}/Library/Application Support/Cursor/User/globalStorage/state.vscdb")], _keyed, lambda spark, root: stores.keyed_messages(sqlite.load(spark, root, "cursorDiskKV")), False),
    Provider("pi", "Pi", _under("PI_HOME", ".pi", "agent/sessions"), _pi, **_by_file(transcripts.pi_messages)),
)
for _provider in _BUILT_IN:
    register(_provider)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def availability(spark: SparkSession, env: Env, home: str) -> DataFrame:
    """(provider, display, label, root, available): every place that is looked at, in registration order."""
    found = [(n, p.name, p.display, label, root, _exists(spark, root)) for n, p in enumerate(REGISTRY.values()) for label, root in p.roots(env, home)]
    return spark.createDataFrame(found, "n int, provider string, display string, label string, root string, available boolean").orderBy("n").drop("n")


def discover(spark: SparkSession, env: Env, home: str, names: Iterable[str] | None = None) -> dict[str, str]:
    """The first root that exists of each provider that has one."""
    wanted = None if names is None else set(names)
    found = {}
    for name, provider in REGISTRY.items():
        if wanted is None or name in wanted:
            there = [root for _, root in provider.roots(env, home) if _exists(spark, root)]
            if there:
                found[name] = there[0]
    return found


@dataclass(frozen=True)
class Listing:
    """``sessions`` of all providers that could be listed, and what failed by name."""

    sessions: DataFrame
    failed: dict[str, str]


def list_sessions(spark: SparkSession, roots: Mapping[str, str], since: str | None = None) -> Listing:
    """Heads (``HEAD``, provider_order, key) of the providers in ``roots``.

    With ``since`` (``yyyy-MM-dd'T'HH:mm:ss``, session time zone) files that were not
    modified after it are not listed, and sessions not updated since are left out."""
    heads, failed = [], {}
    for name, root in roots.items():
        try:
            # written, so that an archive is scanned once and what fails shows here
            rows = settle(REGISTRY[name].heads(spark, root, since).select(*HEAD, "key"), "heads")
        except (PySparkException, Py4JError, OSError, ValueError, KeyError) as error:
            failed[name] = str(error).splitlines()[0] if str(error) else type(error).__name__
            continue
        heads.append(rows.withColumn("provider_order", F.lit(list(REGISTRY).index(name))))
    if not heads:
        kinds = {"created_at": "timestamp", "updated_at": "timestamp", "message_count": "long"}
        return Listing(spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in HEAD) + ", key string, provider_order int"), failed)
    out = heads[0]
    for rows in heads[1:]:
        out = out.unionByName(rows)
    return Listing(out if since is None else out.filter(F.col("updated_at") >= F.lit(since).cast("timestamp")), failed)


def texts(spark: SparkSession, listing: Listing, roots: Mapping[str, str], due: DataFrame | None = None, count=None) -> DataFrame:
    """(provider, session_id, content): what a search finds in each listed session; one without messages has empty content.

    With ``due`` (provider, session_id) only those sessions are assembled, and of
    layouts with a file a session only their files are opened; providers without
    any of them are not read.  ``count`` is an accumulator of the bytes read."""
    known = listing.sessions.select("provider", "session_id", "key")
    wanted = None
    if due is not None:
        known = settle(known.join(due.select("provider", "session_id").distinct(), ["provider", "session_id"], "left_semi"), "due")
        # as many rows as there are providers
        wanted = {r.provider for r in known.select("provider").distinct().collect()}
    found = None
    for name, root in roots.items():
        if name in listing.failed or wanted is not None and name not in wanted:
            continue
        provider = REGISTRY[name]
        keys = known.filter(F.col("provider") == name).select("key")
        if due is None or provider.some is None:
            said = provider.messages(spark, root)
            said = said if due is None else said.join(keys.select(F.col("key").alias("session")).distinct(), "session", "left_semi")
        else:
            said = provider.some(spark, root, keys, count)
        rows = views.searchable(said).select(F.lit(name).alias("provider"), F.col("session").alias("key"), "content")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return known.select("provider", "session_id", F.lit("").alias("content"))
    return known.join(found, ["provider", "key"], "left").select("provider", "session_id", F.coalesce("content", F.lit("")).alias("content"))


def reindex(spark: SparkSession, listing: Listing, roots: Mapping[str, str], folder: str, now: Column, rebuild: bool = False, count=None) -> postings.Snapshot:
    """Bring a kept index up to date with a listing: sessions whose time of change is new are read and written, no others."""
    seen = listing.sessions.withColumn("signature", views.signature(F.col("updated_at"))).select(*index.KEY, "signature", "title", "updated_at", "created_at")
    seen = settle(seen, "listed")
    due = settle(postings.due(spark, folder, seen, now, rebuild), "changed")
    return postings.refresh(spark, folder, seen, texts(spark, listing, roots, due, count), now, rebuild)


if tuple(REGISTRY) != PROVIDERS:
    raise ImportError("providers are registered in another order than queries name them")
