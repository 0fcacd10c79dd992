"""Discovery, listing and indexing over the providers' archives."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.operators import postings
from tidemark.operators.search import TextQuery
from tidemark.sources import providers


def written(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture
def home(tmp_path):
    at = "2026-01-0{}T00:00:00Z".format
    written(tmp_path / ".claude" / "projects" / "p" / "c1.jsonl", {"type": "user", "timestamp": at(1), "cwd": "/w/a", "message": {"role": "user", "content": "alpha deploy"}}, {"type": "assistant", "timestamp": at(2), "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "done"}, {"type": "tool_use", "id": "t", "name": "run", "input": {"cmd": "needle"}}]}}, {"type": "user", "timestamp": at(2), "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "hidden output"}]}})
    written(tmp_path / "cx" / "sessions" / "rollout-x.jsonl", {"type": "session_meta", "timestamp": at(3), "payload": {"id": "x1", "timestamp": at(3), "cwd": "/w/b"}}, {"type": "response_item", "timestamp": at(3), "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "beta deploy"}]}})
    written(tmp_path / ".pi" / "agent" / "sessions" / "p1.jsonl", {"type": "session", "id": "p1", "cwd": "/w/c", "timestamp": at(4)}, {"type": "message", "id": "e", "timestamp": at(4), "message": {"role": "user", "content": [{"type": "text", "text": "gamma"}]}})
    folder = tmp_path / ".kimi" / "sessions" / "h" / "k1"
    written(folder / "context.jsonl", {"role": "user", "content": "delta deploy"})
    (folder / "metadata.json").write_text(json.dumps({"session_id": "k1", "title": "T", "wire_mtime": 1767571200}))
    store = tmp_path / ".local" / "share" / "opencode" / "opencode.db"
    store.parent.mkdir(parents=True)
    db = sqlite3.connect(store)
    db.executescript("create table session(id text primary key, title text, time_created int, time_updated int, directory text); create table message(id text primary key, session_id text, time_created int, data text); create table part(id text primary key, message_id text, time_created int, data text);")
    db.execute("insert into session values ('o1', 'Open', 1767225600000, 1767744000000, '/w/d')")
    db.execute("insert into message values ('m', 'o1', 1, ?)", (json.dumps({"role": "user"}),))
    db.execute("insert into part values ('p', 'm', 1, ?)", (json.dumps({"type": "text", "text": "epsilon deploy"}),))
    db.commit()
    cursor = tmp_path / "Library" / "Application Support" / "Cursor" / "User" / "globalStorage" / "state.vscdb"
    cursor.parent.mkdir(parents=True)
    db = sqlite3.connect(cursor)
    db.execute("create table cursorDiskKV(key text primary key, value text)")
    for key, value in (("composerData:A", {"createdAt": 1767225600000, "name": "Cur"}), ("bubbleId:A:1", {"type": 1, "text": "zeta deploy", "requestId": "r1"})):
        db.execute("insert into cursorDiskKV values (?, ?)", (key, json.dumps(value)))
    db.commit()
    return tmp_path


def test_discovery_to_search(spark, home):
    env = {"CODEX_HOME": str(home / "cx")}
    there = {r.provider: (r.available, r.root) for r in providers.availability(spark, env, str(home)).collect()}
    assert {p for p, (ok, _) in there.items() if ok} == {"claudecode", "codex", "pi", "kimi", "opencode", "cursor"} and there["codex"][1] == str(home / "cx" / "sessions")
    roots = providers.discover(spark, env, str(home))
    assert list(roots) == ["opencode", "codex", "kimi", "claudecode", "cursor", "pi"] and providers.discover(spark, env, str(home), ["zcode", "pi"]).keys() == {"pi"}
    listing = providers.list_sessions(spark, roots)
    got = {r.provider: r for r in listing.sessions.collect()}
    assert {p: (r.session_id, r.title) for p, r in got.items()} == {"claudecode": ("c1", "alpha deploy"), "codex": ("x1", "b"), "pi": ("p1", "c"), "kimi": ("k1", "T"), "opencode": ("o1", "Open"), "cursor": ("r1", "Cur")}
    assert listing.failed == {} and got["pi"].provider_order == 6
    folder = f"file://{home}/index"
    kept = providers.reindex(spark, listing, roots, folder, F.current_timestamp())
    texts = {r.provider: r.content for r in kept.corpus().collect()}
    assert texts["codex"] == "beta deploy" and texts["cursor"] == "zeta deploy" and "hidden output" in texts["claudecode"]
    assert {r.provider for r in postings.search(kept, TextQuery.terms("deploy")).collect()} == {"claudecode", "codex", "kimi", "opencode", "cursor"}
    # only what changed is written again; what this scan does not see stays
    roots = {"pi": roots["pi"]}
    written(home / ".pi" / "agent" / "sessions" / "p1.jsonl", {"type": "session", "id": "p1", "cwd": "/w/c", "timestamp": "2026-01-04T00:00:00Z"}, {"type": "message", "id": "e", "timestamp": "2026-02-04T00:00:00Z", "message": {"role": "user", "content": [{"type": "text", "text": "deploy at last"}]}})
    again = providers.reindex(spark, providers.list_sessions(spark, roots), roots, folder, F.current_timestamp())
    assert again.n == 6 and again.table("docs").filter(F.col("segment") == again.segments[-1]).count() == 1
    assert postings.search(again, TextQuery.terms("deploy")).count() == 6


def test_windows_and_failures(spark, home):
    roots = providers.discover(spark, {}, str(home))
    assert {r.provider for r in providers.list_sessions(spark, roots, "2026-01-04T00:00:00").sessions.collect()} == {"pi", "kimi", "opencode"}
    broken = providers.list_sessions(spark, {"pi": str(home / "nowhere"), "kimi": roots["kimi"]})
    assert list(broken.failed) == ["pi"] and [r.provider for r in broken.sessions.collect()] == ["kimi"]
    assert providers.list_sessions(spark, {}).sessions.count() == 0


def test_registering(spark, monkeypatch):
    monkeypatch.setattr(providers, "REGISTRY", dict(providers.REGISTRY))
    mine = lambda s, root, since: s.createDataFrame([("own", "1", "t", None, None, root, None, None, 1, "own://1", "1")], ", ".join(f"{c} {'timestamp' if c.endswith('_at') else 'long' if c == 'message_count' else 'string'}" for c in providers.HEAD) + ", key string")
    providers.register(providers.Provider("own", "Own", lambda env, home: [("home", home)], mine, None))
    assert [r.uri for r in providers.list_sessions(spark, {"own": "/tmp"}).sessions.collect()] == ["own://1"]
    with pytest.raises(ValueError, match="there already"):
        providers.register(providers.REGISTRY["pi"])


def test_only_changed_files_are_opened(spark, home):
    roots = {name: root for name, root in providers.discover(spark, {"CODEX_HOME": str(home / "cx")}, str(home)).items() if name in ("codex", "kimi", "claudecode", "pi")}
    folder, old, now = f"file://{home}/index", spark.sparkContext.accumulator(0), F.current_timestamp()
    at = "2026-03-0{}T00:00:00Z".format
    note = lambda n, text: {"type": "message", "id": "e", "timestamp": at(n), "message": {"role": "user", "content": [{"type": "text", "text": text}]}}
    for i in range(5):
        written(home / ".pi" / "agent" / "sessions" / f"q{i}.jsonl", {"type": "session", "id": f"q{i}", "cwd": "/w", "timestamp": at(1)}, note(2, f"number {i} " + "x" * 500))
    first = providers.reindex(spark, providers.list_sessions(spark, roots), roots, folder, now, count=old)
    whole = providers.texts(spark, providers.list_sessions(spark, roots), roots)
    assert first.n == 9 and {(r.provider, r.session_id, r.content) for r in first.corpus().select("provider", "session_id", "content").collect()} == {tuple(r) for r in whole.collect()}
    assert old.value >= 5 * 500
    none = spark.sparkContext.accumulator(0)
    again = providers.reindex(spark, providers.list_sessions(spark, roots), roots, folder, now, count=none)
    assert none.value == 0 and again.n == 9
    changed = home / ".pi" / "agent" / "sessions" / "q3.jsonl"
    written(changed, {"type": "session", "id": "q3", "cwd": "/w", "timestamp": at(1)}, note(4, "deploy once more"))
    one = spark.sparkContext.accumulator(0)
    last = providers.reindex(spark, providers.list_sessions(spark, roots), roots, folder, now, count=one)
    assert one.value == changed.stat().st_size
    assert {r.session_id for r in postings.search(last, TextQuery.terms("deploy")).collect()} == {"c1", "x1", "k1", "q3"} and last.n == 9
    anew = spark.sparkContext.accumulator(0)
    assert providers.reindex(spark, providers.list_sessions(spark, {"pi": roots["pi"]}), roots, folder, now, rebuild=True, count=anew).n == 9 and anew.value >= 4 * 500
