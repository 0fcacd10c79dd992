"""Session heads, token totals and query parsing on small inputs."""

import hashlib
import json
import sqlite3
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import date_range, parse_query
from tidemark.sources import jsonl, sessions, transcripts
from tidemark.sources.sqlite import SqliteSessions


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))


def test_heads(spark, tmp_path):
    claude, codex = tmp_path / "claude", tmp_path / "codex"
    turn = lambda role, content, at, **x: {"type": role, "timestamp": at, "cwd": "/w/app", "version": "1", "message": {"role": role, "content": content, **x}}
    usage = {"input_tokens": 3, "output_tokens": 2}
    write(claude / "proj" / "abc.jsonl", [turn("user", [{"type": "text", "text": "fix"}, "it"], "2026-01-01T00:00:00Z"), turn("assistant", [{"type": "text", "text": "ok"}], "2026-01-03T00:00:00Z", model=" m ", usage=usage), turn("assistant", [{"type": "text", "text": "more"}], "2026-01-02T00:00:00Z", usage=usage), {"timestamp": "bad"}])
    write(claude / "proj" / "big.jsonl", [{"x": 1}, {"pad": "y" * 300_000}])
    said = lambda role, text: {"type": "response_item", "timestamp": "2026-02-02T00:00:00Z", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}
    total = lambda n: {"type": "event_msg", "payload": {"info": {"total_token_usage": {"input_tokens": n, "output_tokens": "1"}}}}
    write(codex / "rollout-x-1-2-3-4-5.jsonl", [{"type": "session_meta", "payload": {"timestamp": "2026-02-01T00:00:00Z", "cwd": "/r", "cli_version": "9", "model_provider": "prov"}}, said("user", "context"), said("user", " real  ask "), total(5), total(9)])
    a = jsonl.records(spark, str(claude))
    b = jsonl.records(spark, str(codex))
    both = sessions.union({"claudecode": sessions.claude_sessions(a, sessions.files(spark, str(claude))), "codex": sessions.codex_sessions(b, sessions.files(spark, str(codex)))})
    got = {r.session_id: r for r in both.withColumns({c: both[c].cast("string") for c in ("created_at", "updated_at")}).collect()}
    abc, rollout = got["abc"], got["1-2-3-4-5"]
    assert (abc.title, abc.created_at, abc.updated_at, abc.model, abc.message_count, abc.uri, abc.working_directory) == ("fix it", "2026-01-01 00:00:00", "2026-01-02 00:00:00", "m", 3, "claude://abc", "/w/app")
    assert (got["big"].title, got["big"].message_count, got["big"].created_at > "2020") == ("proj", 0, True)
    assert (rollout.title, rollout.created_at, rollout.model, rollout.message_count, rollout.provider_order < abc.provider_order) == ("real ask", "2026-02-01 00:00:00", "prov", 2, True)
    assert sessions.token_totals(b, "codex").first()[1:] == (14, 2, None)
    assert sessions.assembled_tokens(transcripts.claude_messages(a)).filter("session like '%abc.jsonl'").first()[1:] == (3, 2)


def test_side_files(spark, tmp_path):
    write(tmp_path / "i.jsonl", [{"id": "a", "thread_name": "one"}, {"id": "a", "thread_name": "two"}, {"id": "b", "thread_name": " "}, {"thread_name": "x"}])
    assert [tuple(r) for r in sessions.side_titles(jsonl.records(spark, str(tmp_path))).collect()] == [("a", "two")]
    write(tmp_path / "k" / "wire.jsonl", [{"message": {"usage": {"input_tokens": 4}}}, {"role": "_usage", "token_count": 7}, {"role": "_usage", "token_count": 5}])
    assert sessions.token_totals(jsonl.records(spark, str(tmp_path / "k")), "kimi").first()[1:] == (4, 0, 5)


def test_queries():
    assert parse_query("claude,codex: find me").providers == ("claudecode", "codex")
    assert parse_query("error: none").keyword == "error: none" and parse_query("error: none").providers is None
    spec = parse_query("auth role:user provider:pi bug path:src limit:3", cwd="/w")
    assert (spec.keyword, spec.roles, spec.providers, spec.path, spec.limit) == ("auth bug", ("user",), ("pi",), "/w/src", 3)
    for bad in ("", "pi:", "pi,zz:x", "limit:0", "role:"):
        with pytest.raises(ValueError):
            parse_query(bad)


def test_date_range():
    day = date(2026, 3, 15)
    assert date_range(None, None, day) == (day, day) and date_range(None, None, day, 7) == (date(2026, 3, 8), day)
    assert date_range(date(2026, 3, 1), None, day) == (date(2026, 3, 1), day) and date_range(None, date(2026, 2, 9), day) == (date(2026, 2, 1), date(2026, 2, 9))
    with pytest.raises(ValueError):
        date_range(date(2026, 4, 1), None, day)


def test_stores(spark, tmp_path):
    spark.dataSource.register(SqliteSessions)
    path = str(tmp_path / "o.db")
    read = lambda name: spark.read.format("sqlite_sessions").option("path", path).option("table", name).load()
    with sqlite3.connect(path) as db:
        db.executescript("create table session(id text, title text, time_created int, time_updated int, directory text); create table message(id text, session_id text, time_created int, data text); create table cursorDiskKV(key text, value text)")
        db.executemany("insert into session values (?,?,?,?,?)", [("a", " ", 1_700_000_000_000, 1_700_000_001_000, "/w/app"), ("b", "B", 0, 0, None)])
        db.executemany("insert into message values (?,?,?,?)", [("1", "a", 1, '{"modelID": "old"}'), ("2", "a", 2, '{"modelID": "new"}'), ("3", "a", 3, "{}")])
        db.executemany("insert into cursorDiskKV values (?,?)", [("composerData:c0ffee-123", '{"createdAt": 1700000000000}'), ("composerData:bad", "[]"), ("bubbleId:c0ffee-123:1", '{"type": 1, "requestId": "r1"}'), ("bubbleId:c0ffee-123:2", '{"type": 2, "modelInfo": {"modelName": "m"}}'), ("bubbleId:c0ffee-123:3", '{"type": 9}')])
    got = sessions.relational_sessions(read("session"), read("message")).orderBy("session_id").collect()
    assert [(r.session_id, r.title, r.model, r.message_count, r.uri) for r in got] == [("a", "app", "new", 3, "opencode://a"), ("b", "B", None, 0, "opencode://b")]
    (r,) = sessions.keyed_sessions(read("cursorDiskKV")).collect()
    assert (r.session_id, r.title, r.model, r.message_count, r.uri) == ("r1", "Cursor Session c0ffee-1", "m", 2, "cursor://r1")


def test_kimi_heads(spark, tmp_path):
    place = tmp_path / "sessions" / hashlib.md5(b"/w/app").hexdigest()
    write(place / "s1" / "context.jsonl", [{"role": "user", "content": "hi"}, {"role": "_usage", "token_count": 1}])
    (place / "s1" / "metadata.json").write_text(json.dumps({"session_id": "one", "wire_mtime": 1700000000}, indent=2))
    (place / "s2").mkdir()
    (place / "s2" / "metadata.json").write_text("{}")
    write(place / "s3" / "wire.jsonl", [{}])
    (place / "s3" / "metadata.json").write_text('{"title": "T"}')
    (tmp_path / "kimi.json").write_text(json.dumps({"work_dirs": [{"path": "/w/app"}, {"path": 5}, 3]}))
    got = sessions.kimi_sessions(spark, str(tmp_path / "sessions"), str(tmp_path / "kimi.json")).orderBy("session_id").collect()
    assert [(r.session_id, r.title, r.working_directory, r.message_count) for r in got] == [("one", "app", "/w/app", 1), ("s3", "T", "/w/app", None)]


def test_records_of_split_files(spark, tmp_path):
    folder = tmp_path / "a b+%2"
    folder.mkdir()
    lines = [json.dumps({"n": n, "pad": "é" * (n % 37)}) for n in range(400)]
    lines[7], lines[9], lines[250] = "", "[1]", '{"n": 1} x'
    (folder / "x.jsonl").write_text("\n".join(lines) + "\n")
    (folder / "y.jsonl").write_bytes(b'{"n": 1}\r\n\xff{}\n \t\r\n{"n": ')
    (folder / "z.jsonl").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = jsonl.records(spark, str(tmp_path)).orderBy("path", "line").collect()
        listed = {r.path for r in jsonl.files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    mine = [r for r in got if r.path.endswith("x.jsonl")]
    assert [(r.line, json.loads(r.record)["n"]) for r in mine if r.record] == [(n + 1, n) for n in range(400) if n not in (7, 9, 250)]
    assert [r.bad for r in got if r.bad] == [10, 251, 2] and {r.path for r in got} == listed
    assert [(r.line, r.record) for r in got if r.path.endswith("y.jsonl")] == [(1, '{"n": 1}'), (2, None)]
    assert jsonl.records(spark, str(tmp_path), since="2999-01-01T00:00:00").count() == 0


def test_ends_of_files(spark, tmp_path):
    pad = {"pad": "y" * 50_000}
    turn = lambda n, role: {"timestamp": f"2026-01-01T00:00:{n:02d}Z", "message": {"role": role, "content": f"t{n}"}}
    write(tmp_path / "p" / "long.jsonl", [turn(1, "user"), turn(2, "assistant"), *[pad] * 8, turn(30, "user")])
    write(tmp_path / "p" / "wide.jsonl", [{"pad": "y" * 300_000}, turn(5, "user")])
    write(tmp_path / "p" / "short.jsonl", [turn(n, "assistant") for n in range(30)])
    with open(tmp_path / "p" / "long.jsonl", "a") as more:
        more.write('{"timestamp": "2027')
    rows = jsonl.ends(spark, str(tmp_path), sessions.CLAUDE_HEAD)
    got = {r.session_id: r for r in sessions.claude_sessions(rows, sessions.files(spark, str(tmp_path)), bounded=True).withColumn("updated_at", F.col("updated_at").cast("string")).collect()}
    assert (got["long"].title, got["long"].message_count, got["long"].updated_at) == ("t1", None, "2026-01-01 00:00:30")
    assert (got["wide"].title, got["wide"].message_count, got["wide"].updated_at) == ("p", None, "2026-01-01 00:00:05")
    assert (got["short"].message_count, got["short"].updated_at) == (30, "2026-01-01 00:00:29")
    assert {r.line for r in rows.filter("path like '%long%'").collect()} == {1, 2, 3, jsonl.TAIL}
