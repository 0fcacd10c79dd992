"""Transcripts of the SQLite layouts on small files."""

import json
import sqlite3

import pytest

from tidemark.sources.sqlite import SqliteSessions
from tidemark.sources.stores import keyed_messages, relational_messages


def table(spark, path, name):
    spark.dataSource.register(SqliteSessions)
    return spark.read.format("sqlite_sessions").option("path", str(path)).option("table", name).load()


def test_relational(spark, tmp_path):
    path = tmp_path / "o.db"
    db = sqlite3.connect(path)
    db.executescript("create table message(id text primary key, session_id text, time_created int, data text); create table part(id text primary key, message_id text, time_created int, data text);")
    messages = [("m2", "s", 20, {"role": "assistant", "modelID": "x", "cost": "oops", "tokens": [], "time": {"completed": 25}}), ("m1", "s", 10, {"role": "user"}), ("m3", "s", 30, None), ("m4", "s", 40, {"role": 7, "cost": 1.5})]
    db.executemany("insert into message values (?,?,?,?)", [(a, b, c, json.dumps(d) if d else "{bad") for a, b, c, d in messages])
    parts = [("p1", "m1", 1, {"type": "text", "text": "hi"}), ("p3", "m2", 3, {"type": "tool", "tool": "bash", "callID": "c", "state": {"status": "completed"}}), ("p2", "m2", 2, {"type": "reasoning", "text": 5}), ("p4", "m2", 4, {"type": "odd", "x": 1}), ("p5", "m2", 5, [1]), ("p6", "m2", 6, {"type": "step-finish", "reason": "stop"})]
    db.executemany("insert into part values (?,?,?,?)", [(a, b, c, json.dumps(d)) for a, b, c, d in parts])
    db.commit()
    got = relational_messages(table(spark, path, "message"), table(spark, path, "part")).orderBy("seq").collect()
    assert [(r.seq, r.message_id, r.role, r.model, r.cost, r.usage) for r in got] == [(1, "m1", "user", None, 0.0, "{}"), (2, "m2", "assistant", "x", 0.0, "{}"), (3, "m4", "unknown", None, 1.5, "{}")]
    assert [(p.kind, p.text, p.tool, p.state, p.reason) for p in got[1].parts] == [("reasoning", "", None, None, None), ("tool", None, "bash", '{"status":"completed"}', None), ("odd", None, None, None, None), ("step-finish", None, None, None, "stop")]
    assert got[2].parts == [] and got[1].completed == 25


def test_keys_and_values(spark, tmp_path):
    path = tmp_path / "c.vscdb"
    db = sqlite3.connect(path)
    db.execute("create table cursorDiskKV(key text primary key, value text)")
    put = lambda key, value: db.execute("insert into cursorDiskKV values (?, ?)", (key, value if value is None else json.dumps(value)))
    at = lambda n: {"clientRpcSendTime": 1_700_000_000_000 + n}
    for name in "ABC":
        put(f"composerData:{name}", {"createdAt": 1_700_000_000_000})
    put("bubbleId:A:1", {"type": 1, "text": "go", "modelInfo": {"modelName": "m"}, "timingInfo": at(1)})
    put("bubbleId:A:2", {"type": 2, "codeBlocks": [{"content": " x "}, {"content": "y"}], "timingInfo": at(2)})
    put("bubbleId:A:3", {"type": 2, "toolFormerData": {"name": "read", "params": '{"p": 1}', "result": "r", "messageId": "2", "status": "ok"}, "timingInfo": at(3)})
    put("bubbleId:A:4", {"type": 2, "toolFormerData": {"name": "run_agent", "rawArgs": "plain", "additionalData": {"subagentComposerId": "B"}}, "timingInfo": at(4)})
    put("bubbleId:A:5", {"type": 2, "toolFormerData": {"name": "create_plan", "params": {"plan": "do"}, "additionalData": {"reviewData": {"selectedOption": "Accept"}}}, "timingInfo": at(50)})
    put("bubbleId:A:6", None)
    put("bubbleId:B:1", {"type": 2, "text": "from b", "timingInfo": at(10), "toolFormerData": {"name": "task", "additionalData": {"subagentComposerId": "C"}}})
    put("bubbleId:C:1", {"type": 2, "thinking": {"text": "from c"}, "timingInfo": at(11), "toolFormerData": {"name": "task", "additionalData": {"subagentComposerId": "B"}}})
    db.commit()
    got = keyed_messages(table(spark, path, "cursorDiskKV")).filter("session = 'A'").orderBy("seq").collect()
    assert [(r.message_id, r.role, r.mode, r.model, [(p.kind, p.text or p.tool, p.output, p.status) for p in r.parts]) for r in got] == [
        ("6", "assistant", None, None, [("text", "[corrupted message]", None, None)]),
        ("1", "user", None, "m", [("text", "go", None, None)]),
        ("2", "assistant", None, "m", [("text", "x\n\ny", None, None), ("tool", "read", "r", "ok")]),
        ("4:tool", "tool", "tool", "m", [("tool", "subagent", None, None)]),
        ("B:subagent-output", "assistant", None, None, [("text", "from b", None, None), ("text", "from c", None, None)]),
        ("5", "assistant", None, "m", [("plan", "do", None, "success")]),
    ]
    assert json.loads(got[2].parts[1].arguments) == {"p": 1} and json.loads(got[3].parts[0].arguments) == {"_raw": "plain"}


def plain_answers(said, calls, composers, session):
    """Answers to the calls of a session, call by call: [(row, child, texts, time)]."""
    memo = {}

    def answer(child, inside):
        if child in inside or child not in composers:
            return None
        if child not in memo:
            memo[child] = told(child, inside | {child})
        return memo[child]

    def told(name, inside):
        rows = [(at, row, 0, [(at, text)]) for row, at, text in said.get(name, [])]
        for row, child in sorted(calls.get(name, [])):
            if below := answer(child, inside):
                rows.append((max(t for t, _ in below), row, 2, below))
        return [part for r in sorted(rows) for part in r[3]] or None

    found = [(row, child, answer(child, frozenset())) for row, child in sorted(calls.get(session, []))]
    return [(row, child, [t for _, t in parts], max(t for t, _ in parts)) for row, child, parts in found if parts]


@pytest.mark.parametrize("seed, circles", [(1, False), (2, True), (3, True)])
def test_answers_of_subagents(spark, seed, circles):
    """Trees, shared subagents, circles, calls to itself, to the same twice and to unknown ones."""
    import random

    from pyspark.sql import functions as F

    from tidemark.sources.subagents import completions

    draw = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    said, calls, row = {}, {}, 0
    for i, name in enumerate(names):
        for _ in range(draw.randrange(4)):
            row += 1
            said.setdefault(name, []).append((row, draw.randrange(40), f"t{row}"))
        for _ in range(draw.randrange(4)):
            row += 1
            calls.setdefault(name, []).append((row, draw.choice(names if circles else names[i + 1 :] + ["gone"])))
    composers = set(names) - {"n13"}
    part = "array<struct<at bigint, text string>>"
    messages = spark.createDataFrame([(n, at, r, 0, f"m{r}" if r % 3 else None, [(at, t)]) for n, v in said.items() for r, at, t in v], f"session string, at long, home long, place int, model string, said {part}")
    asked = spark.createDataFrame([(n, r, c) for n, v in calls.items() for r, c in v], "session string, row long, child string")
    known = spark.createDataFrame([(n, None, "k") for n in composers], "session string, own string, kind string")
    got = {}
    for r in completions(messages, asked, known).collect():
        got.setdefault(r.session, []).append((r.row, r.child, [p.text for p in r.said], r.at))
    want = {n: plain_answers(said, calls, composers, n) for n in names}
    assert {n: sorted(v) for n, v in got.items()} == {n: v for n, v in want.items() if v}
    assert completions(messages, asked.limit(0), known).count() == 0
    assert completions(messages, asked, known.limit(0)).select(F.count("said")).first()[0] == 0


def test_keyword_in_the_store(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.functions.text import has_literal
    from tidemark.sources import sqlite

    path = tmp_path / "o.db"
    db = sqlite3.connect(path)
    db.executescript("create table session(id text primary key, title text, time_created int); create table message(id text primary key, session_id text, time_created int, data text); create table part(id text primary key, message_id text, time_created int, data text);")
    said = ['a "quoted" \\ back', "straße ΟΔΟΣ", "İstanbul", "line\nfeed", "Kelvin K ſ", None, "plain %_ text"]
    for i, text in enumerate(said):
        db.execute("insert into session values (?, ?, 1)", (f"s{i}", None if i % 2 else f"Title {i}"))
        db.execute("insert into message values (?, ?, 1, '{}')", (f"m{i}", f"s{i}"))
        db.execute("insert into part values (?, ?, 1, ?)", (f"p{i}", f"m{i}", json.dumps({"type": "text", "text": text}) if text else "{bad"))
    db.commit()
    parts = sqlite.load(spark, str(path), "part")
    for literal in ('"QUOTED" \\', "STRAßE", "οδος", "istan", "e\nF", "kelvin k S", "%_", "title 2", "nothing"):
        want = {f"s{r.id[1:]}" for r in parts.filter(has_literal(F.get_json_object("data", "$.text"), literal)).collect()} | ({"s2"} if literal == "title 2" else set())
        assert {r.session_id for r in sqlite.keyword_sessions(spark, str(path), literal).collect()} == want, literal
    # what the store was asked before leaves nothing behind
    assert parts.count() == len(said) and sqlite.load(spark, str(path), "part").count() == len(said)
    assert sqlite.load(spark, str(path), "part", ("data:$.text", "=", "İstanbul")).count() == 1
