"""Index upkeep, export targets, summaries and codex enrichment on small inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import collect, index
from tidemark.sources import jsonl, sinks, transcripts

INDEX = "provider string, session_id string, signature string, title string, content string, last_seen timestamp"


def test_index(spark):
    old, now = datetime(2026, 1, 1), datetime(2026, 2, 15)
    rows = [("p", "same", "1", "t", "kept", old), ("p", "changed", "1", "t", "before", old), ("p", "broken", "1", "t", "before", old), ("p", "unseen", "1", "t", "away", old)]
    known = spark.createDataFrame(rows, INDEX)
    seen = spark.createDataFrame([("p", "same", "1", "t"), ("p", "changed", "2", "u"), ("p", "broken", "2", "u"), ("p", "new", "1", "n"), ("p", "unread", "1", "n"), ("p", "new", "1", "n")], "provider string, session_id string, signature string, title string")
    corpus = spark.createDataFrame([("p", "changed", "after"), ("p", "new", ""), ("p", "broken", None), ("p", "same", "not read")], "provider string, session_id string, content string")
    got = index.refresh(known, seen, corpus, F.lit(now))
    assert {r.session_id: (r.signature, r.title, r.content, r.last_seen) for r in got.collect()} == {
        "same": ("1", "t", "kept", now), "changed": ("2", "u", "after", now), "broken": ("1", "t", "before", now), "unseen": ("1", "t", "away", old), "new": ("1", "n", "", now)}
    assert sorted(r.session_id for r in index.stale(known, seen).distinct().collect()) == ["broken", "changed", "new", "unread"]
    assert {r.session_id for r in index.evict(got, F.lit(now)).collect()} == {"same", "changed", "broken", "new"}
    assert {r.session_id for r in index.refresh(known, seen, corpus, F.lit(now), rebuild=True).collect()} == {"same", "changed", "new"}
    assert index.refresh(known.limit(0), seen.limit(0), corpus.limit(0), F.lit(now)).count() == 0


def test_exports(spark, tmp_path):
    assert sinks.parse_formats("md, JSON,markdown") == ["markdown", "json"]
    with pytest.raises(ValueError):
        sinks.parse_formats("json,,raw")
    plan = sinks.export_plan(spark.createDataFrame([("a",), ("b",), ("a",), ("A/x",)], "s string"), "s", ["json", "raw"], "/out/").collect()
    assert {(r.s, r.collides) for r in plan} == {("a", True), ("b", False), ("A/x", False)} and len(plan) == 8
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_bytes(b"\xff\n{}")
    (done,) = sinks.raw_copies(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert done.bytes == 4 and open(done.copy, "rb").read() == b"\xff\n{}" and len(list((tmp_path / "out").iterdir())) == 1


def test_list_line(spark):
    row = spark.sql("select '/a/b/c' as cwd, repeat('m', 30) as model, '' as branch, cast(null as bigint) as n, timestamp'2026-01-02 03:04:05' as at, 'pi://1' as uri, array(' ', 'x', repeat('y', 60)) as l")
    line, few = row.select(sinks.list_line(*[F.col(c) for c in ("cwd", "model", "branch", "n", "at", "uri")]), sinks.few(F.col("l"))).first()
    assert line == f"cwd=b/c | model={'m' * 21}... | msgs=unknown | updated=2026-01-02 03:04 | uri=pi://1" and few == f"x, {'y' * 45}..."


def test_summaries(spark):
    chunks = spark.createDataFrame([("s", 0, "good"), ("s", 1, "bad"), ("t", 0, "fenced")], "session string, chunk int, prompt string")
    said = {"good": '{"topics": ["A", " a ", 5], "notes": "one", "errors": {"x": 1}}', "bad": "nothing", "fenced": '```json\n{"topics": ["b", ""]}\n```'}
    got = collect.summarise(chunks, said.__getitem__).select("*", *collect.summary(F.col("payload"))).orderBy("session", "chunk").collect()
    assert [(r.topics, r.notes, r.errors, r.error is None) for r in got] == [(["A", "5"], ["one"], [], True), ([], [], [], False), (["b"], [], [], True)]


def test_reduction_equals_the_tree(spark):
    rows = [(i, [f"Item {i * j % 23}" for j in range(5)]) for i in range(70)] + [(70, []), (71, ["  ", "ITEM 3"])]
    level = [x for _, x in rows]

    def fold(items):
        out = {}
        for x in items:
            if x.strip():
                out.setdefault(" ".join(x.split()).lower(), " ".join(x.split()))
        return list(out.values())[:12]

    while len(level) > 1:
        level = [fold([x for part in level[i : i + 8] for x in part]) for i in range(0, len(level), 8)]
    docs = spark.createDataFrame(rows, "id int, topics array<string>")
    assert [r.item for r in collect.reduce_summaries(docs, ["id"], ("topics",)).orderBy("n").collect()] == level[0]
    assert collect.merge_summaries(docs.withColumn("g", F.lit(1)), ["g"], ["id"], ("topics",)).first().topics == level[0]


def test_codex_enrichment(spark, tmp_path):
    item = lambda kind, **payload: {"type": "response_item", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": kind, **payload}}
    user = lambda text: item("message", role="user", content=[{"type": "input_text", "text": text}])
    note = lambda **x: user(f"<subagent_notification>{json.dumps(x)}</subagent_notification>")
    lines = [
        user("<skill><name>tidy</name></skill>"),
        item("function_call", name="spawn_agent", call_id="c", arguments='{"message": "go"}'),
        item("function_call_output", call_id="c", output='{"agent_id": "7", "nickname": "Ann"}'),
        item("function_call", name="wait_agent", call_id="w", arguments="{}"),
        note(agent_id="7", status={"completed": "done"}),
        note(agent_id="8", status={}),
        user("<environment_context>"),
    ]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    rich = transcripts.codex_enriched(transcripts.codex_messages(jsonl.records(spark, str(tmp_path))))
    got = transcripts.codex_export(rich).orderBy("seq").collect()
    assert [(r.role, r.mode, [(p.tool or p.text, p.subagent, p.nickname) for p in r.parts]) for r in got] == [
        ("assistant", "tool", [("skill", None, None)]),
        ("assistant", "tool", [("subagent", "7", "Ann")]),
        ("assistant", None, [("done", "7", "Ann")]),
        ("user", None, [('<subagent_notification>{"agent_id": "8", "status": {}}</subagent_notification>', None, None)]),
    ]
    assert got[0].parts[0].call_id == "skill:0"
