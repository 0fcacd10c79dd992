"""Collect runs: bounded events, selection, plans, failures, merges and the report."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import collect, workflow
from tidemark.operators.filters import QuerySpec

HEADS = "provider string, session_id string, title string, created_at timestamp, updated_at timestamp, working_directory string, uri string"
MESSAGES = "provider string, session_id string, seq long, role string, text string"


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def head(name, day, hour=12, folder="/w"):
    return ("pi", name, f"T {name}", at(day, hour), at(day, hour), folder, f"pi://{name}")


@pytest.fixture
def archive(spark):
    heads = [head("a", 1), head("b", 2, 23, None), head("c", 3), head("d", 4, folder="/secret/x"), head("e", 9)]
    said = [("pi", "a", 1, "user", "please look at /src/main.py now"), ("pi", "a", 2, "assistant", "x" * 400), ("pi", "a", 3, "tool", "no event"), ("pi", "b", 1, "user", "hello"), ("pi", "c", 1, "User", "third one"), ("pi", "c", 2, "user", "<environment_context> no"), ("pi", "d", 1, "user", "hidden"), ("pi", "e", 1, None, None)]
    return spark.createDataFrame(heads, HEADS), spark.createDataFrame(said, MESSAGES)


def test_events_within_a_budget(spark):
    """The events left before the fold admit what all of them would."""
    draw = random.Random(5)
    rows = [(s, i, "user", "w" * draw.choice([1, 2, 3, 40, 41, 120, 270])) for s in range(6) for i in range(draw.choice([1, 30, 60]))]
    budget = 600
    want = []
    for s in range(6):
        used, kept = 0, 0
        for _, i, _, text in sorted(r for r in rows if r[0] == s):
            size = len(text) + 32
            if not kept or used + size <= budget:
                used, kept = used + size, kept + 1
                want.append((s, i))
    got = collect.session_events(spark.createDataFrame(rows, "s long, i long, role string, text string"), "s", "i", budget)
    assert sorted((r.s, r.i) for r in got.collect()) == want
    tiny = collect.session_events(spark.createDataFrame(rows[:3], "s long, i long, role string, text string"), "s", "i", 5)
    assert tiny.count() == 1


def test_selection_and_plan(spark, archive):
    sessions, messages = archive
    days = workflow.Range(dt.date(2024, 1, 1), dt.date(2024, 1, 3), "Asia/Tokyo", ("/secret",))
    found = workflow.selected(sessions, messages, days)
    assert {(r.session_id, str(r.day)) for r in found.collect()} == {("a", "2024-01-01"), ("b", "2024-01-03"), ("c", "2024-01-03")}
    latest = workflow.selected(sessions, messages, days, QuerySpec(limit=1))
    assert [r.session_id for r in latest.collect()] == ["c"]
    assert [r.session_id for r in workflow.selected(sessions, messages, days, QuerySpec("THIRD")).collect()] == ["c"]
    rendered = spark.createDataFrame([("pi://b", " what\n b  shows ")], "session string, text string")
    plan = {r.session: r for r in workflow.planned(found, messages, zone=days.zone, rendered=rendered).collect()}
    assert plan["pi://a"].body.split("\n") == ["[user_intent] role=user files=/src/main.py text=please look at /src/main.py now", "[assistant_key] role=assistant text=" + "x" * 277 + "..."]
    assert plan["pi://b"].body == "[fallback] role=system text=what b shows" and plan["pi://c"].body == "[user_intent] role=user text=third one"
    shown = [json.loads(x) for x in plan["pi://b"].prompt.split("\n")[-2:]]
    assert shown[0]["content"] == "title: T b\nproject_directory: (unknown)\ncreated_at: 2024-01-03T08:00:00\nchunk: 1/1" and shown[0]["length"] == len(shown[0]["content"])
    assert shown[1]["source"] == "pi://b#chunk-1/events" and not any(r.truncated for r in plan.values())
    cut = workflow.planned(found, messages, budget=100, target=40)
    assert {r.session: (r.chunks, r.truncated) for r in cut.collect()}["pi://a"] == (1, True)
    two = workflow.planned(found.filter("session_id = 'a'"), messages, target=100).orderBy("chunk").collect()
    assert [(r.chunk, r.chunks, r.events) for r in two] == [(0, 2, 1), (1, 2, 1)]
    assert {(r.name, r.sessions, r.chunks) for r in workflow.overview(found, workflow.planned(found, messages)).collect()} == {("pi", 3, 3), ("(all)", 3, 3)}
    assert workflow.planned(found.limit(0), messages).count() == 0 and workflow.planned(found, messages.limit(0)).count() == 3


def speaker():
    """The outside model, made here so that tasks get it by value."""
    fields = collect.PM_FIELDS

    def model(prompt):
        if prompt.startswith("Merge"):
            return json.dumps({"topics": ["merged"], "key_actions": ["merged"]})
        if prompt.startswith("Write"):
            return f"# Report\n{prompt}"
        if "T c" in prompt:
            raise RuntimeError("no answer")
        if "T wide" in prompt:
            return "Here: " + json.dumps({name: [f"{name} {i}" for i in range(12)] for name in fields})
        return json.dumps({"topics": ["One", "one ", "two"], "key_actions": ["did it"], "errors": "bad"})

    return model


def test_run(spark, archive, tmp_path):
    sessions, messages = archive
    days = workflow.Range(dt.date(2024, 1, 1), dt.date(2024, 1, 4), deny=("/secret",))
    done = workflow.run(sessions, messages, days, speaker(), str(tmp_path / "out"), diagnostics=str(tmp_path / "log")).collect()
    assert [(r.file, r.sessions, r.depth, r.failed) for r in done] == [("tidemark-collect-20240101-20240104.md", 2, 1, 1)]
    text = (tmp_path / "out" / done[0].file).read_text()
    lines = [json.loads(x) for x in text.split("\n") if x.startswith("{")]
    assert text.startswith("# Report") and "- session_count: 2\n- reduction_depth: 1" in text and "details may be missing" not in text
    assert json.loads(lines[0]["content"])["topics"] == ["One", "two"] and json.loads(lines[0]["content"])["errors"] == ["bad"]
    assert [(x["source"], json.loads(x["content"])) for x in lines[1:]] == [
        ("collect://final/date/1", {"bucket": "2024-01-01", "values": ["T a: did it; bad"]}),
        ("collect://final/date/2", {"bucket": "2024-01-02", "values": ["T b: did it; bad"]}),
        ("collect://final/project/1", {"bucket": "(unknown)", "values": ["T b: did it; bad"]}),
        ("collect://final/project/2", {"bucket": "/w", "values": ["T a: did it; bad"]}),
    ]
    logged = spark.read.json(str(tmp_path / "log")).collect()
    assert [(r.event, r.session, r.error) for r in logged] == [("chunk_failed", "pi://c", "no answer")]
    with pytest.raises(RuntimeError, match="all 1 sessions failed"):
        workflow.run(sessions.filter("session_id = 'c'"), messages, days, speaker(), str(tmp_path / "none"))
    nobody = workflow.Range(dt.date(2023, 1, 1), dt.date(2023, 1, 4))
    assert workflow.run(sessions, messages, nobody, speaker(), str(tmp_path / "none")).count() == 0


def test_large_summaries_are_merged(spark):
    heads = spark.createDataFrame([head("wide", 1)], HEADS)
    said = spark.createDataFrame([("pi", "wide", i, "user", f"word {i} " + "y" * 200) for i in range(4)], MESSAGES)
    plan = workflow.planned(workflow.selected(heads, said, workflow.Range(dt.date(2024, 1, 1), dt.date(2024, 1, 1))), said, target=500)
    assert plan.count() == 2
    got, failed = workflow.summarised(plan, speaker())
    assert [(r.topics, r.notes) for r in got.collect()] == [(["merged"], [])] and failed.count() == 0
    whole, _ = workflow.summarised(plan, speaker(), large=1000)
    assert whole.select(F.size("notes")).first()[0] == 12


def test_first_object():
    assert collect.first_object('so {x} then {"a": {"b": "}"}} and {"c": 1}') == '{"a": {"b": "}"}}'
    for nothing in ("", "none", "{", "[1, 2]"):
        with pytest.raises(ValueError):
            collect.first_object(nothing)
