"""Transcripts of the JSON-lines layouts on small files."""

import json

import pytest

from tidemark.sources import jsonl, transcripts


def told(spark, tmp_path, lines, read):
    """(role, mode, [(kind, text or tool, outputs, status)]) of each message in order."""
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines))
    rows = read(jsonl.records(spark, str(tmp_path))).orderBy("session", "seq").collect()
    return [(r.role, r.mode, [(p.kind, p.tool or p.text, p.outputs, p.status) for p in r.parts]) for r in rows], rows


def claude(kind, uuid, content, **more):
    return {"type": kind, "uuid": uuid, "timestamp": "2026-01-01T00:00:00Z", "message": {"role": kind, "content": content, **more.pop("message", {})}, **more}


def test_claude(spark, tmp_path):
    lines = [
        claude("user", "u1", "do it"),
        claude("user", "m", "meta", isMeta=True),
        claude("assistant", "a1", [{"type": "thinking", "thinking": "hm"}], message={"model": "m1", "usage": {"input_tokens": 3}}),
        claude("assistant", "a2", [{"type": "text", "text": "sure"}, {"type": "text", "text": "sure"}, {"type": "text", "text": "  "}]),
        claude("assistant", "a3", [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": 1}}, {"type": "tool_use", "id": "t2", "name": "TodoWrite", "input": {}}]),
        claude("user", "r1", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "one"}, "two"]}, {"type": "text", "text": "and"}, "more"]),
        claude("user", "r2", [{"type": "tool_result", "tool_use_id": "t2", "content": "hidden"}]),
        claude("user", "r3", [{"type": "tool_result", "tool_use_id": "zz", "content": "lost"}]),
        claude("assistant", "a4", [{"type": "tool_use", "id": "t3", "name": "Run", "input": {}}]),
        claude("user", "r4", [{"type": "tool_result", "content": "by source"}], sourceToolAssistantUUID="a4", toolUseResult={"success": False}),
        claude("tool_result", "x", "outside"),
        {"type": "user"},
    ]
    got, rows = told(spark, tmp_path, lines, transcripts.claude_messages)
    assert got == [
        ("user", None, [("turn", "do it", None, None)]),
        ("assistant", None, [("reasoning", "hm", None, None), ("text", "sure", None, None), ("tool", "Read", ["one", "two"], "completed")]),
        ("user", None, [("turn", "and", None, None), ("turn", "more", None, None)]),
        ("tool", None, [("text", "lost", None, None)]),
        ("assistant", "tool", [("tool", "Run", ["by source"], "error")]),
        ("tool", None, [("text", "outside", None, None)]),
    ]
    assert (rows[1].model, json.loads(rows[1].usage), rows[1].message_id) == ("m1", {"input_tokens": 3}, "a1")
    assert json.loads(rows[1].parts[2].arguments) == {"p": 1}


def codex(kind, at=0, **payload):
    return {"type": "response_item", "timestamp": f"2026-01-01T00:00:{at:02d}Z", "payload": {"type": kind, **payload}}


def says(role, *texts, at=0):
    return codex("message", at, role=role, content=[{"type": "output_text" if role == "assistant" else "input_text", "text": x} for x in texts])


def test_codex(spark, tmp_path):
    patch = "*** Begin Patch\n*** Add File: a.py\n+x\n*** End Patch"
    lines = [
        {"type": "session_meta", "payload": {"id": "s"}},
        says("user", "plan it"),
        codex("reasoning", 1, summary=[{"type": "summary_text", "text": "hm"}]),
        says("assistant", "<proposed_plan>\nsteps\n</proposed_plan>", at=2),
        says("user", "<environment_context>x", at=3),
        says("user", "no, shorter", at=4),
        says("assistant", "<proposed_plan>less</proposed_plan>", at=5),
        says("user", "PLEASE IMPLEMENT THIS PLAN now", at=6),
        codex("function_call", 7, name="exec_command", call_id="c1", arguments='{"cmd": "ls"}'),
        says("assistant", "looking", at=8),
        codex("custom_tool_call", 9, name="apply_patch", call_id="c2", input=patch),
        codex("function_call_output", 10, call_id="c1", output="files"),
        codex("function_call_output", 11, call_id="c1", output={"more": 1}),
        codex("custom_tool_call_output", 12, call_id="c2", output='{"output": "ok", "metadata": {}}'),
        codex("function_call_output", 13, call_id="none", output="orphan"),
        codex("function_call", 14, name="spawn_agent", call_id="c3", arguments="not json"),
    ]
    got, rows = told(spark, tmp_path, lines, transcripts.codex_messages)
    assert got == [
        ("user", None, [("turn", "plan it", None, None)]),
        ("assistant", None, [("reasoning", "hm", None, None), ("plan", "steps", ["no, shorter"], "fail")]),
        ("user", None, [("turn", "<environment_context>x", None, None)]),
        ("assistant", None, [("plan", "less", None, "success")]),
        ("assistant", "tool", [("tool", "exec_command", ["files", '{"more":1}'], None)]),
        ("assistant", None, [("text", "looking", None, None), ("tool", "patch", ["ok"], None), ("tool", "subagent", None, None)]),
        ("tool", None, [("text", "orphan", None, None)]),
    ]
    assert json.loads(rows[5].parts[1].arguments)["content"] == [{"type": "write_file", "path": "a.py", "old_path": None, "input": {"content": "x"}}]


@pytest.mark.parametrize(
    ("body", "kinds", "content"),
    [
        ("*** Delete File: a", ["delete_file"], ""),
        ("*** Update File: a\n*** Move to: b", ["move_file"], ""),
        ("*** Update File: a\n*** Move to: b\n@@ f\n-x\n+y\n@@ f\n z", ["edit_file"], "Index: b\n" + "=" * 67 + "\n--- a\n+++ b\n@@ f\n-x\n+y\n z"),
        ("*** Add File: a\n+1\n+2\n*** End of File\n*** Add File: b\n+3", ["write_file", "write_file"], "1\n2"),
        ("*** Update File: a\nbad", [], None),
        ("bad", [], None),
    ],
)
def test_patch(body, kinds, content):
    got = transcripts.parse_patch(f"*** Begin Patch\n{body}\n*** End Patch\n")
    assert [x["type"] for x in got["content"]] == kinds and ("parse_error" in got) == (not kinds)
    assert content is None or got["content"][0]["input"]["content"] == content


@pytest.mark.parametrize("raw", ["", "x", "*** Begin Patch\n*** Delete File: a"])
def test_broken_patch(raw):
    assert transcripts.parse_patch(raw)["content"] == [] and transcripts.parse_patch(raw)["parse_error"]


def test_kimi(spark, tmp_path):
    call = lambda i, name: {"type": "function", "id": i, "function": {"name": name, "arguments": "{}"}}
    lines = [
        {"role": "_checkpoint", "id": 0},
        {"role": "user", "content": "hello"},
        {"role": "assistant", "content": [{"type": "think", "think": "hm"}, {"type": "text", "text": "hi"}], "tool_calls": [call("a", "Shell"), call("b", "SetTodoList")]},
        {"role": "tool", "tool_call_id": "a", "content": [{"type": "text", "text": "out"}, {"type": "image"}]},
        {"role": "tool", "tool_call_id": "b", "content": "hidden"},
        {"role": "assistant", "content": "plain", "tool_calls": [call("c", "Grep")]},
        {"role": "tool", "tool_call_id": "d", "content": "lost"},
    ]
    got, _ = told(spark, tmp_path, lines, transcripts.kimi_messages)
    assert got == [
        ("user", None, [("turn", "hello", None, None)]),
        ("assistant", None, [("reasoning", "hm", None, None), ("text", "hi", None, None), ("tool", "Shell", ["out"], None)]),
        ("assistant", "tool", [("tool", "Grep", None, None)]),
        ("tool", None, [("text", "lost", None, None)]),
    ]


def test_kimi_wire(spark, tmp_path):
    wire = lambda kind, **payload: {"timestamp": 1700000000.5, "message": {"type": kind, "payload": payload}}
    lines = [
        wire("TurnBegin", user_input=[{"text": "go"}]),
        wire("ContentPart", type="think", think="hm"),
        wire("ToolCall", id="a", function={"name": "Shell", "arguments": '{"x"'}),
        wire("ToolCallPart", arguments_part=': "y'),
        wire("ToolCallPart", arguments_part='"}'),
        wire("ToolResult", tool_call_id="a", return_value="out"),
        wire("ToolCall", id="b", function={"name": "SetTodoList", "arguments": ""}),
        wire("ToolCallPart", arguments_part="[1]"),
        wire("ContentPart", type="text", text="done"),
        wire("TurnBegin", user_input=[]),
        wire("ContentPart", type="text", text="more"),
    ]
    got, rows = told(spark, tmp_path, lines, transcripts.kimi_wire_messages)
    assert got == [
        ("user", None, [("turn", "go", None, None)]),
        ("assistant", "tool", [("reasoning", "hm", None, None), ("tool", "Shell", ["out"], None), ("text", "done", None, None)]),
        ("assistant", None, [("text", "more", None, None)]),
    ]
    assert json.loads(rows[1].parts[1].arguments) == {"x": "y"} and rows[0]["at"] == 1700000000500


def test_pi(spark, tmp_path):
    entry = lambda i, **m: {"type": "message", "id": i, "timestamp": "2026-01-01T00:00:01Z", "message": m}
    lines = [
        {"type": "session", "id": "s"},
        entry("1", role="user", content="hi", timestamp=1_700_000_000_000),
        entry("2", role="assistant", model="m", content=[{"type": "thinking", "thinking": " hm "}, {"type": "text", "text": " ok "}, "bare", {"type": "toolCall", "id": "c", "name": "read", "arguments": {"p": 1}}, {"type": "image", "mimeType": "image/png"}, {"type": "toolCall", "id": "", "name": "x"}]),
        entry("3", role="toolResult", toolName="read", toolCallId="c", isError=True, content=[{"type": "text", "text": "no"}]),
        entry("4", role="bashExecution", command="ls", output="a"),
        entry("5", role="bashExecution", command=" ", output=" "),
        entry("6", role="assistant", content=[{"type": "toolCall", "id": "d", "name": "run", "arguments": {}}]),
        {"type": "compaction", "id": "7", "summary": " short "},
        entry("8", role="branchSummary", summary="branch"),
        {"type": "custom_message", "id": "9", "content": ["note"]},
        entry("10", role="user", content=[]),
        {"type": "session_info", "name": "title"},
    ]
    got, rows = told(spark, tmp_path, lines, transcripts.pi_messages)
    assert got == [
        ("user", None, [("text", "hi", None, None)]),
        ("assistant", None, [("reasoning", "hm", None, None), ("text", "ok", None, None), ("text", "bare", None, None), ("tool", "read", None, None), ("image", "image/png", None, None)]),
        ("tool", "tool", [("tool", "read", ["no"], "error")]),
        ("tool", "tool", [("tool", "bash", ["a"], None)]),
        ("assistant", "tool", [("tool", "run", None, None)]),
        ("compaction", None, [("text", "short", None, None)]),
        ("branch_summary", None, [("text", "branch", None, None)]),
        ("custom", None, [("text", "note", None, None)]),
    ]
    assert [r.message_id for r in rows] == ["1", "2", "3", "4", "6", "7", "8", "9"] and rows[0]["at"] == 1_700_000_000_000 and rows[1]["at"] == 1_767_225_601_000


def test_empty(spark, tmp_path):
    for read in (transcripts.claude_messages, transcripts.codex_messages, transcripts.kimi_messages, transcripts.kimi_wire_messages, transcripts.pi_messages):
        got, _ = told(spark, tmp_path, [{"type": "other"}, {"message": None, "payload": []}], read)
        assert got == []
