"""Transcripts of the JSON-lines layouts: records to items to messages.

Records come from ``jsonl.records``; the session is the file's path.  Values
of the wrong type read as null, JSON values shown as text are compact JSON.
"""

from __future__ import annotations

import itertools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.coerce import iso_ms
from tidemark.operators.assemble import assemble, item
from tidemark.operators.filters import not_injected

# fixed values of the layouts
PLAN = r"(?s)<proposed_plan>\s*(.*?)\s*</proposed_plan>"
APPROVAL = "PLEASE IMPLEMENT THIS PLAN"


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _said(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False))


def _list(value: Column, path: str) -> Column:
    return F.coalesce(_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(value: Column, path: str, other: str | None = None, typed: bool = False) -> Column:
    """Texts that are not blank of a string, of a list of strings and objects, or of another value."""
    field = lambda x: F.coalesce(_get(x, "$.text"), _get(x, f"$.{other}")) if other else _get(x, "$.text")
    keep = lambda x: F.when(_is(x, "OBJECT"), F.when(_get(x, "$.type") == "text", field(x)) if typed else field(x)).when(_is(x, "STRING"), _get(x, "$"))
    there = _get(value, path, "variant")
    return F.filter(F.when(_is(there, "ARRAY"), F.transform(_list(value, path), keep)).otherwise(F.array(_get(value, path))), lambda t: _said(t))


def _parsed(records: DataFrame) -> DataFrame:
    return records.filter("record is not null").select(F.col("path").alias("session"), "line", F.try_parse_json("record").alias("v"))


def claude_items(records: DataFrame) -> DataFrame:
    """Items of the claudecode layout; ``isMeta`` records are left out."""
    v, x = F.col("v"), F.col("x")
    rows = _parsed(records).filter(~F.coalesce(_get(v, "$.isMeta", "boolean"), F.lit(False)))
    rows = rows.select("session", "line", "v", _get(v, "$.type").alias("type"), iso_ms(_get(v, "$.timestamp")).alias("at"), F.coalesce(_get(v, "$.uuid"), F.lit("")).alias("uuid"), _get(v, "$.message.content", "variant").alias("content"))
    common = {"session": F.col("session"), "line": F.col("line"), "at": F.col("at"), "message_id": F.col("uuid")}
    inner = rows.select("*", F.posexplode(_list(v, "$.message.content")).alias("i", "x")).filter(_is(x, "OBJECT"))
    kind, name, call = _get(x, "$.type"), F.coalesce(_get(x, "$.name"), F.lit("")), F.coalesce(F.trim(_get(x, "$.id")), F.lit(""))
    hides = F.trim(name).isin("TodoWrite") & (call != "")
    said = F.when(kind == "thinking", _get(x, "$.thinking")).when(kind == "text", _get(x, "$.text"))
    usage = F.when(_is(_get(v, "$.message.usage", "variant"), "OBJECT"), _get(v, "$.message.usage"))
    assistant = inner.filter(F.col("type") == "assistant").filter(kind.isin("thinking", "text") & _said(said) | (kind == "tool_use")).select(*item(
        **common, item=F.col("i"), role=F.lit("assistant"), text=said, tool=F.when(kind == "tool_use", name), call_id=F.when(kind == "tool_use", call), arguments=F.when(kind == "tool_use", _get(x, "$.input")),
        kind=F.when(kind == "thinking", "reasoning").when(kind == "text", "text").when(hides, "hidden").otherwise("tool"), model=F.nullif(_get(v, "$.message.model"), F.lit("")), usage=usage))
    success = _get(v, "$.toolUseResult.success", "boolean")
    results = inner.filter((F.col("type") == "user") & (kind == "tool_result")).select("session", "line", "i", "at", "uuid", F.trim(_get(x, "$.tool_use_id")).alias("given"), F.trim(_get(v, "$.sourceToolAssistantUUID")).alias("source"), _texts(x, "$.content", "content").alias("output"), F.when(success, "success").when(~success, "error").alias("status"))
    # a result without a call id belongs to its source's call where that made one only
    owners = assistant.filter("kind = 'tool' and call_id <> ''").groupBy("session", F.col("message_id").alias("source")).agg(F.count(F.lit(1)).alias("calls"), F.min("call_id").alias("only")).filter("calls = 1").drop("calls")
    results = results.join(owners, ["session", "source"], "left")
    results = results.select(*item(**common, item=F.col("i"), kind=F.lit("result"), output=F.col("output"), status=F.col("status"), call_id=F.coalesce(F.nullif("given", F.lit("")), F.when(F.col("source") != "", F.col("only")))))
    spoken = F.when(_is(F.col("content"), "STRING"), F.array(_get(v, "$.message.content"))).otherwise(F.transform(F.filter(_list(v, "$.message.content"), lambda y: ~F.coalesce(_get(y, "$.type") == "tool_result", F.lit(False))), lambda y: F.when(_is(y, "OBJECT"), _get(y, "$.text")).when(_is(y, "STRING"), _get(y, "$"))))
    users = rows.filter(F.col("type") == "user").select("*", F.posexplode(F.filter(spoken, _said)).alias("i", "said"))
    users = users.select(*item(**common, item=F.col("i") + 1_000_000, kind=F.lit("turn"), role=F.lit("user"), text=F.col("said")))
    outside = rows.filter(F.col("type") == "tool_result").select(*item(**common, item=F.lit(0), kind=F.lit("result"), output=_texts(v, "$.message.content", "content")))
    resets = rows.filter((F.col("type") == "tool_result") | ((F.col("type") == "user") & ~_is(F.col("content"), "STRING") & F.col("content").isNotNull())).select(*item(**common, item=F.lit(2_000_000), kind=F.lit("reset")))
    return assistant.unionByName(results).unionByName(users).unionByName(outside).unionByName(resets)


def claude_messages(records: DataFrame) -> DataFrame:
    return assemble(claude_items(records), "groups", answered="completed")


def parse_patch(raw: str) -> dict:
    """Blocks of an apply-patch text; none and ``parse_error`` where it breaks the format."""
    out: dict = {"kind": "apply_patch", "raw": raw, "content": []}
    lines = raw.splitlines()
    problem = None
    if lines[:1] != ["*** Begin Patch"]:
        problem = "no header"
    elif "*** End Patch" not in lines:
        problem = "no footer"
    body = [] if problem else lines[1 : lines.index("*** End Patch")]
    opening = re.compile(r"\*\*\* (Add|Delete|Update) File: (.*)", re.S)
    numbers = list(itertools.accumulate(bool(opening.match(x)) for x in body))
    for number, section in itertools.groupby(zip(numbers, body, strict=True), key=lambda x: x[0]):
        texts = [x for _, x in section]
        head = opening.match(texts[0])
        if not number or not head:
            problem = f"not an operation: {texts[0]}"
            break
        verb, path = head.groups()
        rest, old = texts[1:], None
        if verb == "Update" and rest and rest[0].startswith("*** Move to: "):
            target = rest.pop(0).removeprefix("*** Move to: ")
            path, old = target, path if target != path else None
        rest = [x for x in rest if x != "*** End of File"]
        if bad := [x for x in rest if not x.startswith(("@@", "+", "-", " "))]:
            problem = f"not a patch line: {bad[0]}"
            break
        if verb == "Add":
            kind, content = "write_file", "\n".join(x[1:] for x in rest if x[0] in "+ ")
        elif verb == "Delete":
            kind, content = "delete_file", ""
        elif old and not rest:
            kind, content = "move_file", ""
        else:
            heads = list(itertools.accumulate(rest, lambda h, x: x if x.startswith("@@") else h, initial=""))
            shown = [x for h, x in zip(heads, rest, strict=False) if not x.startswith("@@") or x != h]
            kind, content = "edit_file", "\n".join([f"Index: {path}", "=" * 67, f"--- {old or path}", f"+++ {path}", *shown])
        out["content"].append({"type": kind, "path": path, "old_path": old, "input": {"content": content}})
    if problem:
        out |= {"content": [], "parse_error": problem}
    return out


@F.pandas_udf(StringType())
def patch_json(raw: pd.Series) -> pd.Series:
    """``parse_patch`` as JSON text; null stays null."""
    return raw.map(lambda x: None if x is None else json.dumps(parse_patch(x), ensure_ascii=False))


def codex_items(records: DataFrame) -> DataFrame:
    """Items of the codex layout.

    A plan waits for the next visible user message before another message of
    the assistant; that message is taken as its answer and not shown.
    """
    v, x = F.col("v"), F.col("x")
    get = lambda path, kind="string": _get(v, "$.payload." + path, kind)
    rows = _parsed(records).filter((_get(v, "$.type") == "response_item") & _is(_get(v, "$.payload", "variant"), "OBJECT"))
    rows = rows.select("session", "line", "v", get("type").alias("type"), iso_ms(_get(v, "$.timestamp")).alias("at"), F.coalesce(_get(v, "$.timestamp"), F.lit("")).alias("stamp"), F.coalesce(get("role"), F.lit("unknown")).alias("role"))
    common = {"session": F.col("session"), "line": F.col("line"), "at": F.col("at"), "message_id": F.col("stamp")}

    own = F.col("role") == "assistant"
    wanted = F.when(own, "output_text").otherwise("input_text")
    texts = F.transform(F.filter(_list(v, "$.payload.content"), lambda y: _get(y, "$.type") == wanted), lambda y: F.coalesce(_get(y, "$.text"), F.lit("")))
    spoken = rows.filter(F.col("type") == "message").withColumn("texts", texts).filter(F.size("texts") > 0)
    planned = lambda t: F.nullif(F.trim(F.regexp_extract(t, PLAN, 1)), F.lit(""))
    seen = F.array_join(F.filter(F.transform("texts", lambda t: F.trim(t)), lambda t: t != ""), "\n\n")
    reply = F.when(~own & (seen != "") & not_injected(F.lit("user"), seen), seen)
    spoken = spoken.withColumns({"has_plan": own & F.exists("texts", lambda t: planned(t).isNotNull()), "reply": reply})
    ahead = Window.partitionBy("session").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("session").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    matters = F.when(own | F.col("reply").isNotNull(), F.struct("has_plan", "reply"))
    spoken = spoken.withColumns({"waiting": F.last(matters, ignorenulls=True).over(ahead), "answer": F.last(matters, ignorenulls=True).over(behind)})
    taken = F.col("reply").isNotNull() & F.coalesce(F.col("waiting.has_plan"), F.lit(False))
    good = F.ltrim(F.col("answer.reply")).startswith(APPROVAL)
    each = spoken.withColumn("taken", taken).select("*", F.posexplode("texts").alias("i", "t"))
    plan = F.when(own, planned(F.col("t")))
    last = plan.isNotNull() & (F.col("i") == F.size("texts") - 1)
    said = each.filter("not taken or i = 0").select(*item(
        **common, item=F.col("i"), role=F.col("role"), text=F.coalesce(plan, F.col("t")), kind=F.when(F.col("taken"), "reset").when(plan.isNotNull(), "plan").when(own, "text").otherwise("turn"),
        status=F.when(last & good, "success").when(plan.isNotNull(), "fail"), output=F.when(last & ~good, F.array(F.col("answer.reply")))))

    thought = rows.filter(F.col("type") == "reasoning").select("*", F.posexplode(F.filter(_list(v, "$.payload.summary"), lambda y: _get(y, "$.type") == "summary_text")).alias("i", "x"))
    thought = thought.select(*item(**common, item=F.col("i"), kind=F.lit("reasoning"), role=F.lit("assistant"), text=F.coalesce(_get(x, "$.text"), F.lit(""))))
    custom, name = F.col("type").startswith("custom"), F.coalesce(get("name"), F.lit(""))
    patch = custom & (name == "apply_patch")
    calls = rows.filter(F.col("type").isin("function_call", "custom_tool_call")).select(*item(
        **common, item=F.lit(0), kind=F.lit("tool"), role=F.lit("assistant"), call_id=F.coalesce(get("call_id"), F.lit("")), tool=F.when(patch, "patch").when(~custom & (name == "spawn_agent"), "subagent").otherwise(name),
        arguments=F.when(patch, patch_json(F.when(patch, F.coalesce(get("input"), F.lit(""))))).otherwise(F.when(custom, get("input")).otherwise(get("arguments")))))
    inside = _get(F.try_parse_json(get("output")), "$.output")
    output = F.filter(F.array(F.coalesce(F.when(custom, inside), get("output"))), lambda t: t.isNotNull())
    results = rows.filter(F.col("type").isin("function_call_output", "custom_tool_call_output")).select(*item(**common, item=F.lit(0), kind=F.lit("result"), call_id=get("call_id"), output=output))
    return said.unionByName(thought).unionByName(calls).unionByName(results)


def codex_messages(records: DataFrame) -> DataFrame:
    return assemble(codex_items(records), "sticky")


def kimi_items(records: DataFrame) -> DataFrame:
    """Items of the kimi layout's context files; they hold no times."""
    v, x = F.col("v"), F.col("x")
    rows = _parsed(records).withColumn("role", _get(v, "$.role"))
    common = {"session": F.col("session"), "line": F.col("line"), "at": F.lit(0), "message_id": F.concat(F.lit("context-"), F.col("line"))}
    users = rows.filter((F.col("role") == "user") & _said(_get(v, "$.content"))).select(*item(**common, item=F.lit(0), kind=F.lit("turn"), role=F.lit("user"), text=_get(v, "$.content")))
    mine = rows.filter(F.col("role") == "assistant")
    kind, said = _get(x, "$.type"), F.when(_get(x, "$.type") == "think", _get(x, "$.think")).when(_get(x, "$.type") == "text", _get(x, "$.text"))
    talk = mine.select("*", F.posexplode(_list(v, "$.content")).alias("i", "x")).filter(_said(said)).select(*item(**common, item=F.col("i"), kind=F.when(kind == "think", "reasoning").otherwise("text"), role=F.lit("assistant"), text=said))
    name, call = F.trim(_get(x, "$.function.name")), F.trim(_get(x, "$.id"))
    hides = name.isin("SetTodoList")
    calls = mine.select("*", F.posexplode(_list(v, "$.tool_calls")).alias("i", "x")).filter((name != "") & (call != "") & (hides | (kind == "function")))
    calls = calls.select(*item(**common, item=F.col("i") + 1_000_000, kind=F.when(hides, "hidden").otherwise("tool"), role=F.lit("assistant"), tool=name, call_id=call, arguments=_get(x, "$.function.arguments")))
    results = rows.filter(F.col("role") == "tool").select(*item(**common, item=F.lit(0), kind=F.lit("result"), call_id=F.trim(_get(v, "$.tool_call_id")), output=_texts(v, "$.content", typed=True)))
    return users.unionByName(talk).unionByName(calls).unionByName(results)


def kimi_messages(records: DataFrame) -> DataFrame:
    return assemble(kimi_items(records), "record")


def kimi_wire_items(records: DataFrame) -> DataFrame:
    """Items of the kimi layout's wire files, whose arguments come in fragments."""
    v = F.col("v")
    get = lambda path: _get(v, "$.message.payload." + path)
    seconds = _get(v, "$.timestamp", "double")
    rows = _parsed(records).select("session", "line", "v", _get(v, "$.message.type").alias("type"), F.coalesce((seconds * 1000).cast("long"), iso_ms(_get(v, "$.timestamp"))).alias("at"))
    common = {"session": F.col("session"), "line": F.col("line"), "at": F.col("at"), "message_id": F.concat(F.lit("wire-"), F.col("line"))}
    begins = rows.filter(F.col("type") == "TurnBegin")
    opened = begins.select(*item(**common, item=F.lit(0), kind=F.lit("reset")))
    users = begins.filter(_said(get("user_input[0].text"))).select(*item(**common, item=F.lit(1), kind=F.lit("turn"), role=F.lit("user"), text=get("user_input[0].text")))
    said = F.when(get("type") == "think", get("think")).when(get("type") == "text", get("text"))
    talk = rows.filter((F.col("type") == "ContentPart") & _said(said)).select(*item(**common, item=F.lit(0), kind=F.when(get("type") == "think", "reasoning").otherwise("text"), role=F.lit("assistant"), text=said))
    name, call = F.trim(get("function.name")), F.trim(get("id"))
    calls = rows.filter((F.col("type") == "ToolCall") & (name != "") & (call != "")).select(*item(**common, item=F.lit(0), kind=F.when(name.isin("SetTodoList"), "hidden").otherwise("tool"), role=F.lit("assistant"), tool=name, call_id=call, arguments=get("function.arguments")))
    more = rows.filter(F.col("type") == "ToolCallPart").select(*item(**common, item=F.lit(0), kind=F.lit("fragment"), arguments=get("arguments_part")))
    results = rows.filter(F.col("type") == "ToolResult").select(*item(**common, item=F.lit(0), kind=F.lit("result"), call_id=F.trim(get("tool_call_id")), output=F.filter(F.array(get("return_value")), _said)))
    return opened.unionByName(users).unionByName(talk).unionByName(calls).unionByName(more).unionByName(results)


def kimi_wire_messages(records: DataFrame) -> DataFrame:
    return assemble(kimi_wire_items(records), "turn")


def _filled(value: Column, path: str) -> Column:
    return F.nullif(F.trim(_get(value, path)), F.lit(""))


def _prompt(part: Column) -> Column:
    """What a subagent is asked once it has answered: the arguments' message, else all of them."""
    asked = F.coalesce(F.nullif(F.trim(F.get_json_object(part["arguments"], "$.message")), F.lit("")), part["arguments"])
    return F.when((part["tool"] == "subagent") & (F.size(part["outputs"]) > 0), asked)


def codex_enriched(messages: DataFrame) -> DataFrame:
    """Codex messages whose subagent calls carry the subagent and its nickname, as their outputs give them.

    A user message that is only a subagent's notification becomes the
    assistant's; it takes the notification's nickname, else the one its call gave.
    """
    told = lambda p, name: F.try_element_at(F.filter(F.transform(F.coalesce(p["outputs"], F.array().cast("array<string>")), lambda o: F.nullif(F.trim(F.get_json_object(o, f"$.{name}")), F.lit(""))), lambda x: x.isNotNull()), F.lit(-1))
    called = lambda p, name: F.when(p["tool"] == "subagent", told(p, name))
    rows = messages.withColumn("parts", F.transform("parts", lambda p: p.withField("subagent", called(p, "agent_id")).withField("nickname", called(p, "nickname")).withField("prompt", _prompt(p))))
    names = rows.select("session", "seq", F.explode("parts").alias("p")).filter("p.subagent is not null and p.nickname is not null")
    names = names.groupBy("session", F.col("p.subagent").alias("__agent")).agg(F.max_by("p.nickname", "seq").alias("__known"))
    first = F.col("parts")[0]
    note = F.try_parse_json(F.regexp_extract(F.trim(first["text"]), r"(?s)^<subagent_notification>\s*(.*?)\s*</subagent_notification>$", 1))
    own = (F.col("role") == "user") & (F.size("parts") == 1)
    rows = rows.withColumn("__note", F.when(own, note)).withColumns({"__agent": _filled(F.col("__note"), "$.agent_id"), "__said": _filled(F.col("__note"), "$.status.completed"), "__nick": _filled(F.col("__note"), "$.nickname")})
    rows = rows.join(names, ["session", "__agent"], "left")
    is_note = F.col("__agent").isNotNull() & F.col("__said").isNotNull()
    shown = F.array(first.withField("text", F.col("__said")).withField("subagent", F.col("__agent")).withField("nickname", F.coalesce("__nick", "__known")).withField("prompt", F.lit(None).cast("string")))
    return rows.select(*[F.when(is_note, "assistant").otherwise(F.col("role")).alias("role") if c == "role" else F.when(is_note, shown).otherwise(F.col("parts")).alias("parts") if c == "parts" else F.col(c) for c in messages.columns])


def codex_export(messages: DataFrame) -> DataFrame:
    """Codex messages as the JSON export shows them.

    A user's skill text becomes a numbered skill call, waits for agents and
    what they leave empty go, as do messages of injected context.
    """
    first = F.col("parts")[0]
    tidy = F.trim(first["text"])
    name = F.nullif(F.trim(F.regexp_extract(tidy, r"(?s)<name>\s*(.*?)\s*</name>", 1)), F.lit(""))
    skill = (F.col("role") == "user") & (F.size("parts") == 1) & tidy.startswith("<skill>") & tidy.endswith("</skill>") & name.isNotNull()
    rows = messages.withColumn("__skill", F.when(skill, name))
    number = F.count("__skill").over(Window.partitionBy("session").orderBy("seq")) - 1
    call = first.withField("kind", F.lit("tool")).withField("text", F.lit(None).cast("string")).withField("tool", F.lit("skill")).withField("call_id", F.concat(F.lit("skill:"), number)).withField("arguments", F.to_json(F.struct(F.col("__skill").alias("name")))).withField("status", F.lit("completed"))
    is_skill = F.col("__skill").isNotNull()
    rows = rows.withColumns({"parts": F.when(is_skill, F.array(call)).otherwise(F.col("parts")), "role": F.when(is_skill, "assistant").otherwise(F.col("role"))})
    rows = rows.withColumn("parts", F.filter("parts", lambda p: ~F.coalesce(p["tool"] == "wait_agent", F.lit(False)))).filter(F.size("parts") > 0)
    said = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    all_tools = F.forall("parts", lambda p: p["kind"] == "tool")
    return rows.filter(not_injected(F.col("role"), said)).withColumn("mode", F.when(all_tools, "tool")).drop("__skill")


def pi_items(records: DataFrame) -> DataFrame:
    """Items of the pi layout: every record is at most one message, a tool's output one of its own."""
    v, x = F.col("v"), F.col("x")
    m = lambda path, kind="string": _get(v, f"$.message.{path}", kind)
    kind, own = _get(v, "$.type"), F.coalesce(F.trim(_get(v, "$.message.role")), F.lit(""))
    rows = _parsed(records).filter(kind.isin("compaction", "branch_summary", "custom_message") | ((kind == "message") & _is(_get(v, "$.message", "variant"), "OBJECT")))
    told = kind != "message"
    stamp = F.coalesce(F.when(~told, m("timestamp", "bigint")), F.nullif(iso_ms(m("timestamp")), F.lit(0)), iso_ms(_get(v, "$.timestamp")))
    role = F.when(kind == "custom_message", "custom").when(told, kind).when(own == "branchSummary", "branch_summary").when(own == "compactionSummary", "compaction").when(own.isin("bashExecution", "toolResult"), "tool").when(own == "", "unknown").otherwise(own)
    rows = rows.select("session", "line", "v", kind.alias("type"), own.alias("own"), role.alias("role"), stamp.alias("at"), F.coalesce(_get(v, "$.id"), F.concat(F.lit("pi-"), F.col("line"))).alias("entry"))
    usage = F.when(_is(m("usage", "variant"), "OBJECT"), m("usage"))
    common = {"session": F.col("session"), "line": F.col("line"), "at": F.col("at"), "message_id": F.col("entry"), "role": F.col("role"), "model": F.when(_is(m("model", "variant"), "STRING"), m("model")), "usage": usage}
    short = F.when(F.col("role").isin("compaction", "branch_summary"), F.trim(F.coalesce(F.when(F.col("type") == "message", m("summary")).otherwise(_get(v, "$.summary")), F.lit(""))))
    summaries = rows.filter(short != "").select(*item(**common, item=F.lit(0), kind=F.lit("text"), text=short))
    command, output = F.coalesce(F.trim(m("command")), F.lit("")), F.filter(F.array(m("output")), _said)
    shells = rows.filter(F.col("own") == "bashExecution").filter((command != "") | (F.size(output) > 0)).select(*item(**common, item=F.lit(0), kind=F.lit("tool"), tool=F.lit("bash"), call_id=F.col("entry"), arguments=F.to_json(F.struct(command.alias("command"))), output=output))
    named = F.coalesce(F.nullif(F.trim(m("toolName")), F.lit("")), F.lit("tool"))
    results = rows.filter(F.col("own") == "toolResult").select(*item(**common, item=F.lit(0), kind=F.lit("tool"), tool=named, call_id=F.coalesce(F.nullif(F.trim(m("toolCallId")), F.lit("")), F.col("entry")), arguments=F.lit("{}"), output=_texts(v, "$.message.content", typed=True), status=F.when(m("isError", "boolean"), "error")))

    spoken = rows.filter(~F.col("role").isin("tool", "compaction", "branch_summary")).withColumn("content", F.when(F.col("type") == "message", m("content", "variant")).otherwise(_get(v, "$.content", "variant")))
    plain = spoken.filter(_is(F.col("content"), "STRING")).filter(_said(_get(F.col("content"), "$"))).select(*item(**common, item=F.lit(0), kind=F.lit("text"), text=_get(F.col("content"), "$")))
    inner = spoken.filter(_is(F.col("content"), "ARRAY")).select("*", F.posexplode(_list(F.col("content"), "$")).alias("i", "x"))
    part = F.when(_is(x, "STRING"), "bare").otherwise(_get(x, "$.type"))
    said = F.when(part == "bare", _get(x, "$")).when(part == "text", F.trim(_get(x, "$.text"))).when(part == "thinking", F.trim(_get(x, "$.thinking"))).when(part == "image", F.coalesce(_get(x, "$.mimeType"), F.lit("")))
    name, call = F.trim(_get(x, "$.name")), F.trim(_get(x, "$.id"))
    is_call = (part == "toolCall") & (name != "") & (call != "")
    listed = inner.filter(is_call | (part == "image") | (part.isin("bare", "text", "thinking") & _said(said)))
    listed = listed.select(*item(**common, item=F.col("i"), text=said, tool=F.when(is_call, name), call_id=F.when(is_call, call), arguments=F.when(is_call, _get(x, "$.arguments")), kind=F.when(is_call, "tool").when(part == "thinking", "reasoning").when(part == "image", "image").otherwise("text")))
    return summaries.unionByName(shells).unionByName(results).unionByName(plain).unionByName(listed)


def pi_messages(records: DataFrame) -> DataFrame:
    return assemble(pi_items(records), "record")
