"""Queries that write ``conversations`` as archives of a layout, read them back and give what the readers make of them.

Archives lie below ``spark.checkpoint.dir``, one file a conversation; the SQL
works on the table itself, so a row that a writer or reader loses shows.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import views
from tidemark.operators.scratch import place
from tidemark.plans.catalog import ORACLES, QUERIES, _query, _t
from tidemark.sources import jsonl, sessions, sinks, sqlite, stores, transcripts
from tidemark.streaming import wire

__all__ = ["ORACLES", "QUERIES"]

START = 1_704_067_200


def _stamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX")


def _at() -> Column:
    return _stamp(START + F.col("conv_id") * 60 + F.col("turn"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


def _folder() -> Column:
    return F.concat(F.lit("/w/p"), F.col("conv_id") % 5)


def _line(of: DataFrame, n: Column, record: Column) -> DataFrame:
    return of.select("conv_id", n.cast("long").alias("n"), F.to_json(record).alias("record"))


def _write(lines: DataFrame, root: str, name: Column) -> None:
    """Lines (conv_id, n, record) as one JSON-lines file a conversation."""
    content = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "record"))), lambda x: x["record"]), "\n"), F.lit("\n"))
    sinks.write_files(lines.groupBy("conv_id").agg(content.alias("content")).select(name.alias("file"), "content"), root)


def _named(**columns: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in columns.items()])


def _claude(spark: SparkSession, sf_dir: str) -> str:
    root, mine = place(spark, "claudecode"), F.col("role") == "assistant"
    usage = F.when(mine, _named(input_tokens=F.col("turn"), output_tokens=F.lit(2)))
    content = F.when(mine, F.to_json(F.array(_named(type=F.lit("text"), text=F.col("text"))))).otherwise(F.to_json(F.array("text")))
    said = F.when(mine, F.parse_json(content)).otherwise(F.try_variant_get(F.parse_json(content), "$[0]", "variant"))
    message = _named(role=F.col("role"), content=said, model=F.when(mine, F.concat(F.lit("m"), F.col("turn") % 4)), usage=usage)
    turns = _turns(spark, sf_dir)
    _write(_line(turns, F.col("turn"), _named(type=F.col("role"), timestamp=_at(), uuid=F.concat(F.lit("u"), "turn"), cwd=_folder(), version=F.lit("1"), message=message)), root, F.concat(F.lit("proj/"), "conv_id", F.lit(".jsonl")))
    entry = _named(sessionId=F.col("conv_id").cast("string"), summary=F.concat(F.lit(" Index "), "conv_id"))
    index = turns.filter("conv_id % 10 = 0").select("conv_id").distinct().select(F.concat(F.lit("idx"), "conv_id", F.lit("/sessions-index.json")).alias("file"), F.to_json(_named(entries=F.array(entry))).alias("content"))
    sinks.write_files(index, root)
    return root


def _codex(spark: SparkSession, sf_dir: str) -> str:
    root, turns = place(spark, "codex"), _turns(spark, sf_dir)
    each = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    meta = _line(each, F.lit(-1), _named(type=F.lit("session_meta"), timestamp=_stamp(START + F.col("conv_id") * 60), payload=_named(id=F.concat(F.lit("c"), "conv_id"), timestamp=_stamp(START + F.col("conv_id") * 60 - 5), cwd=_folder(), cli_version=F.lit("9"), model_provider=F.lit("prov"))))
    part = _named(type=F.when(F.col("role") == "assistant", "output_text").otherwise("input_text"), text=F.col("text"))
    said = _line(turns, F.col("turn"), _named(type=F.lit("response_item"), timestamp=_at(), payload=_named(type=F.lit("message"), role=F.col("role"), content=F.array(part))))
    counted = each.select("conv_id", F.explode(F.array(F.lit(0), F.lit(5))).alias("more"))
    total = _named(input_tokens=F.col("conv_id") + F.col("more"), output_tokens=F.col("more"))
    _write(meta.unionByName(said).unionByName(_line(counted, 1_000_000 + F.col("more"), _named(type=F.lit("event_msg"), payload=_named(type=F.lit("token_count"), info=_named(total_token_usage=total))))), root, F.concat(F.lit("2024/rollout-"), "conv_id", F.lit(".jsonl")))
    return root


def _pi(spark: SparkSession, sf_dir: str) -> str:
    root, turns = place(spark, "pi"), _turns(spark, sf_dir)
    each = turns.select("conv_id").distinct()
    head = _line(each, F.lit(-1), _named(type=F.lit("session"), id=F.concat(F.lit("p"), "conv_id"), cwd=_folder(), timestamp=_stamp(START + F.col("conv_id"))))
    said = _line(turns, F.col("turn"), _named(type=F.lit("message"), id=F.concat(F.lit("e"), "turn"), timestamp=_at(), message=_named(role=F.col("role"), content=F.array(_named(type=F.lit("text"), text=F.col("text"))))))
    info = _line(each.filter("conv_id % 3 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), 1_000_000 + F.col("k"), _named(type=F.lit("session_info"), name=F.concat(F.lit("Name "), "k")))
    _write(head.unionByName(said).unionByName(info), root, F.concat("conv_id", F.lit(".jsonl")))
    return root


def _kimi(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    root, turns = place(spark, "kimi"), _turns(spark, sf_dir)
    inside = F.concat(F.md5(_folder().cast("binary")), F.lit("/"), F.col("conv_id"), F.lit("/"))
    mine = F.col("role") == "assistant"
    plain = _line(turns.filter(~mine), F.col("turn"), _named(role=F.col("role"), content=F.col("text")))
    listed = _line(turns.filter(mine), F.col("turn"), _named(role=F.col("role"), content=F.array(_named(type=F.lit("text"), text=F.col("text")))))
    _write(plain.unionByName(listed), f"{root}/sessions", F.concat(inside, F.lit("context.jsonl")))
    meta = _named(session_id=F.concat(F.lit("k"), "conv_id"), title=F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Kimi "), "conv_id")), wire_mtime=START + F.col("conv_id"))
    sinks.write_files(turns.select("conv_id").distinct().select(F.concat(inside, F.lit("metadata.json")).alias("file"), F.to_json(meta).alias("content")), f"{root}/sessions")
    dirs = F.to_json(_named(work_dirs=F.array(*[_named(path=F.lit(f"/w/p{i}")) for i in range(4)])))
    sinks.write_files(spark.range(1).select(F.lit("kimi.json").alias("file"), dirs.alias("content")), f"{root}/settings")
    return f"{root}/sessions", f"{root}/settings"


_MS = f"({START} + conv_id * 60 + turn) * 1000"
_TIDY = "substring(trim(regexp_replace({}, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')), 1, 100)"
_SAID = "trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"


def _times(heads: DataFrame) -> DataFrame:
    return heads.withColumns({"created_ms": F.unix_millis("created_at"), "updated_ms": F.unix_millis("updated_at")})


@_query(f"""
WITH h AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND text <> '') AS asked, min({_MS}) AS created_ms, max({_MS}) AS updated_ms, count(*) AS message_count, arg_min('m' || turn % 4, turn) FILTER (role = 'assistant') AS model FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS session_id, CASE WHEN conv_id % 10 = 0 THEN 'Index ' || conv_id ELSE coalesce(nullif({_TIDY.format('asked')}, ''), 'p' || conv_id % 5) END AS title, created_ms, updated_ms, message_count, model, '/w/p' || conv_id % 5 AS working_directory, 'claude://' || conv_id AS uri FROM h""")
def claudecode_heads(spark, d):
    root = _claude(spark, d)
    heads = sessions.claude_sessions(jsonl.records(spark, root), jsonl.files(spark, root), sessions.index_titles(spark, root))
    return _times(heads).select("session_id", "title", "created_ms", "updated_ms", "message_count", "model", "working_directory", "uri")


@_query(f"""
WITH u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND nth >= 2 AND n <= 9 AND trim(text) <> '') AS asked, max({_MS}) AS updated_ms, count(*) AS message_count FROM u GROUP BY conv_id)
SELECT 'c' || conv_id AS session_id, coalesce(nullif({_TIDY.format('asked')}, ''), 'p' || conv_id % 5) AS title, ({START} + conv_id * 60 - 5) * 1000 AS created_ms, updated_ms, message_count, 'prov' AS model, '9' AS version, 2 * conv_id + 5 AS input_tokens, 5 AS output_tokens FROM h""")
def codex_heads(spark, d):
    root = _codex(spark, d)
    rows = jsonl.records(spark, root)
    heads = sessions.codex_sessions(rows, jsonl.files(spark, root)).join(sessions.token_totals(rows, "codex").withColumnRenamed("path", "source_path"), "source_path")
    return _times(heads).select("session_id", "title", "created_ms", "updated_ms", "message_count", "model", "version", "input_tokens", "output_tokens")


@_query(f"""SELECT 'p' || conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'Name 2' END AS title, ({START} + conv_id) * 1000 AS created_ms, greatest(max({_MS}), ({START} + conv_id) * 1000) AS updated_ms, count(*) AS message_count, '/w/p' || conv_id % 5 AS cwd FROM conversations GROUP BY conv_id""")
def pi_heads(spark, d):
    return _times(jsonl.pi_sessions(jsonl.records(spark, _pi(spark, d)))).select("session_id", "title", "created_ms", "updated_ms", "message_count", "cwd")


@_query(f"""SELECT 'k' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'Kimi ' || conv_id WHEN conv_id % 5 < 4 THEN 'p' || conv_id % 5 ELSE 'Untitled Session' END AS title, ({START} + conv_id) * 1000 AS created_ms,
count(*) FILTER (role IN ('user', 'assistant') AND {_SAID}) AS message_count, CASE WHEN conv_id % 5 < 4 THEN '/w/p' || conv_id % 5 END AS working_directory FROM conversations GROUP BY conv_id""")
def kimi_heads(spark, d):
    return _times(sessions.kimi_sessions(spark, *_kimi(spark, d))).select("session_id", "title", "created_ms", "message_count", "working_directory")


@_query(f"""SELECT 'k' || conv_id AS session_id, ({START} + conv_id) * 1000 AS created_ms, count(*) FILTER (role IN ('user', 'assistant') AND {_SAID}) AS message_count
FROM conversations WHERE conv_id >= (SELECT max(conv_id) // 2 FROM conversations) GROUP BY conv_id""")
def kimi_recent(spark, d):
    """The later half by the folders' headers; context files of the others are not opened."""
    (last,) = _t(spark, d, "conversations").agg(F.max("conv_id")).first()
    heads = sessions.kimi_sessions(spark, *_kimi(spark, d), since=F.timestamp_seconds(F.lit(START + (last or 0) // 2)))
    return _times(heads).select("session_id", "created_ms", "message_count")


@_query(f"""SELECT 'c' || conv_id AS session_id, ({START} + conv_id * 60 - 5) * 1000 AS created_ms, max({_MS}) AS updated_ms, count(*) AS message_count, '/w/p' || conv_id % 5 AS working_directory
FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations) GROUP BY conv_id""")
def codex_lookup(spark, d):
    """The head of the last session, by its id."""
    (last,) = _t(spark, d, "conversations").agg(F.max("conv_id")).first()
    return _times(sessions.look_up(spark, _codex(spark, d), "codex", f"c{last}")).select("session_id", "created_ms", "updated_ms", "message_count", "working_directory")


def _told(messages: DataFrame, name: str = r"(\d+)\.jsonl$") -> DataFrame:
    texts = F.array_join(F.transform("parts", lambda p: p["text"]), "|")
    return messages.select(F.regexp_extract("session", name, 1).cast("long").alias("conv_id"), "seq", "role", texts.alias("texts"))


def _islands(kept: str) -> str:
    """Messages where an assistant's texts in a row are one message."""
    return f"""
WITH k AS (SELECT *, row_number() OVER w AS pos, role = 'assistant' AND coalesce(lag(role) OVER w = 'assistant', false) AS joins FROM conversations WHERE {kept} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS g FROM k)
SELECT conv_id, min(pos) AS seq, min(role) AS role, string_agg(text, '|' ORDER BY pos) AS texts FROM g GROUP BY conv_id, g"""


def _single(kept: str) -> str:
    return f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, role, trim(text) AS texts FROM conversations WHERE {kept}"


@_query(_islands(f"role IN ('user', 'assistant') AND {_SAID}"))
def claudecode_transcript(spark, d):
    return _told(transcripts.claude_messages(jsonl.records(spark, _claude(spark, d))))


@_query(_islands("text IS NOT NULL"))
def codex_transcript(spark, d):
    return _told(transcripts.codex_messages(jsonl.records(spark, _codex(spark, d))))


@_query(_single(_SAID))
def pi_transcript(spark, d):
    return _told(transcripts.pi_messages(jsonl.records(spark, _pi(spark, d))))


@_query(_single(f"role IN ('user', 'assistant') AND {_SAID}").replace("trim(text) AS", "text AS"))
def kimi_transcript(spark, d):
    return _told(transcripts.kimi_messages(jsonl.records(spark, _kimi(spark, d)[0], "context.jsonl")), r"/(\d+)/context\.jsonl$")


# fixed values: tables of the stores
TABLES = """
create table session(id text primary key, title text, time_created integer, time_updated integer, directory text);
create table message(id text primary key, session_id text, time_created integer, data text);
create table part(id text primary key, message_id text, time_created integer, data text);
create table cursorDiskKV(key text primary key, value text);"""


def _databases(rows: DataFrame, tag: str, by: Column | None = None) -> str:
    """Rows (name, cells) as SQLite files, one a task, in the shared folder; gives their paths as a comma list."""
    root = place(rows.sparkSession, tag)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        with tempfile.TemporaryDirectory() as folder:
            made = os.path.join(folder, "made.db")
            with sqlite3.connect(made) as db:
                db.executescript(TABLES)
                for batch in batches:
                    for name, cells in zip(batch["name"], batch["cells"], strict=True):
                        db.execute(f"insert into {name} values ({', '.join('?' * len(cells))})", list(cells))
            db.close()
            fs.create_dir(base, recursive=True)
            goal = f"{base}/{uuid.uuid4().hex}.db"
            with open(made, "rb") as source, fs.open_output_stream(goal) as out:
                while piece := source.read(1 << 22):
                    out.write(piece)
        yield pd.DataFrame({"file": [goal.rsplit("/", 1)[1]]})

    files = (rows.repartition(4) if by is None else rows.repartition(4, by).sortWithinPartitions("cells")).mapInPandas(write, "file string").collect()
    return ",".join(f"{root}/{f.file}" for f in files)


def _row(rows: DataFrame, name: str, *cells: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("name"), F.array(*[c.cast("string") for c in cells]).alias("cells"))


def _opencode(spark: SparkSession, sf_dir: str) -> str:
    turns = _turns(spark, sf_dir)
    each, key = turns.select("conv_id").distinct(), F.concat("conv_id", F.lit("-"), "turn")
    made = (START + F.col("conv_id") * 60 + F.col("turn")) * 1000
    data = F.to_json(_named(role=F.col("role"), modelID=F.when(F.col("role") == "assistant", F.concat(F.lit("m"), F.col("turn") % 4))))
    sessions_ = _row(each, "session", F.concat(F.lit("o"), "conv_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Open "), "conv_id")), (START + F.col("conv_id")) * 1000, (START + F.col("conv_id") + 9) * 1000, _folder())
    parts = _row(turns, "part", key, key, made, F.to_json(_named(type=F.lit("text"), text=F.col("text"))))
    return _databases(sessions_.unionByName(_row(turns, "message", key, F.concat(F.lit("o"), "conv_id"), made, data)).unionByName(parts), "opencode")


def _cursor(spark: SparkSession, sf_dir: str) -> str:
    turns = _turns(spark, sf_dir)
    composer = _row(turns.select("conv_id").distinct(), "cursorDiskKV", F.concat(F.lit("composerData:"), "conv_id"), F.to_json(_named(createdAt=(START + F.col("conv_id")) * 1000, name=F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Cursor "), "conv_id")))))
    bubble = _named(type=F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(9), text=F.col("text"), requestId=F.when(F.col("turn") == 1, F.concat(F.lit("r"), "conv_id")))
    return _databases(composer.unionByName(_row(turns, "cursorDiskKV", F.concat(F.lit("bubbleId:"), "conv_id", F.lit(":"), "turn"), F.to_json(bubble))), "cursor")


@_query(f"""
WITH h AS (SELECT conv_id, count(*) AS message_count, arg_max('m' || turn % 4, turn) FILTER (role = 'assistant') AS model FROM conversations GROUP BY conv_id)
SELECT 'o' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'Open ' || conv_id ELSE 'p' || conv_id % 5 END AS title, ({START} + conv_id) * 1000 AS created_ms, ({START} + conv_id + 9) * 1000 AS updated_ms, message_count, model FROM h WHERE conv_id >= 5""")
def opencode_heads(spark, d):
    path = _opencode(spark, d)
    rows = sqlite.load(spark, path, "session", ("time_created", ">=", (START + 5) * 1000))
    return _times(sessions.relational_sessions(rows, sqlite.load(spark, path, "message"))).select("session_id", "title", "created_ms", "updated_ms", "message_count", "model")


@_query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, role, text AS texts FROM conversations")
def opencode_transcript(spark, d):
    path = _opencode(spark, d)
    return _told(stores.relational_messages(sqlite.load(spark, path, "message"), sqlite.load(spark, path, "part")), r"^o(\d+)$")


@_query(f"""
SELECT CASE WHEN bool_or(turn = 1) THEN 'r' || conv_id ELSE conv_id::VARCHAR END AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'Cursor ' || conv_id ELSE 'Cursor Session ' || substring(conv_id::VARCHAR, 1, 8) END AS title, ({START} + conv_id) * 1000 AS created_ms,
count(*) FILTER (role IN ('user', 'assistant')) AS message_count FROM conversations GROUP BY conv_id""")
def cursor_heads(spark, d):
    return _times(sessions.keyed_sessions(sqlite.load(spark, _cursor(spark, d), "cursorDiskKV"))).select("session_id", "title", "created_ms", "message_count")


# --- layouts with tools --------------------------------------------------------------------------


@_query("SELECT DISTINCT 'o' || conv_id AS session_id FROM conversations WHERE contains(lower(text), 'the') OR conv_id % 2 = 0 AND contains('open ' || conv_id, 'the')")
def store_keyword(spark, d):
    """A keyword tested by the store."""
    return sqlite.keyword_sessions(spark, _opencode(spark, d), "tHe")


def _opencode_tools(spark: SparkSession, sf_dir: str) -> str:
    """A message a turn with its text and, for assistants, a call whose state has arguments, output and prompt."""
    turns = _turns(spark, sf_dir)
    each, key = turns.select("conv_id").distinct(), F.concat("conv_id", F.lit("-"), "turn")
    made, n = (START + F.col("conv_id") * 60 + F.col("turn")) * 1000, F.col("turn")
    state = _named(status=F.lit("completed"), arguments=_named(n=n), output=F.when(n % 3 != 0, F.concat(F.lit("out "), n)), prompt=F.when(n % 2 == 1, F.concat(F.lit(" ask "), n)))
    text = _row(turns, "part", F.concat(key, F.lit("a")), key, made, F.to_json(_named(type=F.lit("text"), text=F.col("text"))))
    tool = _row(turns.filter("role = 'assistant'"), "part", F.concat(key, F.lit("b")), key, made + 1, F.to_json(_named(type=F.lit("tool"), tool=F.lit("bash"), callID=key, state=state)))
    heads = _row(each, "session", F.concat(F.lit("o"), "conv_id"), F.lit("t"), (START + F.col("conv_id")) * 1000, (START + F.col("conv_id") + 9) * 1000, _folder())
    return _databases(heads.unionByName(_row(turns, "message", key, F.concat(F.lit("o"), "conv_id"), made, F.to_json(_named(role=F.col("role"))))).unionByName(text).unionByName(tool), "opencode")


_TOOLS = """concat_ws(chr(10) || chr(10), nullif(trim(text), ''), CASE WHEN role = 'assistant' THEN '{"n":' || turn || '}' END, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'out ' || turn END, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'ask ' || turn END)"""


@_query(f"""WITH t AS (SELECT conv_id, turn, {_TOOLS} AS said FROM conversations)
SELECT conv_id, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY turn) FILTER (said <> ''), '') AS content FROM t GROUP BY conv_id""")
def opencode_corpus(spark, d):
    """What a search sees of a session with tools: arguments, outputs and prompts as well."""
    path = _opencode_tools(spark, d)
    found = views.searchable(stores.relational_messages(sqlite.load(spark, path, "message"), sqlite.load(spark, path, "part")))
    return found.select(F.substring("session", 2, 20).cast("long").alias("conv_id"), "content")


def _codex_tools(spark: SparkSession, sf_dir: str) -> str:
    """Users' texts, and for each assistant's turn its text, a call and the call's output."""
    root, turns = place(spark, "codex"), _turns(spark, sf_dir)
    mine, call = F.col("role") == "assistant", F.concat(F.lit("c"), "turn")
    item = lambda rows, n, payload: _line(rows, n, _named(type=F.lit("response_item"), timestamp=_at(), payload=payload))
    part = _named(type=F.when(mine, "output_text").otherwise("input_text"), text=F.col("text"))
    said = item(turns.filter("role in ('user', 'assistant')"), F.col("turn") * 3, _named(type=F.lit("message"), role=F.col("role"), content=F.array(part)))
    asked = item(turns.filter(mine), F.col("turn") * 3 + 1, _named(type=F.lit("function_call"), name=F.when(F.col("turn") % 2 == 0, "spawn_agent").otherwise("exec_command"), call_id=call, arguments=F.to_json(_named(message=F.concat(F.lit("do "), "turn")))))
    told = item(turns.filter(mine), F.col("turn") * 3 + 2, _named(type=F.lit("function_call_output"), call_id=call, output=F.to_json(_named(agent_id=F.concat(F.lit("a"), "turn"), nickname=F.concat(F.lit("nick"), "turn")))))
    _write(said.unionByName(asked).unionByName(told), root, F.concat("conv_id", F.lit(".jsonl")))
    return root


@_query("""SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'subagent' ELSE 'exec_command' END AS tool, '{"message":"do ' || turn || '"}' AS arguments, '{"agent_id":"a' || turn || '","nickname":"nick' || turn || '"}' AS output,
CASE WHEN turn % 2 = 0 THEN 'do ' || turn END AS prompt, CASE WHEN turn % 2 = 0 THEN 'nick' || turn END AS nickname, CASE WHEN turn % 2 = 0 THEN 'subagent' ELSE 'bash' END AS title FROM conversations WHERE role = 'assistant'""")
def codex_calls(spark, d):
    """Calls with outputs found for them, subagents with what they were asked and are called."""
    view = views.transcript(transcripts.codex_enriched(transcripts.codex_messages(jsonl.records(spark, _codex_tools(spark, d)))))
    calls = view.select(F.regexp_extract("session", r"(\d+)\.jsonl$", 1).cast("long").alias("conv_id"), F.explode("calls").alias("c")).select("conv_id", "c.*")
    return calls.withColumn("title", text.tool_title(F.col("tool"), "codex"))


def _cursor_tools(spark: SparkSession, sf_dir: str) -> str:
    """Bubbles with times, token counts of three kinds, a call on each assistant's turn."""
    turns = _turns(spark, sf_dir).filter("role in ('user', 'assistant')")
    mine, n = F.col("role") == "assistant", F.col("turn")
    composer = _row(turns.select("conv_id").distinct(), "cursorDiskKV", F.concat(F.lit("composerData:"), "conv_id"), F.to_json(_named(createdAt=(START + F.col("conv_id")) * 1000)))
    tool = F.when(mine, _named(name=F.lit("read"), toolCallId=F.concat(F.lit("t"), n), params=F.to_json(_named(n=n)), result=F.concat(F.lit("r "), n), status=F.lit("ok")))
    bubble = _named(
        type=F.when(mine, 2).otherwise(1), text=F.concat(F.lit("x"), "text"), timingInfo=_named(clientRpcSendTime=(START + F.col("conv_id") * 60 + n) * 1000), toolFormerData=tool, tokenCount=F.when(n % 3 == 0, _named(inputTokens=n + 1, outputTokens=F.lit(2))),
        usage=F.when(n % 3 == 1, _named(input_tokens=n, output_tokens=F.lit(3))), contextWindowStatusAtCreation=_named(tokensUsed=F.lit(100)))
    return _databases(composer.unionByName(_row(turns, "cursorDiskKV", F.concat(F.lit("bubbleId:"), "conv_id", F.lit(":"), n), F.to_json(bubble))), "cursor", F.split(F.col("cells")[0], ":")[1])


@_query("""WITH c AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS seq, CASE WHEN k = 1 THEN 'tool' ELSE role END AS role, CASE WHEN k = 0 THEN trim('x' || text) ELSE '{"n":' || turn || '}' || chr(10) || chr(10) || 'r ' || turn END AS text
FROM c, range(2) t(k) WHERE k = 0 AND text IS NOT NULL OR k = 1 AND role = 'assistant'""")
def cursor_calls(spark, d):
    """Messages of the cursor layout with their tools."""
    view = views.spoken(views.transcript(stores.keyed_messages(sqlite.load(spark, _cursor_tools(spark, d), "cursorDiskKV"))))
    return view.select(F.col("session").cast("long").alias("conv_id"), "seq", "role", "text")


@_query("""SELECT conv_id, sum(CASE turn % 3 WHEN 0 THEN turn + 1 WHEN 1 THEN turn ELSE 100 END)::BIGINT AS input_tokens, sum(CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END)::BIGINT AS output_tokens FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def cursor_tokens(spark, d):
    return stores.keyed_tokens(sqlite.load(spark, _cursor_tools(spark, d), "cursorDiskKV")).withColumn("conv_id", F.col("session").cast("long")).drop("session")


def _cursor_tree(spark: SparkSession, sf_dir: str) -> str:
    """Four conversations in a row as agents that call the next and the one after, whose times run into each other."""
    turns = _turns(spark, sf_dir).filter("role in ('user', 'assistant')")
    n, id_ = F.col("turn"), F.col("conv_id")
    composer = _row(turns.select("conv_id").distinct(), "cursorDiskKV", F.concat(F.lit("composerData:"), id_), F.to_json(_named(createdAt=(START + id_) * 1000, modelConfig=F.when(id_ % 4 == 1, _named(modelName=F.concat(F.lit("m"), id_))), subagentInfo=_named(subagentTypeName=F.concat(F.lit("k"), id_ % 4)))))
    child = F.when((n < 2) & (id_ % 4 + n < 3), (id_ + n + 1).cast("string"))
    tool = F.when(child.isNotNull(), _named(name=F.lit("task"), additionalData=_named(subagentComposerId=child)))
    at = (START + F.floor(id_ / 4) * 1000 + n * 10 + id_ % 4) * 1000
    bubble = _named(type=F.when(F.col("role") == "assistant", 2).otherwise(1), text=F.col("text"), timingInfo=_named(clientRpcSendTime=at), modelInfo=F.when(n == 2, _named(modelName=F.lit("late"))), toolFormerData=tool)
    return _databases(composer.unionByName(_row(turns, "cursorDiskKV", F.concat(F.lit("bubbleId:"), id_, F.lit(":"), n), F.to_json(bubble))), "cursor", F.split(F.col("cells")[0], ":")[1])


_INTO = "SELECT conv_id, string_agg(said, '|' ORDER BY at_ms, turn, place) AS said, max(at_ms) AS at_ms FROM"


@_query(f"""WITH c AS (SELECT conv_id, conv_id % 4 AS k, turn, role, trim(text) AS said, ({START} + conv_id // 4 * 1000 + turn * 10 + conv_id % 4) * 1000 AS at_ms, 0 AS place FROM conversations WHERE role IN ('user', 'assistant')),
own AS (SELECT conv_id, k, turn, said, at_ms, place FROM c WHERE role = 'assistant' AND said <> ''),
calls AS (SELECT conv_id, k, turn, conv_id + turn + 1 AS child FROM c WHERE turn < 2 AND k + turn < 3 AND conv_id + turn + 1 IN (SELECT conv_id FROM c)),
l3 AS ({_INTO} (SELECT * FROM own WHERE k = 3) GROUP BY conv_id),
l2 AS ({_INTO} (SELECT * FROM own WHERE k = 2 UNION ALL SELECT q.conv_id, q.k, q.turn, a.said, a.at_ms, 2 FROM calls q JOIN l3 a ON a.conv_id = child WHERE q.k = 2) GROUP BY conv_id),
l1 AS ({_INTO} (SELECT * FROM own WHERE k = 1 UNION ALL SELECT q.conv_id, q.k, q.turn, a.said, a.at_ms, 2 FROM calls q JOIN (SELECT * FROM l2 UNION ALL SELECT * FROM l3) a ON a.conv_id = child WHERE q.k = 1) GROUP BY conv_id)
SELECT q.conv_id, child::VARCHAR AS child, 'k' || child % 4 AS kind, said AS texts, at_ms FROM calls q JOIN (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) a ON a.conv_id = child""")
def cursor_subagents(spark, d):
    """Answers of subagents called three levels deep, some of them by two callers."""
    told = stores.keyed_messages(sqlite.load(spark, _cursor_tree(spark, d), "cursorDiskKV")).filter("subagent_id is not null")
    return told.select(F.col("session").cast("long").alias("conv_id"), F.col("subagent_id").alias("child"), F.col("subagent_type").alias("kind"), F.array_join(F.transform("parts", lambda p: p["text"]), "|").alias("texts"), F.col("at").alias("at_ms"))


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire records (path, line, record): a turn begins with a user's text; an assistant's turn is a text, a call in two pieces and its result."""
    turns = _turns(spark, sf_dir).filter("role in ('user', 'assistant')")
    n, call = F.col("turn"), F.concat(F.lit("t"), F.col("turn"))
    of = lambda rows, k, kind, payload: rows.select("conv_id", (n * 4 + k).alias("n"), F.to_json(_named(timestamp=START + F.col("conv_id") * 60 + n, message=_named(type=F.lit(kind), payload=payload))).alias("record"))
    mine = turns.filter("role = 'assistant'")
    pieces = [
        of(turns.filter("role = 'user'"), 0, "TurnBegin", _named(user_input=F.array(_named(text=F.col("text"))))),
        of(mine, 0, "ContentPart", _named(type=F.lit("text"), text=F.col("text"))),
        of(mine, 1, "ToolCall", _named(id=call, function=_named(name=F.lit("Shell"), arguments=F.lit("{")))),
        of(mine, 2, "ToolCallPart", _named(arguments_part=F.concat(n, F.lit("}")))),
        of(mine, 3, "ToolResult", _named(tool_call_id=call, return_value=F.concat(F.lit("out "), n))),
    ]
    rows = reduce(DataFrame.unionByName, pieces)
    return rows.select(F.col("conv_id").cast("string").alias("path"), F.col("n").alias("line"), "record")


_WIRE = """
WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role IN ('user', 'assistant')),
m AS (SELECT conv_id, g, role, min(turn) AS first, string_agg(concat_ws('|', nullif(CASE WHEN trim(text) <> '' THEN text ELSE '' END, ''), CASE WHEN role = 'assistant' THEN '{' || turn || '}out ' || turn END), '|' ORDER BY turn) AS told FROM c GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n, role, told FROM m WHERE told <> ''"""


def _wired(messages: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    told = F.array_join(F.transform("parts", lambda p: F.when(p["kind"] == "tool", F.concat(p["arguments"], F.array_join(p["outputs"], ","))).otherwise(p["text"])), "|")
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    return messages.select(F.col("session").cast("long").alias("conv_id"), n.alias("n"), "role", told.alias("told"))


@_query(_WIRE)
def kimi_wire(spark, d):
    return _wired(transcripts.kimi_wire_messages(_wire(spark, d)))


@_query(_WIRE)
def kimi_wire_stream(spark, d):
    """The same records as a stream: two files, each read by a query that goes on where the one before stopped."""
    root, rows = place(spark, "wire"), _wire(spark, d)
    end = rows.select("path").distinct().select("path", F.lit(1 << 40).alias("line"), F.to_json(_named(timestamp=F.lit(1 << 32), message=_named(type=F.lit("TurnBegin"), payload=F.struct(F.lit(1).alias("x"))))).alias("record"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, wire.ROCKSDB)
    try:
        for piece in (rows.filter("line % 8 < 4"), rows.filter("line % 8 >= 4"), end):
            piece.write.mode("append").parquet(f"{root}/in")
            parts = wire.wire_parts(spark.readStream.schema("path string, line long, record string").parquet(f"{root}/in"), "1000 days")
            parts.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return _wired(wire.messages(spark.read.schema(wire.PARTS).parquet(f"{root}/out")))
