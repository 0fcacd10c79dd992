"""Behaviour of the reference's own operators on small inputs."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coerce, text
from tidemark.operators import collect, filters, search
from tidemark.operators.search import TextQuery


def one(spark, expression, **columns):
    row = spark.range(1)
    for name, value in columns.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(expression).first()[0]


def test_queries():
    assert TextQuery.phrase(" slow\t  query ").literals == ("slow query",)
    assert TextQuery.terms("x y x z").literals == ("x", "y", "z")
    paths = {"缓存": "words", "ab": "scan", "redis缓存": "scan", "slow query": "scan", "redis": "trigrams"}
    assert {q: search.access_path(TextQuery.phrase(q)) for q in paths} == paths
    assert search.access_path(TextQuery.terms("slow query")) == "trigrams" and search.access_path(TextQuery.terms("slow db")) == "scan"


def test_match_and_snippet(spark):
    c = F.col("t")
    phrase, terms = TextQuery.phrase("slow query"), TextQuery.terms("slow query")
    cases = (("one SLOW Query more", True), ("query was slow", False), ("slow  query", False), (None, False))
    for t, hit in cases:
        assert one(spark, phrase.matches(F.lit(t).cast("string"))) == hit
    assert one(spark, terms.matches(F.lit("a Slow one"), F.lit("the query"))) and not one(spark, terms.matches(F.lit("a slow one"), F.lit("nothing")))
    for odd in (r"a.b", "50%_", r"x\Ey", "(un", "^$|"):
        assert one(spark, TextQuery.phrase(odd).matches(c), t=f"so {odd.upper()} it is") and not one(spark, TextQuery.phrase(odd).matches(c), t="so it is")
    assert one(spark, terms.best_snippet(F.lit("nothing"), F.lit("Query plan"))) == "**Query** plan"
    assert one(spark, TextQuery.phrase("mid").best_snippet(F.lit("l" * 60 + "MID" + "r" * 60))) == "..." + "l" * 48 + "**MID**" + "r" * 48 + "..."
    assert not one(spark, TextQuery.phrase("").matches(c), t="x")


def test_filters(spark):
    spec = filters.parse_uri("agents:///repo?q=a%20b&providers=claude,codex&roles=User&limit=3")
    assert spec == filters.QuerySpec("a b", ("claudecode", "codex"), ("user",), "/repo", 3)
    with pytest.raises(ValueError):
        filters.parse_providers("nobody")
    with pytest.raises(ValueError):
        filters.parse_limit("0")
    for path, hit in (("/a/b", True), ("/a", True), ("/a/b/c", True), ("/a/bc", False), (None, False), ("/", True)):
        assert one(spark, filters.path_scope(F.lit(path).cast("string"), "/a/b")) == hit
    assert one(spark, filters.denied(F.lit("/a/b"), ["/a"])) and not one(spark, filters.denied(F.lit(None).cast("string"), ["/a"]))


def test_scalars(spark):
    assert one(spark, coerce.safe_int(F.lit(" 1_000 "))) == 1000 and one(spark, coerce.safe_int(F.lit("1.5"))) == 0
    assert one(spark, coerce.safe_float(F.lit("NaN"))) == 0.0
    assert one(spark, coerce.iso_ms(F.lit("1970-01-01T00:00:01Z"))) == 1000 and one(spark, coerce.iso_ms(F.lit("x"))) == 0
    assert one(spark, text.basename(F.lit("/a/b/"))) == "b"
    assert one(spark, text.title(F.lit("  "), F.lit(" x  y "))) == "x y"
    assert one(spark, text.find_paths(F.lit("open (~/notes/a.md): lib/core/b.rs; LIB/core/b.rs c.txt"))) == ["~/notes/a.md", "lib/core/b.rs"]


def test_collect(spark):
    kind = lambda role, t: one(spark, text.event_kind(F.lit(role), F.lit(t)))
    assert kind("user", "hello") is None and kind("user", "please fix") == "user_intent" and kind("assistant", "```x\n```") == "code" and kind("assistant", "it failed") == "error"
    sizes = F.array(*map(F.lit, (1200, 1200, 1200)))
    assert one(spark, collect.chunk_numbers(sizes.cast("array<bigint>"), 1500)) == [0, 1, 2]
    events = F.array(*[F.struct(F.lit(s).cast("long").alias("size")) for s in (152, 152, 10)])
    assert [e["size"] for e in one(spark, collect.admit(events, 130))] == [152]
    rows = spark.createDataFrame([("s", i, "user", f"text {i}") for i in range(3)], "s string, turn int, role string, text string")
    assert collect.session_events(rows, "s", "turn").count() == 3


def test_sources(spark, tmp_path):
    from tidemark.sources import jsonl
    from tidemark.sources.sqlite import SqliteSessions

    lines = [{"type": "session", "id": "s1", "cwd": "/r", "timestamp": "2024-01-01T00:00:00Z"}, {"type": "message", "timestamp": "2024-01-01T00:00:05Z", "message": {"role": "User", "content": [{"type": "text", "text": "hi"}]}}, {"type": "session_info", "name": "T"}]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(lines[0]), "not json", *map(json.dumps, lines[1:])]) + '\n{"cut')
    rows = jsonl.records(spark, str(tmp_path))
    session = jsonl.pi_sessions(rows).first()
    assert (session.session_id, session.title, session.message_count) == ("s1", "T", 1)
    assert [tuple(r)[1:] for r in jsonl.bad_lines(rows).collect()] == [(1, [2])]
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table session(id text, title text, time_created int)")
    db.executemany("insert into session values (?, ?, ?)", [("a", "t", 5), ("b", None, 50)])
    db.commit()
    spark.dataSource.register(SqliteSessions)
    found = spark.read.format("sqlite_sessions").option("path", str(tmp_path / "x.db")).option("since_ms", "10").load()
    assert [r.id for r in found.collect()] == ["b"]


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans.catalog import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "nation customer part orders lineitem events documents pages labels conversations".split():
        db.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("search_literal_rank_topk", "search_bm25_topk", "role_evidence", "stats_by_provider", "toolcall_backfill", "orphan_results", "path_scope", "query_roles", "budget_fold", "chunk_fold", "tree_reduce", "epoch_parse"):
        ours = QUERIES[name](spark, d)
        theirs = db.execute(ORACLES[name]).fetchall()
        columns = [c[0] for c in db.description]
        assert theirs and sorted(map(str, map(tuple, ours.select(*columns).collect()))) == sorted(map(str, theirs)), name
