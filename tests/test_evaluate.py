"""Queries over sessions, graph reach, search paths and views on small inputs."""

import json
import math
import os
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, filters, relations, search, views
from tidemark.operators.filters import QuerySpec
from tidemark.operators.search import TextQuery

SESSION = "provider string, session_id string, title string, working_directory string, created_at long, updated_at long"


@pytest.fixture(scope="module")
def archive(spark):
    rows = [("codex", "a", "Index rebuild", "/w/app", 1, 9), ("codex", "b", "other", "/w", 1, 8), ("pi", "a", "more", "/w/app/sub", 2, 9), ("pi", "c", None, None, 1, 7), ("kimi", "d", "", "/x", 1, 1)]
    said = [("codex", "a", 0, "User", "please rebuild it"), ("codex", "a", 1, "assistant", "rebuild done"), ("codex", "b", 0, "user", "the index"), ("pi", "a", 0, None, "index rebuild index"), ("pi", "c", 0, "user", "rebuild the index now"), ("pi", "c", 1, "user", " ")]
    return spark.createDataFrame(rows, SESSION), spark.createDataFrame(said, "provider string, session_id string, seq long, role string, text string")


def keys(rows):
    return [f"{r.provider}/{r.session_id}" for r in rows.collect()]


def test_matches(archive):
    sessions, messages = archive
    run = lambda ranked=False, **spec: evaluate.matches(QuerySpec(**spec), sessions, messages, ranked)
    assert sorted(keys(run())) == ["codex/a", "codex/b", "kimi/d", "pi/a", "pi/c"] and run(ranked=True).count() == 0
    assert keys(run(limit=3)) == ["pi/a", "codex/a", "codex/b"]
    assert sorted(keys(run(path="/w/app"))) == ["codex/a", "codex/b", "pi/a"] and keys(run(path="/w/app", providers=("pi",))) == ["pi/a"]
    # a phrase, then all terms over title and text
    assert sorted(keys(run(keyword="index rebuild"))) == ["codex/a", "pi/a"]
    found = run(True, keyword="index rebuild", limit=9).collect()
    assert sorted(f"{r.provider}/{r.session_id}" for r in found) == ["codex/a", "pi/a", "pi/c"] and [r.rank for r in found] == sorted((r.rank for r in found), reverse=True)
    assert keys(run(True, keyword="index rebuild", path="/w/app", limit=1))[0] in ("codex/a", "pi/a")
    roles = {f"{r.provider}/{r.session_id}": (r.matched_role, r.snippet) for r in run(keyword="rebuild", roles=("user", "unknown")).collect()}
    assert roles == {"codex/a": ("user", "please **rebuild** it"), "pi/a": ("unknown", "index **rebuild** index"), "pi/c": ("user", "**rebuild** the index now")}
    assert keys(run(roles=("user",), limit=2)) == ["codex/a", "codex/b"]


def test_sources_and_look_up(archive):
    sessions, _ = archive
    assert sorted(keys(evaluate.per_source(sessions, 1))) == ["codex/a", "kimi/d", "pi/a"]
    assert keys(evaluate.find(sessions, "a")) == ["codex/a"] and keys(evaluate.find(sessions, "a", "pi")) == ["pi/a"] and keys(evaluate.find(sessions, "z")) == []
    assert keys(evaluate.find_uri(sessions, "codex://threads/b")) == ["codex/b"] and evaluate.split_uri("claude://x") == ("claudecode", "x")
    for bad in ("codex:/b", "who://b", "pi://"):
        with pytest.raises(ValueError):
            evaluate.split_uri(bad)
    assert evaluate.summary(QuerySpec("x y")) == "x y" and evaluate.summary(QuerySpec()) == "all sessions"
    assert evaluate.summary(QuerySpec("x", ("pi", "codex"), limit=2)) == "keyword=x; providers=codex,pi; limit=2"
    assert filters.checked_days(None, date(2024, 1, 1)) == 7
    with pytest.raises(ValueError):
        filters.checked_days(0, date(2024, 1, 1))


def test_ranks(spark):
    texts = ["redis cache redis", "cache only", "aaaa aaaa", "缓存缓存 cache", "x缓存", "修 缓存"]
    corpus = spark.createDataFrame([("p", str(i), "", t) for i, t in enumerate(texts)], "provider string, session_id string, title string, content string")
    query = TextQuery.terms("redis cache")
    scan = {r.session_id: r.rank for r in search.bm25(corpus, query).collect()}
    stored = {r.session_id: r.rank for r in search.indexed(corpus, search.gram_table(corpus), search.size_table(corpus), query).collect()}
    n, sizes = len(texts), [max(0, len(t) - 2) for t in texts]
    weight = lambda tf, df, size: max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (sum(sizes) / n)))
    assert scan == stored == {"0": round(weight(2, 1, sizes[0]) + weight(1, 3, sizes[0]), 6)}
    # overlaps count
    assert {r.session_id: r.rank for r in search.bm25(corpus, TextQuery.terms("aaa")).collect()} == {"2": round(weight(4, 1, sizes[2]), 6)}
    # words: each CJK character is one; a letter before it is not a word's end
    n, sizes = len(texts), [3, 2, 2, 5, 2, 3]
    words = {r.session_id: r.rank for r in search.bm25(corpus, TextQuery.terms("缓存"), words=True).collect()}
    assert words == {"3": round(weight(2, 2, 5), 6), "5": round(weight(1, 2, 3), 6)}


def test_reach(spark):
    chain = [(i, i + 1) for i in range(40)] + [(40, 0), (7, 7)]
    found = {r.node: r.depth for r in relations.descend(spark.createDataFrame(chain, "parent long, child long"), F.col("parent") == 0).collect()}
    assert found == {i: i for i in range(41)}


def test_reach_of_diamonds(spark):
    """Ten diamonds in a row have a thousand paths and thirty-one nodes; a wide node has many children."""
    edges = [(3 * i, 3 * i + k) for i in range(10) for k in (1, 2)] + [(3 * i + k, 3 * i + 3) for i in range(10) for k in (1, 2)]
    wide = spark.range(1_200_000).selectExpr("-1L as parent", "id + 1000 as child")
    rows = spark.createDataFrame([*edges, (-1, 0)], "parent long, child long").unionByName(wide)
    found = relations.descend(rows, F.col("parent") == -1)
    assert found.count() == 1_200_000 + 31 + 1 and found.filter("node = 30").first().depth == 21


def test_views(spark):
    part = "array<struct<kind:string,text:string,tool:string,arguments:string,output:array<string>>>"
    rows = [("s", 1, None, [("text", " a ", None, None, None), ("reasoning", " ", None, None, None), ("plan", "b", None, None, None), ("tool", None, "subagent", "{}", ["x", "y"])]), ("s", 2, "USER", [("note", "n", None, None, None)])]
    view = views.transcript(spark.createDataFrame(rows, f"session string, seq long, role string, parts {part}"))
    a, b = view.withColumn("below", views.subagent_calls(F.col("calls"))).orderBy("seq").collect()
    assert (a.role, a.texts, [tuple(c) for c in a.calls], len(a.below)) == ("unknown", ["a", "b"], [("subagent", "{}", "x\n\ny")], 1) and (b.role, b.texts, b.calls) == ("user", [], [])
    assert [r.text for r in views.spoken(view).orderBy("seq").collect()] == ["a\n\nb\n\n{}\n\nx\n\ny", ""]
    values = {"plain": ["plain"], '"q"': ["q"], '["x", {"text": " y "}, {"z": 1}, " "]': ["x", "y"], '{"text": "t"}': [], "": []}
    table = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.t for r in table.select("v", views.legacy_texts(F.col("v")).alias("t")).collect()} == values
    listed = spark.createDataFrame([(v,) for v in ('["a"]', "a.py", None, " ", "3")], "v string").select(views.json_or_list(F.col("v")).alias("t"))
    assert [r.t for r in listed.collect()] == [["a"], ["a.py"], [], [], []]
    kinds = views.outcome(spark.createDataFrame([("a", False), ("b", False)], "path string, ok boolean")).first()
    assert tuple(kinds) == (False, True, 0) and tuple(views.outcome(spark.createDataFrame([], "path string, ok boolean")).first()) == (False, False, 0)
    size = views.item_count(F.array(F.lit(1), F.lit(2)), F.lit(None).cast("array<int>"), F.array(F.lit(3)))
    assert spark.range(1).select(size).first()[0] == 3


def test_files_since(spark, tmp_path):
    from tidemark.sources import sessions

    for name, at in (("old", 1_600_000_000), ("new", 1_700_000_000)):
        (tmp_path / f"{name}.jsonl").write_text("{}")
        os.utime(tmp_path / f"{name}.jsonl", (at, at))
    assert [r.path.rsplit("/", 1)[-1] for r in sessions.files(spark, str(tmp_path), since="2022-01-01T00:00:00").collect()] == ["new.jsonl"]
    (tmp_path / "sessions-index.json").write_text(json.dumps({"entries": [{"sessionId": "x", "summary": " S "}, {"sessionId": "y"}, 3]}))
    assert [tuple(r) for r in sessions.index_titles(spark, str(tmp_path)).collect()] == [("x", "S")]


def test_projections_of_layouts(spark):
    """Older content, states, prompts and nicknames."""
    part = "struct<kind:string,text:string,tool:string,state:string,nickname:string>"
    rows = [
        ("s", 1, "User", [("text", " a ", None, None, None)], '["old", {"text": " older "}]', " Nick "),
        ("s", 2, None, [("tool", None, "bash", '{"arguments": {"n": 1}, "output": " out ", "prompt": " p "}', " Ann ")], None, None),
        ("s", 3, "x", [("tool", None, "t", "[1]", None), ("tool", None, "u", None, None)], " ", None),
        ("t", 1, "x", [], None, None),
    ]
    messages = spark.createDataFrame(rows, f"session string, seq long, role string, parts array<{part}>, content string, nickname string")
    a, b, c, _ = views.transcript(messages).orderBy("session", "seq").collect()
    assert (a.texts, a.nickname) == (["a", "old", "older"], "Nick")
    assert [tuple(x) for x in b.calls] == [("bash", '{"n":1}', " out ", "p", "Ann")] and [tuple(x)[1:] for x in c.calls] == [(None,) * 4] * 2
    assert {r.session: r.content for r in views.searchable(messages).collect()} == {"s": 'a\n\nold\n\nolder\n\n{"n":1}\n\nout\n\np', "t": ""}


def test_paths(spark):
    from tidemark.functions import text
    from tidemark.operators import filters

    told = {"/a/../b": "/b", "a//b/./c": "/w/a/b/c", "..": "/", "../..": "/", "~": "/home/u", "~/x/..": "/home/u", "~x": "/w/~x", "/": "/", "//x": "/x", " /a ": "/a", "/a/": "/a", ".": "/w"}
    rows = spark.createDataFrame([(p,) for p in (*told, "", "  ", None)], "p string")
    assert {r.p: r.n for r in rows.select("p", text.normal_path(F.col("p"), "/w", "/home/u").alias("n")).collect()} == told | {"": None, "  ": None, None: None}
    assert {p: filters.scope_path(p, "/w", "/home/u") for p in told} == told
    assert filters.parse_query("x path:../y", "/w/z").path == "/w/y" and filters.parse_uri("agents://w/./p1/../p2?q=a").path == "/w/p2"
    tools = spark.createDataFrame([("exec_command",), ("Shell",), ("other",)], "t string")
    assert [r[0] for r in tools.select(text.tool_title(F.col("t"), "kimi")).collect()] == ["exec_command", "bash", "other"]


def test_grams_of_a_long_text_in_one_pass(spark):
    """The time of cutting trigrams grows with a text's length, not with its square."""
    texts = ["ab", "Abcab", "a😀b\nc", "éèê x"]
    grams = search.gram_table(spark.createDataFrame([("p", t, "", t) for t in texts], "provider string, session_id string, title string, content string"))
    found = {(r.session_id, r.gram) for r in grams.collect()}
    assert found == {(t, t.lower()[i : i + 3]) for t in texts for i in range(len(t) - 2)}
    long = spark.range(1).select(F.lit("p").alias("provider"), F.lit("1").alias("session_id"), F.lit("").alias("title"), F.repeat(F.lit("abcdefghij"), 60_000).alias("content"))
    began = time.perf_counter()
    assert search.gram_table(long).count() == 10 and time.perf_counter() - began < 20
