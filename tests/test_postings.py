"""The kept index against the scan, its upkeep, versions and what it reads."""

import json
import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, filters, postings, search
from tidemark.operators.search import TextQuery

NOW = datetime(2026, 5, 1)
SEEN = "provider string, session_id string, signature string, title string, updated_at long, created_at long"
CORPUS = "provider string, session_id string, content string"


@pytest.fixture
def root():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def filled(spark, root, rows, now=NOW, **more):
    """``rows``: key to (signature, title, content)."""
    seen = spark.createDataFrame([(*k, s, t, i, i % 2) for i, (k, (s, t, _)) in enumerate(sorted(rows.items()))], SEEN)
    return postings.refresh(spark, root, seen, spark.createDataFrame([(*k, c) for k, (_, _, c) in rows.items()], CORPUS), F.lit(now), **more)


def talk(rng, n):
    return "".join(rng.choice(["abc", "Abd", " ", "deploy", "认", "证", "认证", "码", ", ", "ß", "İx", "ΟΔΟΣ", "é", "7", "\n"]) for _ in range(n))


def test_equals_the_scan(spark, root):
    rng = random.Random(2)
    rows = {(rng.choice(("pi", "kimi")), f"s{i}"): ("1", talk(rng, rng.randint(0, 4)), talk(rng, rng.randint(0, 40))) for i in range(60)}
    rows |= {("pi", "empty"): ("1", "", ""), ("pi", "title"): ("1", "deploy abcabcabc", ""), ("pi", "unread"): ("1", "deploy", None)}
    held = filled(spark, root, rows)
    assert held.n == 62
    corpus = held.corpus()
    assert {(r.provider, r.session_id): (r.title, r.content) for r in corpus.collect()} == {k: v[1:] for k, v in rows.items() if v[2] is not None}
    for raw in ("deploy", "abcab deplo", "abcabc", "ΟΔΟΣ", "οδοσ", "ixab", "straße", "zzz", "abc zzz", "ab", "ab deploy", "认 abc", "", "认证abc"):
        query = TextQuery.terms(raw)
        want = {(r.provider, r.session_id): (r.rank, r.snippet) for r in search.search(corpus, query).collect()}
        found = {(r.provider, r.session_id): (r.rank, r.snippet) for r in postings.search(held, query).collect()}
        assert set(found) == set(want) and all(found[k][1] == v[1] and abs(found[k][0] - v[0]) < 2e-6 for k, v in want.items()), raw
        if raw not in ("deploy", "abcab deplo", "ab", "οδοσ"):
            continue
        few = [(r.session_id, round(r.rank, 5)) for r in postings.search(held, query, limit=5).collect()]
        assert few == [(r.session_id, round(r.rank, 5)) for r in search.search(corpus, query, limit=5).collect()], raw
        scope = spark.createDataFrame([k for k in rows if k[0] == "pi"], "provider string, session_id string")
        assert {r.session_id for r in postings.search(held, query, scope).collect()} == {k[1] for k in want if k[0] == "pi"}


def test_words_are_adjacent_characters(spark, root):
    rows = {("p", str(i)): ("1", "", c) for i, c in enumerate(["修复认证模块", "认知经过证明", "认, 证 认证", "x认证", "认 证", "abc认证 认证"])}
    held = filled(spark, root, rows)
    found = postings.search(held, TextQuery.terms("认证")).collect()
    # "认 证" is a phrase for the ranks but no literal; "x认" is one word
    assert {r.session_id for r in found} == {"0", "2", "5"}
    counts = {r.session_id: r.tf0 for r in postings.phrase_counts(held, TextQuery.terms("认证"), True).collect()}
    assert counts == {"0": 1.0, "2": 2.0, "4": 1.0, "5": 1.0}
    assert held.words == 6 + 6 + 4 + 2 + 2 + 4
    said = spark.createDataFrame([("认 证 模 块",), ("a **认** **证** **码** 块 x",), ("**认 证** 块",), ("块 **认** b  c",)], "s string")
    assert [r[0] for r in said.select(search.join_cjk(F.col("s"))).collect()] == ["认证模块", "a **认证码**块 x", "**认证**块", "块**认** b c"]


def test_refresh_touches_changed_sessions(spark, root):
    rows = {("p", f"s{i}"): ("1", "t", f"alpha number{i}") for i in range(30)} | {("q", "gone"): ("1", "t", "alpha")}
    one = filled(spark, root, rows)
    changed = rows | {("p", "s3"): ("2", "u", "beta"), ("p", "new"): ("1", "t", "beta"), ("p", "s4"): ("2", "u", None)}
    del changed["q", "gone"]
    two = filled(spark, root, changed, NOW + timedelta(days=10))
    assert two.n == 32 and len(two.segments) == 2
    fresh = two.segments[1]
    assert {r.session_id for r in two.table("grams").filter(F.col("segment") == fresh).select("session_id").distinct().collect()} == {"s3", "new"}
    ids = lambda snapshot, raw: {r.session_id for r in postings.search(snapshot, TextQuery.terms(raw)).collect()}
    assert ids(two, "beta") == {"s3", "new"} and "s3" not in ids(two, "alpha") and {"s4", "gone"} <= ids(two, "alpha")
    # the version opened before is what it was
    assert ids(one, "beta") == set() and "s3" in ids(one, "alpha") and postings.current(spark, root) == two
    # s4's change is tried again
    three = filled(spark, root, changed | {("p", "s4"): ("2", "u", "beta")}, NOW + timedelta(days=32))
    assert ids(three, "beta") == {"s3", "new", "s4"} and three.n == 31 and "gone" not in ids(three, "alpha")
    whole = postings.compact(spark, root)
    assert len(whole.segments) == 1 and (whole.n, whole.grams, whole.words) == (three.n, three.grams, three.words)
    assert ids(whole, "beta") == {"s3", "new", "s4"} and whole.table("grams").join(whole.state(), ["session_id", "segment"], "left_anti").count() == 0
    again = filled(spark, root, {("p", "s1"): ("1", "t", "gamma")}, NOW + timedelta(days=33), rebuild=True)
    assert again.n == 1 and ids(again, "gamma") == {"s1"}
    assert postings.clear(spark, root, "p").n == 0 and ids(postings.current(spark, root), "gamma") == set()


def test_other_formats_and_stopped_runs(spark, root):
    filled(spark, root, {("p", "a"): ("1", "t", "alpha")})
    pointer = os.path.join(root.removeprefix("file://"), "current")
    told = json.load(open(pointer))
    with open(pointer, "w") as f:
        json.dump(told | {"format": 0}, f)
    os.remove(os.path.join(root.removeprefix("file://"), ".current.crc")) if os.path.exists(os.path.join(root.removeprefix("file://"), ".current.crc")) else None
    assert postings.current(spark, root).n == 0
    # what another format left is not reused; the rebuilt index is whole
    held = filled(spark, root, {("p", "a"): ("1", "t", "alpha"), ("p", "b"): ("1", "t", "alpha")})
    assert held.n == 2 and held.version == 2 and len(held.segments) == 1


def test_a_limit_reads_few_texts(spark, root):
    rows = {("p", f"s{i:04d}"): ("1", "t", f"common {'word ' * (i % 50)}" + "filler " * 500) for i in range(400)}
    held = filled(spark, root, rows, parts=8)
    found = postings.search(held, TextQuery.terms("common word"), limit=3)
    want = search.search(held.corpus(), TextQuery.terms("common word"), limit=3)
    assert [(r.session_id, round(r.rank, 5)) for r in found.collect()] == [(r.session_id, round(r.rank, 5)) for r in want.collect()]
    plan = found._jdf.queryExecution().toString()
    assert "In(session_id" in plan.replace(" ", "") or "session_idIN" in plan.replace(" ", "") or "EqualTo(session_id" in plan


def test_queries_use_the_index(spark, root):
    rows = {("pi", "a"): ("1", "deploy plan", ""), ("pi", "b"): ("1", "deploy two", "about deploy"), ("kimi", "c"): ("1", "x", "ab")}
    held = filled(spark, root, rows)
    sessions = spark.createDataFrame([(*k, t, "/w", i, i % 2) for i, (k, (_, t, _)) in enumerate(sorted(rows.items()))], "provider string, session_id string, title string, working_directory string, updated_at long, created_at long")
    messages = spark.createDataFrame([("pi", "b", 0, "user", "about deploy"), ("kimi", "c", 0, "user", "ab")], "provider string, session_id string, seq int, role string, text string")
    for spec, ranked in ((filters.QuerySpec(keyword="deploy"), False), (filters.QuerySpec(keyword="deploy", limit=1), True), (filters.QuerySpec(keyword="ab", providers=("kimi",)), True), (filters.QuerySpec(keyword="deploy plan"), True)):
        told = lambda rows: [(r.session_id, round(r.rank, 5), r.snippet) for r in rows.orderBy("session_id").collect()]
        scanned = told(evaluate.matches(spec, sessions, messages, ranked))
        assert scanned and told(evaluate.matches(spec, sessions, messages, ranked, index=held)) == scanned
    assert [r.session_id for r in evaluate.matches(filters.QuerySpec(keyword="deploy"), sessions, messages).orderBy("session_id").collect()] == ["a", "b"]


def test_postings_grow_with_blocks_not_with_texts(spark, root):
    rng = random.Random(5)
    rows = {("p", f"s{i:03d}"): ("1", "认证", " ".join(rng.choice(["认证", "模块", "代码 认", "x认"]) for _ in range(40))) for i in range(300)}
    held = filled(spark, root, rows)
    # a row for each token and block, not for each token and text; trigrams of CJK characters answer no query
    blocks = held.packed("words").select("segment", "block").distinct().count()
    assert held.packed("words").count() <= 6 * blocks <= 6 * 4
    assert held.packed("grams").count() == 0 and held.table("words").select("session_id").distinct().count() == 300
    query = TextQuery.terms("认证 代码")
    docs = held.packed("docs")
    one, many = ({(r.number, r.field, r.token, tuple(r["at"])) for r in postings.postings_of(docs, True, limit).mapInArrow(postings._by_session, "token long, segment string, number long, field int, at array<int>").collect()} for limit in (postings.BLOCK, 50))
    assert one == many
    counts = {r.session_id: (r.tf0, r.tf1) for r in postings.phrase_counts(held, query, True).collect()}
    for (_, s), (_, _, text) in rows.items():
        words = text.replace("x认", "w").replace(" ", "")
        plain = (words.count("认证") + 1.0, float(words.count("代码")))
        assert counts.get(s) == plain, (s, text)
