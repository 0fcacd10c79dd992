"""The level-by-level reduction against a plain one, with a merge that counts its calls."""

import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reduction

FIELDS = ("topics", "notes", "errors", "files", "topics2")


def fold(items, limit=12):
    out = {}
    for x in items:
        if x.strip():
            out.setdefault(" ".join(x.split()).lower(), " ".join(x.split()))
    return list(out.values())[:limit]


def plain(level, merge, large):
    depth = 0
    while len(level) > 1:
        depth += 1
        above = []
        for i in range(0, len(level), 8):
            some = level[i : i + 8]
            joined = {f: fold([x for s in some for x in s[f]]) for f in FIELDS}
            if sum(map(len, joined.values())) > large and merge is not None:
                said = merge(some)
                joined = {f: fold(said.get(f, [])) for f in FIELDS} if said is not None else joined
            above.append(joined)
        level = above
    return level[0], depth


@pytest.mark.parametrize("n, large", [(100, 30), (100, 48), (9, 20), (1, 1)])
def test_reduction(spark, n, large):
    level = [{"topics": [f"Topic {i}", " topic  0 "], "notes": [f"n{i * j % 17}" for j in range(6)], "errors": ["", "E"], "files": [f"f{i}"] * 2, "topics2": [f"t{i % 5}"]} for i in range(n)]
    calls = tempfile.mkdtemp(prefix="spark-")

    def said(payloads):
        """Shorter fields, in an order that shows which summaries came in; fails for some nodes."""
        first = payloads[0]["topics"][0] if payloads[0]["topics"] else ""
        if first.endswith("3"):
            return None
        return {"topics": [f"{len(payloads)} {first}"], "notes": [x for p in payloads for x in p["notes"]][::-1], "files": ["f " * 3]}

    def merge(payloads):
        found = said(payloads)
        with open(os.path.join(calls, hashlib.md5(json.dumps(payloads).encode()).hexdigest()), "a") as f:
            f.write("x")
        if found is None:
            raise RuntimeError("no answer")
        return json.dumps(found)

    rows = spark.createDataFrame([(i % 7, i, *[s[f] for f in FIELDS]) for i, s in enumerate(level)], f"a int, b int, {', '.join(f'{f} array<string>' for f in FIELDS)}").repartition(5)
    ordered = [s for _, _, s in sorted((i % 7, i, s) for i, s in enumerate(level))]
    seen = []

    def counting(payloads):
        seen.append(1)
        return said(payloads)

    want, depth = plain(ordered, counting, large)
    (got,) = reduction.reduce_tree(rows, ["a", "b"], FIELDS, merge, large=large).collect()
    assert ({f: got[f] for f in FIELDS}, got.sessions, got.depth) == (want if depth else {f: fold(want[f]) for f in FIELDS}, n, depth)
    assert sum(os.path.getsize(os.path.join(calls, x)) for x in os.listdir(calls)) == len(seen)


def test_answers_are_kept(spark):
    """A task that runs again reads the answers that are there."""
    nodes = spark.createDataFrame([(0, [(["a"],)]), (1, [(["b"],)])], "n long, of array<struct<topics:array<string>>>").repartition(1)
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    calls = tempfile.mkdtemp(prefix="spark-")

    def merge(payloads):
        with open(os.path.join(calls, payloads[0]["topics"][0]), "a") as f:
            f.write("x")
        return json.dumps(payloads[0])

    for _ in range(2):
        assert sorted(r.payload for r in reduction._asked(nodes, merge, ("topics",), folder).collect()) == ['{"topics": ["a"]}', '{"topics": ["b"]}']
    assert [os.path.getsize(os.path.join(calls, x)) for x in sorted(os.listdir(calls))] == [1, 1]


def test_no_summaries(spark):
    assert reduction.reduce_tree(spark.createDataFrame([], "a int, topics array<string>"), ["a"], ("topics",)).count() == 0


def test_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(6)
    assert {(r.k, r.n) for r in reduction.numbered(rows, ["k"]).collect()} == {(i, i) for i in range(1000)}
