"""File sink and conditions of the SQLite source."""

import sqlite3

import pytest

from tidemark.sources import sinks, sqlite


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x y.md", "é\n"), ("b.json", None), ("a/x y.md", "é\n")], "file string, content string")
    assert sinks.write_files(rows, str(tmp_path / "out")) == 3
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")} == {"a/x y.md": "é\n", "b.json": ""}
    assert sinks.write_files(rows.filter("false"), str(tmp_path / "none")) == 0


def store(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("create table message(id text, session_id text, time_created, data text)")
        db.executemany("insert into message values (?,?,?,?)", rows)
    return str(path)


def test_conditions_in_the_store(spark, tmp_path):
    rows = [("a1", "s", 1, "{}"), ("a2", "s", 5, None), ("b1", "t", "x", b"\xff"), ("b2", "t", None, "é"), ("ä", "u", 9, "")]
    path = store(tmp_path / "m.db", rows) + "," + store(tmp_path / "n.db", [])
    got = sqlite.load(spark, path, "message")
    assert [(r.id, r.time_created, r.data) for r in got.orderBy("id").collect()] == [("a1", 1, "{}"), ("a2", 5, None), ("b1", None, "�"), ("b2", None, "é"), ("ä", 9, "")]
    ids = lambda *where: [r.id for r in sqlite.load(spark, path, "message", *where).orderBy("id").collect()]
    assert ids(("time_created", ">", 1)) == ["a2", "ä"] and ids(("session_id", "in", ["s", "u"]), ("time_created", "<=", 5)) == ["a1", "a2"]
    assert ids(("id", ">=", "b"), ("data", "=", "é")) == ["b2"] and ids(("session_id", "<>", "s"), ("time_created", "=", 9)) == ["ä"] and ids(("id", "in", [])) == []
    assert got.filter("time_created = 9").count() == 1 and got.count() == 5
    for bad in (("nope", "=", 1), ("id", "like", "a"), ("id", "in", "a")):
        with pytest.raises(ValueError):
            sqlite.load(spark, path, "message", bad)
