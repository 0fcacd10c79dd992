"""Scans that read only what names and headers leave, and line numbers over splits."""

import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.sources import jsonl, sessions


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60).map(lambda b: b.replace(b"x", b"\n")), st.integers(1, 20), st.integers(1, 9))
def test_ranges_hold_each_line_once(raw, width, step):
    found = []
    for start in range(0, len(raw), width):
        found += jsonl.range_lines(io.BytesIO(raw), start, min(start + width, len(raw)), len(raw), step)
    want = raw.split(b"\n")
    assert found == (want[:-1] if want[-1] == b"" else want)


def written(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.mark.parametrize("width", [300, 64 << 20])
def test_records_in(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(jsonl, "RANGE", width)
    lines = [json.dumps({"n": n, "pad": "é" * (n % 37)}) for n in range(120)]
    lines[7], lines[9] = "", "[1]"
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "y.jsonl").write_bytes(b'{"n": 1}\r\n\xff{}\n \t\r\n{"n": ')
    (tmp_path / "z.jsonl").write_bytes(b"")
    count = spark.sparkContext.accumulator(0)
    held = jsonl.files(spark, str(tmp_path))
    told = lambda rows: sorted((r.path, r.line, r.record or "", r.bad or 0) for r in rows.collect())
    assert told(jsonl.records_in(held.filter("path like '%x.jsonl'"), count)) == [r for r in told(jsonl.records(spark, str(tmp_path))) if r[0].endswith("x.jsonl")]
    size = (tmp_path / "x.jsonl").stat().st_size
    assert count.value == (size if width > size else 2 * size)
    assert told(jsonl.records_in(held)) == told(jsonl.records(spark, str(tmp_path)))
    assert jsonl.records_in(held.limit(0)).count() == 0


def test_no_window_over_a_file(spark, tmp_path):
    """Records are dealt by (path, split); only one row a split is dealt by path."""
    written(tmp_path / "a.jsonl", [{"n": 1}])
    plan = jsonl.records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    for window in (line for line in plan.splitlines() if "Window [" in line):
        spec = window.split("windowspecdefinition(")[1]
        assert "start" in spec.split("ASC")[0] if "count(1)" in window else "record" not in window


def test_look_up_opens_one_file(spark, tmp_path):
    for i in range(20):
        turn = {"timestamp": f"2026-01-01T00:00:{i:02d}Z", "cwd": "/w", "message": {"role": "user", "content": f"t{i}"}}
        written(tmp_path / "p" / f"sess-{i:02d}.jsonl", [turn] * (i + 1))
    written(tmp_path / "q" / "rollout-2026-01-01-other.jsonl", [{"type": "session_meta", "payload": {"id": "inside", "cwd": "/w"}}])
    count = spark.sparkContext.accumulator(0)
    (row,) = sessions.look_up(spark, str(tmp_path / "p"), "claudecode", "sess-07", count=count).collect()
    size = (tmp_path / "p" / "sess-07.jsonl").stat().st_size
    assert (row.title, row.message_count) == ("t7", 8) and 0 < count.value <= 2 * size
    # an id that no name holds is found by reading
    assert [r.session_id for r in sessions.look_up(spark, str(tmp_path / "q"), "codex", "inside").collect()] == ["inside"]
    assert sessions.look_up(spark, str(tmp_path / "q"), "codex", "nowhere").count() == 0


def test_kimi_by_headers(spark, tmp_path):
    for i in range(6):
        folder = tmp_path / "s" / "h" / f"k{i}"
        written(folder / "context.jsonl", [{"role": "user", "content": "hello " * 50}] * (i + 1))
        (folder / "metadata.json").write_text(json.dumps({"session_id": f"k{i}", "title": "T", "wire_mtime": 1000 + i}))
    count = spark.sparkContext.accumulator(0)
    got = sessions.kimi_sessions(spark, str(tmp_path / "s"), since=F.timestamp_seconds(F.lit(1004)), count=count).orderBy("session_id").collect()
    assert [(r.session_id, r.message_count) for r in got] == [("k4", 5), ("k5", 6)]
    assert 0 < count.value <= sum((tmp_path / "s" / "h" / f"k{i}" / "context.jsonl").stat().st_size for i in (4, 5))
    whole = sessions.kimi_sessions(spark, str(tmp_path / "s")).orderBy("session_id").collect()
    assert [(r.session_id, r.message_count) for r in whole] == [(f"k{i}", i + 1) for i in range(6)]
