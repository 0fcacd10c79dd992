"""Windowed counts of a growing archive."""

import json

from pyspark.sql import functions as F

from tidemark.streaming.live import message_counts


def test_message_counts(spark, tmp_path):
    put = lambda name, *rows: (tmp_path / "in" / name).write_text("".join(json.dumps({"provider": p, "ts": t}) + "\n" for p, t in rows))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("provider string, ts timestamp").json(str(tmp_path / "in"))
    counts = message_counts(stream).select(F.date_format("window.start", "HH:mm").alias("start"), "provider", "messages")

    def step():
        query = counts.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    put("1.json", ("pi", "2026-01-01T10:01:00Z"), ("pi", "2026-01-01T10:09:59Z"), ("codex", "2026-01-01T10:10:00Z"))
    step()
    put("2.json", ("pi", "2026-01-01T12:00:00Z"))
    step()
    # over an hour behind: left out; the windows that closed stay as they were
    put("3.json", ("pi", "2026-01-01T10:02:00Z"))
    step()
    got = spark.read.schema("start string, provider string, messages long").parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [("10:00", "pi", 2), ("10:10", "codex", 1)]
