"""Settings files and the predicate of denied folders."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.settings import Settings, expand, read_settings


def test_settings(spark):
    got = read_settings("""
[collect]
summary_concurrency = 99
summary_timeout_seconds = "x"
[export]
output = " /out "
[agent.pi]
deny = ["/secret", "/w"]
[agent.codex]
deny = [1]
[shortcut.week]
params = ["days"]
args = ["--list", "-days", "{days}"]
[shortcut.bad]
args = []
""")
    assert got == Settings(32, 90, {"pi": ("/secret", "/w")}, "/out", {"week": (("days",), ("--list", "-days", "{days}"))})
    assert read_settings("= broken") == read_settings("") == read_settings("collect = 3") == Settings()
    rows = spark.createDataFrame([("pi", "/w/a"), ("pi", "/wide"), ("codex", "/w"), ("pi", None)], "p string, d string")
    assert [tuple(r) for r in rows.filter(got.allowed(F.col("p"), F.col("d"))).collect()] == [("pi", "/wide"), ("codex", "/w"), ("pi", None)]


def test_shortcuts():
    preset = Settings(shortcuts={"day": (("date", "who"), ("--list", "~/{year_month}/{who}", "{{{date}}}", "{month}-{year}")), "odd": ((), ("{x:>3}",)), "gone": ((), ("{x}",))})
    assert expand(["-v", "--shortcut", "day", "2026-03-09", "me", "--days", "3"], preset) == ["-v", "--list", os.path.expanduser("~/2026-03/me"), "{20260309}", "03-2026", "--days", "3"]
    assert expand(["--list"], preset) == ["--list"]
    for bad in (["--shortcut"], ["--shortcut", " "], ["--shortcut", "no"], ["--shortcut", "day", "20260309"], ["--shortcut", "day", "soon", "me"], ["--shortcut", "odd"], ["--shortcut", "gone"]):
        with pytest.raises(ValueError):
            expand(bad, preset)
