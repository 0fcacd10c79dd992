"""Folders listed by tasks against Spark's own listing."""

import os
import tempfile

from tidemark.sources import jsonl


def test_listing_and_records_by_tasks(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    names = ["a b+c%20.jsonl", "x/1.jsonl", "x/y/é.jsonl", "x/y/other.txt", "_hidden/2.jsonl", ".h.jsonl", "x/_3.jsonl", "k=v/4.jsonl", "empty/5.jsonl"]
    for n, name in enumerate(names):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write("" if name.startswith("empty") else "".join(f'{{"n": {n}, "i": {i}}}\nbad\n' for i in range(n + 1)) + '{"cut')
    for pattern in ("*.jsonl", "*", "1.jsonl"):
        plain = jsonl._reader(spark, "binaryFile", pattern, None).load(root).select("path", "modificationTime", "length")
        mine, given = ({tuple(r) for r in rows.collect()} for rows in (jsonl.files(spark, root, pattern), plain))
        assert mine == given, (mine - given, given - mine)
    assert {r.path for r in jsonl.files(spark, f"file://{root}").collect()} == {r.path for r in jsonl.files(spark, root).collect()}
    rows = jsonl.records(spark, root)
    # no file of the folder is in a plan, so none is listed on the driver
    assert not any(os.path.basename(root) in x for x in rows.inputFiles())
    split = jsonl.records(spark, root, since="1990-01-01T00:00:00")
    assert any(os.path.basename(root) in x for x in split.inputFiles())
    told = lambda rows: sorted(map(str, rows.collect()))
    assert told(rows) == told(split) and rows.count() == sum(2 * (n + 1) for n in (0, 1, 2, 7))
    held = jsonl.files(spark, root, "other.txt")
    assert [r.value.count("bad") for r in jsonl.texts_of(held).collect()] == [4]
