"""Splitters of the histogram sort against those of a full sort."""

import random
from itertools import accumulate

import pytest

from tidemark.llm import sharding

THIN = "h long, id long, row long, size long"


@pytest.mark.parametrize("case", ["plain", "hot text", "one large row", "few rows", "none"])
def test_splitters_equal_a_full_sort(spark, monkeypatch, case):
    monkeypatch.setattr(sharding, "PROBES", 8)
    rng, shards, tolerance = random.Random(case), 7, 0.002
    n = {"few rows": 4, "none": 0}.get(case, 3000)
    hashes = [5] * n if case == "hot text" else [rng.randint(-(2**63), 2**63 - 1) for _ in range(n)]
    rows = [(h, rng.choice((-(2**63), rng.randint(0, 50))), i, rng.randint(1, 90)) for i, h in enumerate(hashes)]
    if case == "one large row":
        rows[1234] = (*rows[1234][:3], 60_000)
    cuts = sharding.splitters(spark.createDataFrame(rows, THIN).repartition(4), shards, tolerance)
    assert len(cuts) == shards - 1 and cuts == sorted(cuts)
    whole = sorted(rows)
    below = [0, *accumulate(r[3] for r in whole)]
    for i, cut in enumerate(cuts):
        goal = below[-1] * (i + 1) / shards
        got = sum(r[3] for r in rows if r[:3] < cut)
        best = min(abs(b - goal) for b in below)
        assert abs(got - goal) <= max(best, tolerance * below[-1] / shards) + 1e-9


def test_null_ids_and_a_row_larger_than_a_shard(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (1, None), (2, "x" * 10_000), *[(i, f"t{i}") for i in range(10, 60)]]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=4).collect()
    assert len(found) == len(rows) and {r.shard for r in found} <= set(range(4))
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    # equal texts lie together, null ids first
    same = sorted((r.shard, r.slot, r.doc_id is not None) for r in found if r.text == "a")
    assert [x[2] for x in same] == [False, False, True] or len({x[0] for x in same}) > 1
