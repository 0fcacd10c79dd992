"""Pairs of groups by tiles and one by one, and few edges without exchanges."""

import random

import numpy as np

from tidemark.llm import components, jaccard


def test_tiles_find_what_pairs_find(spark, monkeypatch):
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(40)], np.uint64)) for _ in range(120)]
    rows = []
    for g in range(40):
        own = range(g * 3, g * 3 + 3)
        tokens = b"".join(sets[i].tobytes() for i in own)
        longs = lambda x: np.array(x, np.int64).tobytes()
        rows.append((g, longs(list(own)), longs(list(own)), longs([len(sets[i]) for i in own]), tokens, np.unique(np.frombuffer(tokens, np.uint64)).tobytes()))
    groups = spark.createDataFrame(rows, "gid long, classes binary, nodes binary, sizes binary, tokens binary, union binary")
    # groups 0 to 19 all meet; of the others a few
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)] + [(a, a + 7) for a in range(20, 33)]
    met, settle = {}, jaccard.settle

    def keep(rows, tag, **how):
        met[tag] = settle(rows, tag, **how)
        return met[tag]

    monkeypatch.setattr(jaccard, "settle", keep)
    found = {tuple(sorted(r)) for r in jaccard.cross_groups(groups, spark.createDataFrame(pairs, "a long, b long"), 45).collect()}
    near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 45 * len(np.union1d(sets[i], sets[j]))
    want = {(min(i, j), max(i, j)) for a, b in [*pairs, *((g, g) for g in range(40))] for i in range(a * 3, a * 3 + 3) for j in range(b * 3, b * 3 + 3) if i != j and near(i, j)}
    assert len(want) > 10 and found == want
    # 190 pairs among 20 groups of two tiles are at most three rows, not 190
    sizes = [len(r.pairs) for r in met["pairs"].collect()]
    assert sum(sizes) == len(pairs) and sum(n for n in sizes if n >= jaccard.TILE_GROUPS) >= 170


def test_few_edges_meet_without_exchange(spark, monkeypatch):
    plans, settle = [], components.settle

    def keep(rows, tag):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return settle(rows, tag)

    monkeypatch.setattr(components, "settle", keep)
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 70)], "a long, b long")
    want = {**{i: 0 for i in range(31)}, **{i: 50 for i in (50, 70, 100)}}
    assert {r.node: r.component for r in components.connected_components(links).collect()} == want
    assert len(plans) > 1 and not any("Exchange" in p for p in plans[1:])
    few = len(plans)
    monkeypatch.setattr(components, "is_light", lambda edges: False)
    assert {r.node: r.component for r in components.connected_components(links).collect()} == want
    assert all("Exchange" in p for p in plans[few:])
