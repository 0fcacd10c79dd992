"""Near copies that are all below the threshold: how many groups are paired."""

import random

from tidemark.llm import jaccard


def test_common_passages_fill_groups(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for d in range(300):
        words = list(base)
        for i in rng.sample(range(5, 145), 4):
            words[i] = f"d{d}x{i}"
        texts[d] = " ".join(words)
    texts[300] = texts[7].replace("w149", "end")
    kept, settle = {}, jaccard.settle

    def keep(rows, tag, **how):
        kept[tag] = settle(rows, tag, **how)
        return kept[tag]

    monkeypatch.setattr(jaccard, "settle", keep)
    monkeypatch.setattr(jaccard, "discard", lambda *rows: None)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in texts.items())}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert (7, 300) in links and len(links) < 20
    want = {d: d for d in sets}
    for _ in sets:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert found == want
    # almost all sets come this far, and share common prefix tokens; 300 sets are five groups of 64
    assert kept["left"].count() > 250 and kept["groups"].count() <= 16
