"""Every pipeline stage on nulls, empty and long texts, repeated rows, extra columns and an empty table."""

import random
import re
from collections import Counter

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, digest string, epoch string, kept boolean"


def test_stages_on_edge_rows(spark):
    rng = random.Random(3)
    stock = {x: ["".join(rng.choice(x) for _ in range(5)) for _ in range(40)] for x in ("abcdefg", "stuvwxyz")}
    make = lambda letters, n: " ".join(rng.choice(stock[letters]) for _ in range(n))
    rows = [(i, make("abcdefg" if i % 2 else "stuvwxyz", 40), "en" if i % 2 else "de", f"src{i % 3}") for i in range(30)]
    rows += [(100, None, "en", "src0"), (101, "", None, None), (102, " \n", "en", "src0"), (103, "1 2 3", "en", "src1"), (104, make("abcdefg", 20_000), None, None)]
    rows += [rows[4], rows[5], (None, rows[6][1], "de", "src0"), (None, None, None, None), (105, rows[7][1].replace(" ", "\t\n"), "en", "src2")]
    docs = spark.createDataFrame([(*r, None, 1, "d", "e", True) for r in rows], DOCS).repartition(3)
    tidy = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        found = out.collect()
        if name != "packing":
            assert out.columns == docs.columns, name
        if name == "language":
            assert Counter(r.doc_id for r in found) == Counter(i for i, t, *_ in rows if re.search(r"[^\W\d_]", t or ""))
        elif name == "exact dedup":
            assert Counter(tidy(r.text) for r in found) == Counter({tidy(t) for _, t, *_ in rows})
            first = {}
            for i, t, *_ in rows:
                first[tidy(t)] = min(first.get(tidy(t), 1 << 60), 1 << 60 if i is None else i)
            assert all((1 << 60 if r.doc_id is None else r.doc_id) == first[tidy(r.text)] for r in found)
        elif name == "near dedup":
            # copies by words share their set: 105 is a copy of 7; rows of one id stay together
            assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in rows if i != 105)
        elif name == "mixing":
            assert {r.doc_id for r in found} <= {i for i, *_ in rows} and max(Counter((r.doc_id, r.text) for r in found).values()) <= 8
        else:
            assert {r.doc_id for r in found} == {i for i, *_ in rows} and sum(r.length for r in found if r.doc_id == 100) == 1
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns), name
