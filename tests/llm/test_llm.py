"""Training-data operators against plain versions, with nulls, empties, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import embed, exact, jaccard, langid, learners, mixing, packing, quality, sharding, toxicity, warc
from tidemark.llm.components import connected_components
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.tokens import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, digest string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words(rng, 80).split()
    out = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, words(rng, 20_000)), (7, "x y z")]
    for i in range(8, 60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = "zz" + str(rng.randrange(9))
        out.append((i, " ".join(copy) if i % 2 else words(rng, rng.randint(1, 60))))
    out += [(60, out[8][1]), (61, out[8][1]), (7, "x y z"), (None, "x y z")]
    return [(i, t, None if (i or 0) % 7 == 3 else "en" if (i or 0) % 3 else "de", None if i == 9 else f"src{(i or 0) % 12}", None, 99, "d") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def reach(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5)] + [(300, i) for i in range(301, 340)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reach({x for p in links for x in p}, links)
    assert found == {n: c for n, c in want.items() if n in found} and len(found) == 40 + 1 + 2 + 40


def word_tuples(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(docs, none, rows):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        sets[i].append(word_tuples(t))
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids for x in sets[a] for y in sets[b] if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = reach(ids, links)
    found = jaccard.jaccard_classes(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == want.get(r.doc_id) and r.n_shingles in [len(s) for s in sets[r.doc_id]]
    assert jaccard.jaccard_classes(none).count() == 0
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows if i is None or want[i] == i)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aAb \t\n\x0b\x85 é", max_size=40))
def test_shingles(t):
    assert len(shingle_set(t.encode())) == len(word_tuples(t))


def chains(rng, ends=3, steps=24):
    """Texts that drift away from their beginning a few words at a time, and texts that share most of their words without a link."""
    out = []
    for _ in range(ends):
        now = words(rng, 70).split()
        for _ in range(steps):
            now = now[:]
            now[rng.randrange(70)] = words(rng, 1)
            out.append(" ".join(now))
    common = [words(rng, 20) for _ in range(12)]
    out += [" ".join(rng.sample(common, 5)) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("fan, hashes", [(1024, 8), (5, 1)])
def test_jaccard_chains(spark, monkeypatch, fan, hashes):
    """Small blocks, parts dealt in one and in two steps, many and few hashes: the classes are the same."""
    rows = chains(random.Random(11))
    sets = [word_tuples(t) for _, t in rows]
    want = reach(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    monkeypatch.setattr(jaccard, "FAN", fan)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    monkeypatch.setattr(jaccard, "HASHES", hashes)
    found = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, TEXT string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == want and len(set(want.values())) < len(rows) - 20
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in found)


def test_exact(docs, none, rows):
    import hashlib

    name = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[name(t)].append(i)
    found = exact.exact_groups(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        g = groups[r.text_sha256]
        assert r.doc_id in g and r.group_size == len(g) and r.keep_id == min((x for x in g if x is not None), default=None)
    assert sum(r.kept for r in found) == len(groups) == exact.keep_distinct(docs).count()
    assert exact.exact_groups(none).count() == 0


def test_perfect_hash():
    digests = np.random.default_rng(1).integers(0, 256, (5000, 32), dtype=np.uint8)
    ph = exact.PerfectHash.loads(exact.PerfectHash(digests).dumps())
    assert sorted(ph.slots(digests)) == list(range(5000))


def test_language(docs, none, spark):
    rng = random.Random(2)
    stock = {x: ["".join(rng.choice(x) for _ in range(5)) for _ in range(40)] for x in ("abcdefg", "stuvwxyz")}
    make = lambda letters: " ".join(rng.choice(stock[letters]) for _ in range(60))
    rows = [(i, make("abcdefg") if i % 2 else make("stuvwxyz"), "one" if i % 2 else "two") for i in range(80)] + [(90, None, "one"), (91, "12 !", "one"), (None, make("abcdefg"), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(table)
    found = {r.doc_id: r for r in langid.identify(table, samples).collect()}
    assert all(found[i].lang_pred == ("one" if i % 2 else "two") and 0 <= found[i].score <= 1 for i in range(80))
    assert found[90].lang_pred == found[91].lang_pred == "und" and found[None].lang_pred == "one"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items() if i is not None)
    assert langid.keep_identified(docs, samples).columns == docs.columns
    assert langid.learn(none) == {} and {r.lang_pred for r in langid.identify(table, {}).collect()} == {"und"}


def test_many_languages(spark):
    rng = random.Random(6)
    stock = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)] for k in range(70)}
    rows = [(k * 10 + i, " ".join(rng.choice(stock[x]) for _ in range(50)), x) for k, x in enumerate(stock) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    samples = langid.learn(table)
    assert set(samples) == set(stock)
    found = {r.doc_id: r for r in langid.identify(table, samples).collect()}
    assert all(found[i].lang_pred == x and not found[i].rejected for i, _, x in rows)
    assert langid.keep_identified(table, samples).count() == len(rows)
    assert all(len(s) < 400 for s in langid.learn(table, sample_chars=50).values())


def test_languages_of_repeated_rows(spark):
    """Rows without an id, one row repeated, and one id with many texts are learned from."""
    rng = random.Random(9)
    stock = {x: ["".join(rng.choice(x) for _ in range(6)) for _ in range(30)] for x in ("abcdefg", "hijklmn", "opqrstu")}
    make = lambda x: " ".join(rng.choice(stock[x]) for _ in range(20))
    same = make("hijklmn")
    rows = [(None, make("abcdefg"), "none") for _ in range(2000)] + [(1, same, "same") for _ in range(2000)] + [(3, make("opqrstu"), "one") for _ in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    samples = langid.learn(table, sample_texts=50, sample_chars=4000)
    assert set(samples) == {"none", "same", "one"} and all(len(s) < 5500 for s in samples.values()) and len(samples["same"]) == len(same)
    found = langid.identify(table, samples).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in found} == {"none": 2000, "same": 2000, "one": 2000}
    odd = table.toDF("DOC_ID", "Text", "lang").selectExpr("*", "1 as score", "2 as lang_pred", "3 as rejected")
    assert langid.keep_identified(odd, samples).columns == odd.columns and langid.keep_identified(odd, samples).count() == 6000


def test_labels_of_repeated_rows(spark):
    """However often an id repeats, no more rows than the bound reach the driver."""
    features = spark.range(5000).selectExpr("id % 2 * 3 as doc_id", "cast(id as double) as x")
    labels = spark.createDataFrame([(3, 1), (3, 0), (0, None), (None, 1), (99, 1)], "doc_id long, quality int")
    found = quality.labelled(features, labels, "quality", 300)
    assert len(found) == len({r.x for r in found}) == 300 and {r.label for r in found} == {1}
    assert len(quality.labelled(features.selectExpr("doc_id", "1.0D as x"), labels, "quality", 300)) == 1


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack_documents(docs, tokenizer_path(), window=64).collect()
    got = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        got[p.doc_id].append(p)
    for i in {i for i, *_ in rows if i not in (7,)}:
        text = next(t for j, t, *_ in rows if j == i)
        assert sum((p.ids for p in sorted(got[i], key=lambda p: p.start)), []) == [*tool.encode(text or "", add_special_tokens=False).ids, 2]
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert all(n == 64 for s, n in filled.items() if s != max(filled))
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abXİéßΣ'’.,!?1 　\t\nᅡǅﬁ<|>", max_size=30))
def test_word_encoder(t):
    coder = packing._encoders.setdefault("test", packing.WordEncoder(tokenizer_path()))
    assert np.frombuffer(coder.encode([t])[0], "<u2").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_sharding(docs, none, rows):
    found = sharding.shard_documents(docs, shards=4).collect()
    assert len(found) == len(rows) and {"doc_id", "slot", "digest"} <= set(found[0].asDict())
    for s in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in rows) and all(r.size == len((r.text or "").encode()) + 1 for r in found)
    assert sharding.shard_documents(none).count() == 0


def test_sharding_balance(spark):
    same = [(i, "hot text" * 4) for i in range(400)] + [(1000 + i, f"text {i} " * 3) for i in range(400)]
    found = sharding.shard_documents(spark.createDataFrame(same, "doc_id long, text string"), shards=8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 100


def test_mixing(docs, none, spark):
    rows = [(i, "w " * 10, "en", "src0") for i in range(90)] + [(100 + i, "w " * 10, "en", "src1") for i in range(10)] + [(200, None, "de", None), (201, "w w", "de", "src9")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mix(table, budget=600, max_epochs=2).collect()
    tokens = Counter()
    for r in found:
        tokens[(r.lang, r.source)] += r.mix_tokens
    # de can give 4 tokens; what it cannot take goes to en: src1 gives all 200, the rest comes from src0
    assert tokens[("de", "src9")] == 4 and tokens[("en", "src1")] == 200 and 386 <= tokens[("en", "src0")] <= 396
    assert Counter(r.epoch for r in found if r.source == "src1") == {0: 10, 1: 10}
    assert mixing.mix(docs).columns[: len(docs.columns)] == docs.columns and mixing.mix(none).count() == 0


PATHS = "domain string, language string, source string, weight double"


def test_mixing_weights(spark, monkeypatch):
    rows = [(1000 * k + i, "w " * 10, "en", source) for k, source in enumerate(("a0", "a1", "b0", "c0")) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame([("a", None, None, 3.0), ("c", None, None, 0.0), ("a", "en", "a0", 2.0), ("a", "en", "a0", 1.0), ("b", "en", "a0", 9.0), ("other", None, None, None)], PATHS)
    taken = lambda budget: {r[0]: r[1] for r in mixing.mix(table, weights, budget, max_epochs=1).groupBy("source").sum("mix_tokens").collect()}
    # a and b as 3 to 1, a0 and a1 as 2 to 1, nothing of c
    assert taken(1200) == {"a0": 600, "a1": 300, "b0": 300}
    # a0 gives its 1000; the rest of a's 1800 goes to a1; with a plan too large to broadcast as well
    for rows_allowed, hot in ((500_000, 1_000_000), (0, 50), (0, 1_000_000)):
        monkeypatch.setattr("tidemark.llm.common.BROADCAST_ROWS", rows_allowed)
        monkeypatch.setattr(mixing, "HOT_ROWS", hot)
        assert taken(2400) == {"a0": 1000, "a1": 800, "b0": 600}
    for bad, why in ((("a", None, None, 0.7), "weights must be integers"), (("a", None, "a0", 1.0), "a weight names")):
        with pytest.raises(Exception, match=why):
            mixing.mix(table, spark.createDataFrame([bad], PATHS), 1200).collect()


def test_mixing_weight_of_nothing(spark):
    """A leaf of weight 0 leaves its share to the siblings above; the same name may weigh differently below another parent."""
    rows = [(k * 1000 + i, "w w", lang, source) for k, (lang, source, n) in enumerate((("x", "a1", 50), ("y", "a2", 5), ("x", "b1", 500))) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = lambda *weights: {r[0]: r[1] for r in mixing.mix(table, spark.createDataFrame(weights, PATHS), 600, max_epochs=1).groupBy("source").sum("mix_tokens").collect()}
    assert taken(("a", "x", "a1", 0.0)) == {"a2": 10, "b1": 590}
    assert taken(("a", "x", "a1", 1.0), ("a", "x", "a1", 1.0)) == {"a1": 100, "a2": 10, "b1": 490}
    assert taken(("a", "x", None, 0.0), ("b", "x", None, 7.0)) == {"a2": 10, "b1": 590}
    assert taken(("a", None, None, 0.0), ("b", None, None, 0.0)) == {}


def test_mixing_hot_ids(spark):
    """Null and repeated ids share a place; columns of any case and of the results' names."""
    rows = [(None, "w w w", "en", "a0", 1) for _ in range(300)] + [(7, "w", "en", "a0", 2) for _ in range(300)] + [(100 + i, "w " * i, None, None, 3) for i in range(20)]
    table = spark.createDataFrame(rows, "DOC_ID long, Text string, lang string, source string, epoch int")
    found = mixing.mix(table, budget=3000).collect()
    count = Counter((r.DOC_ID, r.epoch) for r in found if r.DOC_ID in (None, 7))
    # 2240 tokens are a0's: one epoch of 1200 and either group in the second
    assert set(count.values()) == {300} and len(count) == 3
    assert found[0].__fields__ == ["DOC_ID", "Text", "lang", "source", "epoch", "mix_tokens"] and sum(r.mix_tokens for r in found) <= 3000


def test_warc(spark):
    rows = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, "y"), (4, "u", "y"), (5, "u", None), (None, "u", "x" * 200), (2, "http://b", "x" * 200), (6, "u\r\nv", "é" * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = warc.read_archives(*warc.write_archives(pages, limit=500)).collect()
    assert Counter(r.page_id for r in found) == Counter(i for i, *_ in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert kinds[(1, "response", None)] == 1 and kinds[(2, "revisit", 1)] == 2 and kinds[(None, "revisit", 1)] == 1 and kinds[(3, "response", None)] == kinds[(4, "response", None)] == 1
    assert {r.payload_bytes for r in found if r.page_id == 6} == {120_000} and {r.payload for r in found if r.page_id == 5} == {b""}
    assert warc.read_archives(*warc.write_archives(pages.limit(0))).count() == 0


def test_zip64():
    import io
    import struct
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z, z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as m:
        m.write(b"payload")
    package = warc.Package(raw, len(raw.getvalue()))
    assert package.read(*package.span("a")) == b"payload"
    assert warc._zip64(struct.pack("<HHQQ", 1, 16, 7, 9), 5, 0xFFFFFFFF, 0xFFFFFFFF) == (5, 7, 9)
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(b"no zip"), 6)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * (0.12 if i % 3 else 0.2)).tolist(), i % 2) for i in range(150)]
    rows = [(i, e, 2**40 * label) for i, e, label in rows]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, rows[0][1], None), (206, [1.0], 0), (None, rows[0][1], 0)]
    found = {r.vec_id: r for r in embed.near_vectors(spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label long, tile int, LABEL string"), tile_bytes=256).collect()}
    v = {i: np.array(e, np.float32).astype(float) for i, e, label in rows if i is not None and label is not None and e and len(e) == 16 and np.isfinite(e).all() and any(e)}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a in v for b in v if a < b and label[a] == label[b] and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.98]
    want, count = reach([i for i, *_ in rows if i is not None], links), Counter(x for p in links for x in p)
    assert links and len(found) == len(rows)
    for i, r in found.items():
        assert r.n_links == count[i] and r.component_id == want.get(i) and r.kept == (i is None or want[i] == i), i
    assert embed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_many_labels(spark):
    # more labels, and so tiles, in each of the four range tasks than 4096; every third label holds a linked pair
    rows = [(2 * k + i, [1.0, 0.001 * i], k) for k in range(17_500) for i in range(2 if k % 3 == 0 else 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(i, int(k % 3 == 0), 2 * k) for i, _, k in rows}


@pytest.mark.parametrize("sub", [7, 1024])
def test_blocks(monkeypatch, sub):
    """Products in parts, of one tile and of two, against all cosines; without components an open pair stops the work."""
    monkeypatch.setattr(embed, "SUB", sub)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 32))
    x, y = (base[rng.integers(0, 6, n)] + rng.normal(size=(n, 32)) * 0.1 for n in (40, 25))
    weigh = lambda v: rng.integers(1, 4, len(v))
    tile = lambda v, w, full: (*embed.unit_codes(v), w, v if full else None)
    for a, b, same in ((x, y, False), (x, x, True)):
        wa = weigh(a)
        wb = wa if same else weigh(b)
        nodes = a if same else np.concatenate([a, b])
        unit = nodes / np.linalg.norm(nodes, axis=1)[:, None]
        near = unit @ unit.T >= 0.98
        if not same:
            near[: len(a), : len(a)] = near[len(a) :, len(a) :] = False
        np.fill_diagonal(near, False)
        count, root = embed.block_links(tile(a, wa, True), tile(b, wb, True), same, 0.98)
        want = reach(range(len(nodes)), list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
        assert near.any() and (count == near @ (wa if same else np.concatenate([wa, wb]))).all() and root.tolist() == [want[i] for i in range(len(nodes))]
        assert embed.block_links(tile(a, wa, False), tile(b, wb, False), same, 0.98) is None
        assert embed.block_links(tile(a, wa, False), tile(b, wb, False), same, -0.9999)[0].all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_quantised_bound(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, 8)) * 10.0 ** rng.integers(-3, 4, (20, 1))
    links, _ = embed.tile_links(x, x, 0.6)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert (links == (u @ u.T >= 0.6)).all()


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, (words(rng, 40) if i % 2 else "###!! " * 40), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t, _ in rows] + [(999, None, 0, "x"), (998, words(rng, 20_000), 1, "y")], "doc_id long, text string, words int, TEXT string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, None)], "doc_id long, quality int")
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    found = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert all(found[i].predicted == q and 0 <= found[i].score <= 1 for i, _, q in rows) and found[999].score is not None
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_rules_match_column(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    model = quality.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float))
    got = [r[0] for r in spark.createDataFrame(x.tolist(), list(quality.STATISTICS)).select(model.column()).collect()]
    z = model.intercept + sum(w * learners.apply_rule(rule, x) for rule, w in model.rules)
    assert np.allclose(got, learners.sigmoid(z))


def test_toxicity(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        w = words(rng, 30).split()
        if i % 3 == 0:
            for _ in range(4):
                w[rng.randrange(30)] = rng.choice(["horrid", "beastly"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    more = [(998, None), (999, "abcd horrrid bcda beastky"), (997, words(rng, 20_000)), (996, "")]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in [(i, t) for i, t, _ in rows] + more], "doc_id long, TEXT string, score double, label int")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert found[996].predicted == found[997].predicted == 0 and len(found) == 304 and toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert np.mean([found[i].predicted == x for i, _, x in rows]) > 0.97 and found[998].predicted == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] != a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_STATES", 300)
    rng = random.Random(12)
    entry = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    entries = {entry(rng.randint(3, 11)): float(k + 1) for k in range(15)}
    lexicon = toxicity.Lexicon(entries, {})
    for _ in range(3000):
        word = list(rng.choice([*entries, entry(rng.randint(3, 12))]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word[at : at + 2] = rng.choice([[], word[at : at + 2][::-1], [*word[at : at + 1], rng.choice("abcd")], word[at : at + 1] * 2])
            word = word or ["a"]
        word = "".join(word)
        near = [(n, -w, 0 if not n else 2 if n == 1 and len(x) >= 5 else 3) for x, w in entries.items() if (n := edits(x, word)) <= toxicity.word_edits(len(x))]
        want = (min(near)[2], -min(near)[1]) if near and len(word) >= 3 else None
        assert lexicon.look_up(word) == want, word


def test_lexicon():
    lexicon = toxicity.Lexicon({"stupid": 2.0, "moron": 1.0, "scum": 3.0, "abominable": 1.0}, {"vequ": 1.5, "detest": 2.5}, frozenset({"slum"}))
    for word in ("stupd", "stuppid", "st0pid", "stpuid", "moronn"):
        assert lexicon.look_up(word)[0] == 2, word
    for word in ("scvm", "scumm", "scm", "abominble", "abomniabel", "detesst", "ditesting"):
        assert lexicon.look_up(word)[0] == (2 if word == "abominble" else 3), word
    assert lexicon.look_up("Stupid!!")[0] == 0 and lexicon.look_up("vequtt")[0] == lexicon.look_up("detesting")[0] == 1
    assert all(lexicon.look_up(w) is None for w in ("slum", "stup", "st0pd", "vequ", "vaqutt", "dotxs", "ox"))
    assert toxicity.quoted('he said "you moron" today'.split(), 3) and not toxicity.quoted("you are a moron".split(), 3)


def test_clashing_columns(spark):
    """Columns in other cases and named like results; long texts; every row kept or dropped as by the plain names."""
    long = words(random.Random(3), 30_000)
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (2, "A b c d e f", 2, "y"), (None, None, 3, None), (3, long, 4, "z"), (4, long + " end", 5, "z")]
    docs = spark.createDataFrame(rows, "DOC_ID int, Text string, size int, digest string")
    assert exact.keep_distinct(docs).columns == docs.columns and exact.keep_distinct(docs).count() == 5
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.DOC_ID) for r in kept.collect()) == ["1", "1", "3", "None"]
    sharded = sharding.shard_documents(docs, shards=2)
    assert sharded.columns == ["DOC_ID", "Text", "digest", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = sharded.collect()
    assert sorted(r.size for r in got) == sorted(len(t or "") + 1 for _, t, *_ in rows) and all(r.text_crc32 == zlib.crc32((r.Text or "").encode()) and r.law == "bytes" for r in got)
    # equal texts are neighbours
    place = sorted((r.shard, r.slot, r.Text or "") for r in got)
    assert len([1 for x, y in zip(place, place[1:]) if x[2] != y[2]]) == len({t or "" for _, t, *_ in rows}) - 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    stock = {x: ["".join(rng.choice(x) for _ in range(5)) for _ in range(60)] for x in ("abcdefg", "stuvwxyz")}
    make = lambda letters, n=60: " ".join(rng.choice(stock[letters]) for _ in range(n))
    rows = [(i, make("abcdefg") if i % 2 else make("stuvwxyz"), "en" if i % 2 else "de", f"src{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[0][1], "de", "src0", 1), (101, "1 2 3", "en", "src0", 1), (102, rows[1][1] + " more", "en", "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = {r[0] for r in rows}
    assert kept[0] == every - {101} and kept[1] == kept[0] - {100} and kept[2] == kept[1] - {102} and kept[3] <= kept[2]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == kept[3]
