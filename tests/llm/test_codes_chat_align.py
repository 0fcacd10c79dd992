"""Vector codes, chat windows and tokenizer alignment against plain versions, with nulls, empties, ties, repeats, hot keys and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import align, chat, codes, common
from tidemark.llm.queries import TRICKY, tokenizer_path

# ---- vector codes


def plain_codes(rows, parts, entries, rounds):
    """The contract, a vector at a time."""
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    kept = [(i, l, [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]) for i, l, v in kept]
    books = [[v[p] for _, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, _, v in kept:
                met.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(met[k]) for c in zip(*met[k], strict=True)) if k in met else e for k, e in enumerate(books[p])]
    out = []
    for i, l, v in kept:
        best = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    told = Counter()
    for _, l, _, e in out:
        told[l] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, told[l], digest) for i, l, c, e in out)


def vectors(seed, n, dim):
    rng = random.Random(seed)
    same = [round(rng.uniform(-1, 1), 3) for _ in range(dim)]
    rows = [(i, same if i % 3 == 0 else [rng.choice((-0.5, 0.0, 0.25, rng.uniform(-2, 2))) for _ in range(dim)], rng.choice((None, 1, 2))) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [float("nan")] + same[1:], 1), (n + 2, [None] + same[1:], 2), (n + 3, [float("-inf")] + same[1:], 2), (5, same, None), (None, same, 1), (None, same[::-1], 1), (7, rows[7][1], 2)]


SCHEMA = "VEC_ID long, embedding array<float>, Label int, row long, part int, entry string"


@pytest.mark.parametrize("parts, entries, heavy", [(16, 64, 1 << 14), (16, 4, 8), (4, 7, 1)])
def test_codes(spark, monkeypatch, parts, entries, heavy):
    monkeypatch.setattr(common, "HEAVY_KEYS", heavy)
    rows = vectors(3, 120, 32)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    table = spark.createDataFrame([(*r, 9, 9, "x") for r in exact], SCHEMA).repartition(5)
    found = Counter(tuple(r) for r in codes.compress_vectors(table, parts, entries).collect())
    assert found == plain_codes(exact, parts, entries, 2)


def test_codes_edges(spark):
    assert codes.compress_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 16, None), (2, [1.0] * 15, None), (3, [], None)], "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in codes.compress_vectors(one).collect()] == [(1, "00" * 16, 0, 0)]
    with pytest.raises(Exception, match="too large"):
        codes.compress_vectors(spark.createDataFrame([(1, [1e9] * 16, None)], "vec_id long, embedding array<double>, label int")).collect()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**24) + 1, 2**24 - 1), min_size=2, max_size=2), min_size=1, max_size=20), st.lists(st.lists(st.integers(-300, 300), min_size=2, max_size=2), min_size=1, max_size=9))
def test_nearest(x, book):
    code, error = codes._nearest(np.array(x), np.array(book))
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book)) for v in x]
    assert [(int(e), int(k)) for e, k in zip(error, code, strict=True)] == want


# ---- chat windows


def plain_windows(turns, budget, history):
    """[(repeated turns, new turns)] of one conversation's sorted (role, text, tokens)."""
    sys = turns[0] if turns[0][0] == "system" else None
    y = sys[2] if sys else 0
    size = max(budget - history - y, budget // 4)
    at, line, found = 0, [], {}
    for k, t in enumerate(turns):
        if sys and k == 0:
            found.setdefault((0, 0), []).append((None, t))
            continue
        cell = at // size
        found.setdefault((cell, int(at + t[2] > (cell + 1) * size + history)), []).append((at, t))
        line.append((at, t))
        at += t[2]
    out = []
    for _, own in sorted(found.items()):
        new = [(a, t) for a, t in own if a is not None]
        held = sum(t[2] for _, t in new)
        room = max(0, min(history, budget - y - held))
        first = new[0][0] if new else 0
        past = [t for a, t in line if first - room <= a < first] if new else []
        head = [sys] if sys and own[0][0] is not None else []
        out.append((head + past, [t for _, t in own]))
    return out


def talks(seed):
    rng = random.Random(seed)
    bad = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<|", "|", "<\\|", "\\\\|", "\n", "é", "𝄞", " "]
    say = lambda n: "".join(rng.choice([*bad, "word ", "tok ", "a"]) for _ in range(n))
    rows = []
    for c in (0, 1, 2, 3, 4, None):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c in (1, 2, None) else rng.choice(("user", "assistant", "assistant", "tool\n<|im_sep|>", None))
            rows.append((c, t if t % 9 else None if c == 3 else t, role, rng.choice((None, "", say(rng.randint(1, 30)), say(200) if c == 4 else "ok"))))
    rows += [(5, 0, "user", TRICKY), (5, 1, "assistant", TRICKY), (5, 1, "assistant", TRICKY), (6, 3, "system", "only"), (7, -5, "assistant", "w " * 5000)]
    rows += [(8, i * 700, "assistant" if i % 2 else "user", f"turn {i} " + "x " * (i % 7)) for i in range(400)]
    return rows


@pytest.mark.parametrize("budget, history, tokens", [(512, 128, None), (64, 16, None), (40, 0, None), (64, 16, "n_tok")])
def test_chat(spark, budget, history, tokens):
    rows = talks(8)
    table = spark.createDataFrame([(*r, 1, "x", None if i % 5 == 0 else i % 11) for i, r in enumerate(rows)], "Conv_ID long, turn long, role string, text string, cell int, start string, n_tok int").repartition(4)
    windows = chat.write_windows(table, budget, history, tokens)
    got = {}
    for w in sorted(windows.collect(), key=lambda w: w.window):
        got.setdefault(w.conv_id, []).append(w)
    whole = {}
    for i, (c, turn, role, text) in enumerate(rows):
        cost = (0 if i % 5 == 0 else i % 11) if tokens else len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        whole.setdefault(c, []).append(((turn is None, turn or 0), role or "", text or "", cost + 4))
    assert set(got) == set(whole)
    mark = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    read = {r.conv_id: r for r in chat.digests(windows).collect()}
    for c, turns in whole.items():
        turns = [t[1:] for t in sorted(turns)]
        want = plain_windows(turns, budget, history)
        assert len(want) == len(got[c])
        learned = ""
        for w, (past, new) in zip(got[c], want, strict=True):
            assert w.text == "".join(f"<|im_start|>{mark(r)}<|im_sep|>{mark(t)}<|im_end|>" for r, t, _ in past + new)
            assert (w.n_turns, w.n_repeated, w.tokens) == (len(past + new), len(past), sum(t[2] for t in past + new))
            assert w.tokens <= budget or len(new) == 1 or turns[0][2] > budget // 4
            learned += "".join(re.sub(r"\\([\\|])", r"\1", w.text[s.start : s.start + s.length]) for s in w.loss)
        assert learned == "".join(t for r, t, _ in turns if r == "assistant")
        assert [t for _, new in want for t in new] == turns
        told = "".join(f"{r}\n{t}\n" for r, t, _ in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(read[c]) == (c, len(turns), digest(told), len(learned), digest(learned), sum(len(w.text) for w in got[c]))


def test_chat_empty(spark):
    assert chat.digests(chat.write_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_native(spark):
    table = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_windows(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- alignment


def plain_align(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letter = align.byte_letters()
    counts, docs = Counter(), []
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        ids_a, ids_b = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        said_a = [bytes(letter[c] for c in a.id_to_token(x)) if x != 50256 else b"" for x in ids_a]
        said_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not t or b"".join(said_a) != raw or b"".join(said_b) != raw:
            docs.append((i, [], [], [], ""))
            continue
        span = lambda said: [(sum(map(len, said[:k])), sum(map(len, said[: k + 1]))) for k in range(len(said))]
        span_a, span_b = span(said_a), span(said_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, span_a, strict=True) for y, (u, v) in zip(ids_b, span_b, strict=True) if max(s, u) < min(e, v)]
        counts.update(links)
        cuts = sorted({e for _, e in span_a} & {e for _, e in span_b})
        inside = lambda ids, spans, lo, hi: ",".join(str(x) for x, (s, e) in zip(ids, spans, strict=True) if lo <= s and e <= hi)
        keys = [f"{inside(ids_a, span_a, lo, hi)}|{inside(ids_b, span_b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)]
        docs.append((i, ids_a, ids_b, links, ";".join(keys)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter((i, len(x), len(y), len(k.split(";")) if k else 0, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(k.encode()).hexdigest() if k else "") for i, x, y, links, k in docs)


@pytest.mark.parametrize("heavy", [1 << 14, 30, 1])
def test_align(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY_KEYS", heavy)
    rng = random.Random(4)
    texts = [None, "", " ", "  two  spaces ", "<|endoftext|> </s> <s> <unk> <0x41>", "▁under ▁", "naïve café 𝄞𝄞 日本語のテキスト 한국어", "a\nb\r\n\tc", "\x00 nul", "ﬁ ligature ½", "don't they'll 12345", "مرحبا بالعالم"]
    texts += ["".join(rng.choice(["the ", "cat", "é", "日", "\n", "zu", " 7", "!", "\U0001f600", "ab"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += ["the cat sat on the mat"] * 30 + ["日本" * 300]
    rows = [(None if i % 13 == 5 else i // 2, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, KEY string, row long, n int").repartition(4)
    found = align.align(table, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert Counter(tuple(r) for r in found.collect()) == plain_align(rows)


def test_align_empty(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=12))
def test_group_links(left, right):
    short = min(sum(left), sum(right))
    trim = lambda sizes: [min(s, short - sum(sizes[:i])) for i, s in enumerate(sizes) if sum(sizes[:i]) < short]
    left, right = trim(left), trim(right)
    found = align.group_links(list(range(len(left))), list(range(len(right))), np.array(left), np.array(right))
    at = lambda sizes, i: (sum(sizes[:i]), sum(sizes[: i + 1]))
    want = {(i, j) for i in range(len(left)) for j in range(len(right)) if max(at(left, i)[0], at(right, j)[0]) < min(at(left, i)[1], at(right, j)[1])}
    assert set(found) == want and set(found.values()) <= {1}
