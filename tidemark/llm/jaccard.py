"""N-gram Jaccard self-join with a token-group matrix.

The matrix says which groups of documents hold which token (shingle hash).  A
set that overlaps no group enough cannot be similar to any of its members, so
only qualifying groups are opened and compared exactly:

1. Every distinct set is its own group.  Tokens are dealt by hash; each part of
   the token space reports how many tokens of a set occur in any *other* set.
   Fewer than 80 % of the set: it has no partner at all.
2. Surviving sets are put into groups by shared minimum hashes, cut at
   ``GROUP_ROWS`` sets; inside a group sets are compared exactly and linked.
   Three levels, each over the roots of the one before, gather similar sets into
   classes without comparing all pairs of a large class.
3. The matrix is counted again with classes as groups.  For what still overlaps
   other classes by 80 %, classes meet by representatives: under each of several
   minimum hashes one set of each class, compared in bounded blocks, which adds
   at most one link for each class and hash.  Then the matrix is counted once more.
4. What is left is put into bounded groups of sets that share a minimum hash, or
   a common token of their prefixes, with their token union; groups that share a prefix token in sets of different classes are
   paired, the overlap of each query set with the other group's union is bounded,
   and only qualifying sets open the group.  Groups are dealt to tiles; where
   many pairs lie between two tiles, the tiles are sent once for all of them.

Tokens are dealt over the parts of the token space in one step, or in two when
there are more than ``FAN`` parts: no block of tokens ever addresses more.

The counts are exact filters: a pair with ``100 * |x & y| >= 80 * |x | y|``
shares at least 80 % of either set and at least one prefix token of both.
Inside a class no further link is needed for the classes to be right.  Steps 2
and the representatives only spare work: step 4 finds every class link they miss.

Defined results: null or blank texts have an empty set and no link; rows with a
null id get a null class; rows that share an id are one node; equal sets are
linked; a text of any length is one set, its words are all used; an empty table
gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, discard, gathered, group_best, pick, released, released_group, settle, sized, small_side, text_bytes, union_all
from tidemark.llm.components import connected_components
from tidemark.llm.tokens import SHINGLE, mix, set_digest, shingle_set

#: Text bytes for each part of the token space (about four million tokens).
PART_BYTES = 24 << 20
#: Sets in a group, and tokens after which a group is closed (two sets always fit).
GROUP_ROWS, GROUP_TOKENS = 64, 400_000
#: Tokens gathered before they are dealt to the parts.
BLOCK_TOKENS = 2_000_000
#: Parts that one block of tokens is dealt to at most.
FAN = 1024
LEVELS = 3
#: Minimum hashes under which representatives meet, and how often they are drawn anew.
HASHES, TURNS = 8, 4
#: Groups of a tile, and bytes after which there are more tiles.
TILE_GROUPS, TILE_BYTES = 16, 1 << 20

_BLOB = "part int, keys binary, groups binary, counts binary, tokens binary, meta binary"
_SEEDS = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)]


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_BLOB_SCHEMA = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("groups", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("meta", pa.binary())])


def _deal(tokens: list[np.ndarray], counts: list[np.ndarray] | None, keys: list[np.ndarray] | list[int], groups: list | None, parts: int, fan: int, meta: bytes | None = None, turn: int = 0, onward: bool = False) -> Iterator[pa.RecordBatch]:
    """Sets' tokens by part of the token space: which set has how many there, and 32 more bits of each.

    With more than ``fan`` parts they are dealt to ranges of ``fan`` parts, as
    whole tokens, which are dealt ``onward`` to the parts."""
    rows, wide = [], not onward and parts > fan
    if tokens:
        token = np.concatenate(tokens)
        count = np.array([len(s) for s in tokens]) if counts is None else np.concatenate(counts)
        own = np.repeat(np.arange(len(count), dtype=np.int32), count)
        part = (token % np.uint64(parts)).astype(np.int64) // (fan if wide else 1)
        order = np.argsort(part, kind="stable")
        part, own, token = part[order], own[order], token[order]
        if not wide:
            token = (token >> np.uint64(32)).astype(np.uint32)
        flat = lambda v: np.array(v, np.int64) if counts is None else np.concatenate(v)
        key, group = flat(keys), None if groups is None else flat(groups)
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True):
            o = own[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            who = o[first]
            many = np.diff(np.append(first, hi - lo)).astype(np.uint32)
            rows.append((int(part[lo]), key[who].tobytes(), None if group is None else group[who].tobytes(), many.tobytes(), token[lo:hi].tobytes(), None))
    if meta:
        rows.append((turn % (-(-parts // fan) if wide else parts), None, None, None, None, meta))
    for at in range(0, len(rows), 64):
        yield _batch(_BLOB_SCHEMA, rows[at : at + 64])


def _deal_on(parts: int, fan: int):
    """Blobs of ranges of parts into blobs of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        flush = lambda part: _deal(held[part][0], held[part][1], held[part][2], held[part][3] or None, parts, fan, onward=True)
        for batch in batches:
            for part, key, group, count, token, meta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if meta is not None:
                    yield _batch(_BLOB_SCHEMA, [(part * fan, None, None, None, None, meta)])
                    continue
                own = held.setdefault(part, [[], [], [], [], 0])
                for at, raw, kind in ((0, token, np.uint64), (1, count, np.uint32), (2, key, np.int64), (3, group, np.int64)):
                    if raw is not None:
                        own[at].append(np.frombuffer(raw, kind))
                own[4] += len(token) // 8
                if own[4] >= BLOCK_TOKENS:
                    yield from flush(part)
                    del held[part]
        for part in list(held):
            yield from flush(part)
            del held[part]

    return run


def _dealt(rows: DataFrame, spread: Callable, parts: int):
    """Blobs of ``rows`` by part, grouped; ``spread(parts, fan)`` makes the first blobs."""
    fan = FAN
    blobs = rows.mapInArrow(released(spread(parts, fan)), _BLOB)
    if parts > fan:
        blobs = blobs.repartition(-(-parts // fan), "part").mapInArrow(released(_deal_on(parts, fan)), _BLOB)
    return blobs.groupBy("part")


def _spread_documents(parts: int, fan: int, k: int):
    """Blobs of all documents' tokens; meta carries (doc_id, n, 128-bit digest) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, sets, keys, metas, size = 0, [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingle_set((text.as_py() or "").encode(), k)
                digest = set_digest(tokens)
                d1 = int.from_bytes(digest[:8], "little", signed=True)
                metas.append((doc_id is None, doc_id or 0, len(tokens), d1, int.from_bytes(digest[8:], "little", signed=True)))
                if len(tokens) and doc_id is not None:
                    sets.append(tokens)
                    keys.append(d1)
                    size += len(tokens)
                if size >= BLOCK_TOKENS or len(metas) >= 20_000:
                    turn += 1
                    yield from _deal(sets, None, keys, None, parts, fan, np.array(metas, np.int64).tobytes(), turn)
                    sets, keys, metas, size = [], [], [], 0
        if metas:
            yield from _deal(sets, None, keys, None, parts, fan, np.array(metas, np.int64).tobytes(), turn)

    return run


def _spread_sets(parts: int, fan: int):
    """Blobs of (node, class, tokens) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, keys, groups, size = [], [], [], 0
        for batch in batches:
            for node, group, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                sets.append(np.frombuffer(raw.as_py(), np.uint64))
                keys.append(node.as_py())
                groups.append(group.as_py())
                size += len(sets[-1])
                if size >= BLOCK_TOKENS:
                    yield from _deal(sets, None, keys, groups, parts, fan)
                    sets, keys, groups, size = [], [], [], 0
        if sets:
            yield from _deal(sets, None, keys, groups, parts, fan)

    return run


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key and group of each token of a part in token order, and where the run of each token starts."""
    keys, groups, counts, tokens = [], [], [], []
    for name, out, kind in (("keys", keys, np.int64), ("groups", groups, np.int64), ("counts", counts, np.uint32), ("tokens", tokens, np.uint32)):
        for chunk in table.column(name).chunks:
            out.extend(np.frombuffer(x.as_buffer(), kind) for x in chunk if x.is_valid)
    if not tokens:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    key, count, token = np.concatenate(keys), np.concatenate(counts), np.concatenate(tokens)
    group = np.concatenate(groups) if groups else key
    order = np.argsort(token, kind="stable")
    token = token[order]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    own = np.repeat(np.arange(len(key), dtype=np.int32), count)[order]
    return key[own], group[own], start, token


_COUNT = "doc_id long, n long, d1 long, d2 long, shared long"
_COUNT_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "d1", "d2", "shared")])


def _count_shared(table: pa.Table) -> pa.Table:
    """For each key of a part: of its tokens there, how many lie in more than one group; and the part's meta rows."""
    metas = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 5) for c in table.column("meta").chunks for x in c if x.is_valid]
    meta = np.concatenate(metas) if metas else np.zeros((0, 5), np.int64)
    key, group, start, _ = _runs(table)
    if len(key):
        several = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
        hit = key[np.repeat(several, np.diff(np.append(start, len(key))))]
        who, shared = np.unique(hit, return_counts=True)
    else:
        who, shared = key, key
    pad = pa.nulls(len(who), pa.int64())
    plain = [pa.array(meta[:, i]) for i in range(5)]
    a = pa.Table.from_arrays([pa.array(meta[:, 1], mask=meta[:, 0] == 1), *plain[2:], pa.nulls(len(meta), pa.int64())], schema=_COUNT_SCHEMA)
    b = pa.Table.from_arrays([pad, pad, pa.array(who), pad, pa.array(shared.astype(np.int64))], schema=_COUNT_SCHEMA)
    return pa.concat_tables([a, b])


_SET = "node long, n long, tokens binary, k0 long, k1 long, k2 long"
_SET_SCHEMA = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("k0", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text, d1, d2 in zip(*(batch.column(i) for i in range(4)), strict=True):
                tokens = shingle_set((text.as_py() or "").encode(), k)
                if set_digest(tokens) == d1.as_py().to_bytes(8, "little", signed=True) + d2.as_py().to_bytes(8, "little", signed=True):
                    rows.append((node.as_py(), len(tokens), tokens.tobytes(), *(int(mix(tokens ^ s).min().astype(np.int64)) for s in _SEEDS)))
                if len(rows) >= 256:
                    yield _batch(_SET_SCHEMA, rows)
                    rows = []
            if rows:
                yield _batch(_SET_SCHEMA, rows)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded group, by products of token-membership blocks."""
    tokens = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, own = tokens[order], own[order]
    column = np.cumsum(np.concatenate(([0], tokens[1:] != tokens[:-1])))
    out = np.zeros((len(sets), len(sets)), np.int64)
    width, lo = 8192, 0
    while lo < len(tokens):
        hi = np.searchsorted(column, column[lo] + width)
        block = np.zeros((len(sets), width), np.float32)
        block[own[lo:hi], column[lo:hi] - column[lo]] = 1
        out += (block @ block.T).astype(np.int64)
        lo = hi
    return out


def local_roots(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a small symmetric link matrix."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, limit: int) -> Iterator[list[tuple]]:
    """Sorted (key, node, n, ...) rows into blocks of one key, of ``rows`` rows and about ``limit`` tokens at most."""
    block, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block and row[:2] == block[-1][:2]:
                continue  # a repeated row
            if block and (row[0] != block[0][0] or len(block) >= rows or size >= limit and len(block) > 1):
                yield block
                block, size = [], 0
            block.append(row)
            size += row[2]
    if block:
        yield block


def _roots(tokens: list[bytes], share: int) -> list[int]:
    """For each set of a block the first one that links reach."""
    if len(tokens) == 1:
        return [0]
    inter = overlaps([np.frombuffer(t, np.uint64) for t in tokens])
    n = np.diag(inter)
    return local_roots(100 * inter >= share * (n[:, None] + n[None, :] - inter)).tolist()


def _level(rows: int, limit: int, share: int):
    """Sorted (key, node, n, tokens, ...) rows: links the sets of each block to the block's roots; roots keep their tokens."""
    schema = pa.schema([*_SET_SCHEMA, ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, rows, limit):
            root = _roots([g[3] for g in block], share)
            yield _batch(schema, [(g[1], g[2], g[3] if root[i] == i else None, *g[4:], block[root[i]][1]) for i, g in enumerate(block)])

    return run


def _minima(hashes: int):
    """(node, key) of each (node, tokens) row and minimum hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [mix(np.array([7919 + j], np.uint64)) for j in range(hashes)]
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                key = np.array([mix(mix(tokens ^ s).min() + s)[0] for s in seeds]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node] * hashes, pa.int64()), pa.array(key)], ["node", "key"])

    return run


def _meet(rows: int, limit: int, share: int):
    """Sorted (key, class, n, tokens) rows, one set a class: links between classes, at most one for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, rows, limit):
            found = [(g[1], block[r][1]) for g, r in zip(block, _roots([g[3] for g in block], share), strict=True) if g[1] != block[r][1]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def meet_classes(sets: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """``members(node, class)`` with classes merged where representatives link.

    ``sets`` is (node, n, tokens).  Under each minimum hash a class sends one of
    its sets, in every turn another; turns end when one merges less than a
    hundredth of the classes: what is left is cheaper to find by prefixes."""
    minima = gathered(settle(sets.select("node", "tokens").mapInArrow(released(_minima(HASHES)), "node long, key long"), "minima"))
    most = members.count()
    for turn in range(TURNS):
        keyed = minima.join(gathered(members), "node").groupBy("key", "class").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
        met = group_best(keyed.withColumn("order", F.col("class")), "key", "order", "class").filter("group_size > 1").select("key", "class", "node")
        sent = met.join(sets, "node").select("key", "class", "n", "tokens").repartitionByRange("key", "class").sortWithinPartitions("key", "class")
        links = settle(sent.mapInArrow(released(_meet(GROUP_ROWS, GROUP_TOKENS, share)), "a long, b long"), "meet", free=True)
        merged = connected_components(links)
        gone = merged.filter("node <> component").count()
        if not gone:
            break
        named = members.join(merged.withColumnRenamed("node", "class"), "class", "left")
        members = settle(named.select("node", F.coalesce("component", "class").alias("class")), "members")
        if 100 * gone < most:
            break
    return members


def _rarity(table: pa.Table) -> pa.Table:
    """For each key of a part, in the order of its tokens there: in how many classes each token lies."""
    keys, groups, counts, tokens = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in table.column(name).chunks for x in c]) for name, kind in (("keys", np.int64), ("groups", np.int64), ("counts", np.uint32), ("tokens", np.uint32)))
    group = np.repeat(groups, counts)
    order = np.lexsort((group, tokens))
    token, group = tokens[order], group[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    start = np.flatnonzero(new)
    several = np.add.reduceat(new | np.concatenate(([True], group[1:] != group[:-1])), start)
    rarity = np.empty(len(tokens), np.uint32)
    rarity[order] = np.repeat(several, np.diff(np.append(start, len(tokens))))
    at = np.concatenate(([0], np.cumsum(counts.astype(np.int64)))).astype(np.int64)
    raw = [rarity[at[i] : at[i + 1]].tobytes() for i in range(len(keys))]
    return pa.table({"node": keys, "part": pa.array([table.column("part")[0].as_py()] * len(keys), pa.int32()), "rarity": pa.array(raw, pa.binary())})


_RANKED = "key long, node long, n long, class long, tokens binary, head binary"


def _heads(parts: int, share: int):
    """The prefix of each set, rarest tokens first, without those of no other class: a pair that links shares a token of both prefixes.

    The key is the set's minimum hash, or the prefix's most frequent token where
    more than ``GROUP_ROWS`` classes have it: sets of common passages meet under
    the few tokens that end their prefixes, so their groups are full."""
    schema = pa.schema([*[(c, pa.int64()) for c in ("key", "node", "n", "class")], ("tokens", pa.binary()), ("head", pa.binary())])

    def head(k0: int, raw: bytes, rarity: list[dict]) -> tuple[int, bytes]:
        tokens = np.frombuffer(raw, np.uint64)
        dealt = np.argsort((tokens % np.uint64(parts)).astype(np.int32), kind="stable")
        rare = np.empty(len(tokens), np.uint32)
        rare[dealt] = np.frombuffer(b"".join(r["rarity"] for r in rarity), np.uint32)
        first = np.lexsort((tokens, rare))[: len(tokens) - -(-share * len(tokens) // 100) + 1]
        first = first[rare[first] > 1]
        common = len(first) > 0 and rare[first[-1]] > GROUP_ROWS
        return int(tokens[first[-1]].astype(np.int64)) if common else k0, tokens[first].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)
                made = [(row, head(row[0], row[4], row[5])) for row in rows]
                yield _batch(schema, [(key, *row[1:5], front) for row, (key, front) in made if front])

    return run


_GROUP = "gid long, classes binary, nodes binary, sizes binary, tokens binary, cuts binary, heads binary, union binary"
_GROUP_SCHEMA = pa.schema([("gid", pa.int64()), *[(c, pa.binary()) for c in ("classes", "nodes", "sizes", "tokens", "cuts", "heads", "union")]])


def _gather(rows: int, limit: int):
    """Sorted (key, node, n, class, tokens, head) rows into bounded groups of sets that share a minimum hash or a prefix token, with their token union."""

    def close(group: list[tuple]) -> tuple:
        packed = [np.array([g[i] for g in group], np.int64).tobytes() for i in (3, 1, 2)]
        tokens = b"".join(g[4] for g in group)
        cuts = np.array([len(g[5]) // 8 for g in group], np.int64).tobytes()
        return (group[0][1], *packed, tokens, cuts, b"".join(g[5] for g in group), np.unique(np.frombuffer(tokens, np.uint64)).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, rows, limit):
            yield _batch(_GROUP_SCHEMA, [close(block)])

    return run


def _members(sizes: bytes, tokens: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(tokens, np.uint64), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])


def _spread_prefixes(parts: int, fan: int):
    """Blobs of the prefix tokens of each group's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, keys, groups, size = [], [], [], 0
        for batch in batches:
            for gid, classes, cuts, heads in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for head, own in zip(_members(cuts, heads), np.frombuffer(classes, np.int64).tolist(), strict=True):
                    if len(head):
                        sets.append(head)
                        keys.append(gid)
                        groups.append(own)
                        size += len(head)
                if size >= BLOCK_TOKENS:
                    yield from _deal(sets, None, keys, groups, parts, fan)
                    sets, keys, groups, size = [], [], [], 0
        if sets:
            yield from _deal(sets, None, keys, groups, parts, fan)

    return run


def _pair_groups(table: pa.Table) -> pa.Table:
    """Pairs of groups (a group with itself as well) that share a prefix token of this part in sets of different classes."""
    key, group, start, _ = _runs(table)
    found: set[tuple[int, int]] = set()
    if len(key):
        end = np.append(start[1:], len(key))
        several = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
        for lo, hi in zip(start[several].tolist(), end[several].tolist(), strict=True):
            ids = sorted(set(key[lo:hi].tolist()))
            found.update((a, b) for i, a in enumerate(ids) for b in ids[i:])
    pairs = sorted(found)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def link_groups(query: tuple, group: tuple, union: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links between sets of two groups (nodes, classes, token sets), one at most for each pair of classes that is joined.

    Each query set is bounded by its overlap with the group's token union, which
    is sorted; only qualifying sets open the group.  No set is empty."""
    size = np.array([len(q) for q in query[2]])
    tokens = np.concatenate(query[2])
    known = union[np.minimum(np.searchsorted(union, tokens), len(union) - 1)] == tokens
    open_ = np.flatnonzero(100 * np.add.reduceat(known.astype(np.int64), np.cumsum(size) - size) >= share * size).tolist()
    if not open_:
        return []
    inter = overlaps([query[2][i] for i in open_] + group[2])[: len(open_), len(open_) :]
    nq, ng = np.array([len(query[2][i]) for i in open_]), np.array([len(g) for g in group[2]])
    near = 100 * inter >= share * (nq[:, None] + ng[None, :] - inter)
    joined: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = int(query[1][open_[i]]), int(group[1][j])
        if x != y:
            joined.setdefault((min(x, y), max(x, y)), (int(query[0][open_[i]]), int(group[0][j])))
    return list(joined.values())


def _open_groups(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = ((np.frombuffer(row[i], np.int64), np.frombuffer(row[i + 1], np.int64), _members(row[i + 2], row[i + 3])) for i in (0, 4))
                found += link_groups(a, b, np.frombuffer(row[8], np.uint64), share)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _open_tiles(share: int):
    """Rows of two tiles and the pairs of their groups: links between sets of paired groups."""

    def opened(tile) -> dict[int, tuple]:
        return {g["gid"]: ((np.frombuffer(g["nodes"], np.int64), np.frombuffer(g["classes"], np.int64), _members(g["sizes"], g["tokens"])), np.frombuffer(g["union"], np.uint64)) for g in tile.as_py()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, first, second in zip(*batch.columns, strict=True):
                left, right = opened(first), opened(second)
                both = {**left, **right}
                found = [link for p in pairs.as_py() for link in link_groups(both[p["a"]][0], *both[p["b"]], share)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _open_own(share: int):
    """Groups: links between their own sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, classes, sizes, tokens, union in zip(*batch.columns, strict=True):
                own = (np.frombuffer(nodes.as_buffer(), np.int64), np.frombuffer(classes.as_buffer(), np.int64), _members(sizes.as_buffer(), tokens.as_buffer()))
                found = link_groups(own, own, np.frombuffer(union.as_buffer(), np.uint64), share) if len(set(own[1].tolist())) > 1 else []
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _placed(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the tiles (x, y) of their groups.

    Groups that are in about as many pairs share tiles, so pairs among groups that
    all meet lie between few tiles.  Tiles are numbered by band and hash, and the
    bands are powers of two: their table has at most 64 rows."""
    degree = pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid"))).groupBy("gid").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("band"))
    banded = settle(groups.select("gid", F.octet_length("tokens").alias("size")).join(degree, "gid"), "bands")
    tiles = {band: max(sized(n, TILE_GROUPS), sized(size, TILE_BYTES)) for band, n, size in banded.groupBy("band").agg(F.count(F.lit(1)), F.sum("size")).collect()}
    within = F.coalesce(*[F.when(F.col("band") == band, F.pmod(F.xxhash64("gid"), F.lit(n))) for band, n in tiles.items()], F.lit(0))
    tile = banded.select("gid", (F.col("band") * F.lit(1 << 40) + within).alias("tile"))
    found = pairs.join(tile.select(F.col("gid").alias("a"), F.col("tile").alias("ta")), "a").join(tile.select(F.col("gid").alias("b"), F.col("tile").alias("tb")), "b")
    return found.select("a", "b", F.least("ta", "tb").alias("x"), F.greatest("ta", "tb").alias("y"), "ta", "tb")


def cross_groups(groups: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between sets of the paired groups of ``pairs(a, b)``, and between sets of one group.

    Two tiles with many pairs between them are sent once for all these pairs; the
    groups of other pairs are sent pair by pair."""
    columns = ("nodes", "classes", "sizes", "tokens")
    links = "a long, b long"
    by_own = groups.select(*columns, "union").mapInArrow(released(_open_own(share)), links)
    placed = _placed(groups, settle(pairs.filter("a <> b"), "cross", free=True))
    met = settle(placed.groupBy("x", "y").agg(F.collect_list(F.struct("a", "b", "ta", "tb")).alias("pairs")), "pairs", free=True)
    dense = F.size("pairs") >= TILE_GROUPS
    ends = met.filter(dense).select(F.explode("pairs").alias("p")).select(F.explode(F.array(F.struct(F.col("p.a").alias("gid"), F.col("p.ta").alias("tile")), F.struct(F.col("p.b").alias("gid"), F.col("p.tb").alias("tile")))).alias("e")).select("e.*").distinct()
    whole = settle(groups.select("gid", *columns, "union").join(ends, "gid").groupBy("tile").agg(F.collect_list(F.struct("gid", *columns, "union")).alias("groups")), "tiles", free=True)
    tiled = met.filter(dense).join(whole.select(F.col("tile").alias("x"), F.col("groups").alias("left")), "x").join(whole.select(F.col("tile").alias("y"), F.col("groups").alias("right")), "y")
    by_tile = tiled.select("pairs", "left", "right").mapInArrow(released(_open_tiles(share)), links)
    side = lambda n, *more: groups.select(F.col("gid").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in (*columns, *more)])
    single = met.filter(~dense).select(F.explode("pairs").alias("p")).select("p.a", "p.b")
    opened = single.join(side("a"), "a").join(side("b", "union"), "b").select(*[f"{n}_{c}" for n in "ab" for c in columns], "b_union")
    return union_all([by_own, by_tile, opened.mapInArrow(released(_open_groups(share)), links)])


def _crossing(sets: DataFrame, parts: int, share: int) -> DataFrame:
    """The rows of ``sets(node, class, n, tokens, k0)`` of whose tokens enough lie in other classes' sets; only they can link to one."""
    counts = _dealt(sets.select("node", "class", "tokens"), _spread_sets, parts).applyInArrow(released_group(_count_shared), _COUNT)
    most = counts.groupBy(F.col("d1").alias("node")).agg(F.sum("shared").alias("shared"))
    near = settle(sets.select("node", "n").distinct().join(most, "node").filter(f"100 * shared >= {share} * n").select("node"), "near", free=True)
    return sets.join(small_side(near), "node")


def jaccard_classes(docs: DataFrame, share: int = 80, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Sets are distinct ``k``-word shingles; two rows link when ``100 *
    |x & y| >= share * |x | y|``; ``component_id`` is the smallest id reachable."""
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = sized(text_bytes(plain), PART_BYTES, least=32)
    blobs = _dealt(plain, lambda parts, fan: _spread_documents(parts, fan, k), parts)
    counted = settle(blobs.applyInArrow(released_group(_count_shared), _COUNT), "overlap", free=True)

    rows = counted.filter("shared is null").select("doc_id", "n", "d1", "d2")
    bound = counted.groupBy("d1").agg(F.sum("shared").alias("shared"), F.sum(F.when(F.col("shared").isNull() & F.col("doc_id").isNotNull(), F.col("n"))).alias("n"))
    alive = bound.filter(f"100 * shared >= {share} * n").select("d1")

    named = rows.filter("n > 0 and doc_id is not null").withColumn("digest", F.struct("d1", "d2")).withColumn("order", F.col("doc_id"))
    copies = settle(group_best(named.select("doc_id", "digest", "order"), "digest", "order", "doc_id").select("doc_id", "digest", "best"), "copies")
    firsts = settle(copies.filter("doc_id = best").select("doc_id", F.col("digest.d1").alias("d1"), F.col("digest.d2").alias("d2")).distinct().join(alive, "d1", "left_semi"), "firsts")
    sets = settle(plain.join(small_side(firsts), "doc_id").select("doc_id", "text", "d1", "d2").mapInArrow(released(_sets(k)), _SET), "sets", free=True)

    links, level = [], sets
    for j in range(LEVELS):
        key = f"k{j}"
        dealt = level.select(F.col(key).alias("key"), "node", "n", "tokens", "k0", "k1", "k2").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
        done = settle(dealt.mapInArrow(released(_level(GROUP_ROWS, GROUP_TOKENS, share)), _SET + ", root long"), f"level{j}", free=True)
        links.append(done.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        level = done.filter("node = root").drop("root")

    classes = settle(connected_components(union_all(links)), "classes")
    classed = sets.join(small_side(classes), "node", "left").select("node", F.coalesce("component", "node").alias("class"), "n", "tokens", "k0")
    first = settle(_crossing(classed, parts, share).dropDuplicates(["node"]), "crossing", free=True)
    members = meet_classes(first.select("node", "n", "tokens"), settle(first.select("node", "class"), "members"), share)
    left = settle(_crossing(first.drop("class").join(members, "node").select("node", "class", "n", "tokens", "k0"), parts, share), "left", free=True)
    rare = _dealt(left.select("node", "class", "tokens"), _spread_sets, parts).applyInArrow(released_group(_rarity), "node long, part int, rarity binary")
    each = rare.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("part", "rarity"))).alias("rarity"))
    ranked = left.join(each, "node").select("k0", "node", "n", "class", "tokens", "rarity").mapInArrow(released(_heads(parts, share)), _RANKED)
    groups = settle(ranked.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(released(_gather(GROUP_ROWS, GROUP_TOKENS)), _GROUP), "groups", free=True)
    pairs = _dealt(groups.select("gid", "classes", "cuts", "heads"), _spread_prefixes, parts).applyInArrow(released_group(_pair_groups), "a long, b long").distinct()
    crossed = settle(cross_groups(groups, pairs, share), "crossed", free=True)

    same = copies.filter("doc_id <> best").select(F.col("doc_id").alias("a"), F.col("best").alias("b"))
    merged = classes.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    met = members.filter("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b"))
    final = connected_components(union_all([merged, met, crossed, same]))
    discard(sets, first, left, groups)
    return rows.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, share: int = 80, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; all its columns.
    Rows with a null id and rows without a partner stay."""
    classes = jaccard_classes(docs, share, k)
    gone = classes.filter("component_id <> doc_id").select("doc_id").distinct()
    names = [f"__c{i}" for i in range(len(docs.columns))]
    (own,) = columns_of(docs.columns, "doc_id")
    return docs.toDF(*names).join(gone, own.cast("long") == F.col("doc_id"), "left_anti").toDF(*docs.columns)
