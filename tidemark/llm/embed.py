"""Near-duplicate vectors by int8 tile products with error bounds.

Unit vectors are rounded to int8 codes with one scale each; what rounding took
away has a known length.  For two vectors ``u = s q + e`` the product differs
from ``s_u s_v q_u.q_v`` by at most ``|e_u| |s_v q_v| + |s_u q_u| |e_v| + |e_u|
|e_v|``, so a tile product of codes proves most pairs below or above the
threshold and only the rest is recomputed from the stored components in double
precision.  Code products are summed exactly (slices of 1024 dimensions in
single precision hold integers below 2**24).

Equal vectors of a label are one node with a weight.  The nodes of a label lie
in tiles of ``TILE_BYTES`` of codes along a fixed direction; tile pairs whose
projections are too far apart to reach the threshold are never formed.  Codes,
scales and error bounds are computed once and are all that a tile pair reads;
only pairs of tiles that hold an undecided pair of vectors are sent again with
their stored components.  A tile pair gives link counts and a spanning set of
links for each of its vectors, never its pairs.

A tile pair costs the product of its sizes and tiles are sent once for each
partner, so work in one label grows with its square (shuffle with its square
over the tile size): one direction prunes little when vectors spread evenly.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or whose label is null, link with nothing; so do vectors of other
lengths; labels are compared as text; a cosine of exactly the threshold links;
rows with a null id get a null component; rows that repeat an id are compared
each and are one node of the components; an empty table gives an empty table;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import group_best, pick, settle, union_all
from tidemark.llm.components import connected_components

#: Bytes of int8 codes in a tile (16,384 vectors of 64 dimensions), and vectors of either side that are multiplied at a time.
TILE_BYTES, SUB = 1 << 20, 1024
#: Products of components for each task that compares tiles, and such tasks at most.
TASK_PRODUCTS, PAIR_TASKS = 1 << 30, 100_000
#: Pairs recomputed in double precision at a time.
EXACT_PAIRS = 65_536


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of what rounding took away."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(unit - scale[:, None] * codes, axis=1)
    return codes, scale, rest * (1 + 1e-9) + 1e-15


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes, as doubles."""
    out = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], 1024):
        out += a[:, lo : lo + 1024].astype(np.float32) @ b[:, lo : lo + 1024].astype(np.float32).T
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def code_links(x: Codes, y: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Boolean matrices of the pairs that their codes prove to link, and of those that they leave open."""
    (qx, sx, ex), (qy, sy, ey) = x, y
    near = code_products(qx, qy) * sx[:, None] * sy[None, :]
    lx, ly = 1 + ex, 1 + ey  # the coded part of a unit vector is no longer than that
    slack = ex[:, None] * ly[None, :] + lx[:, None] * ey[None, :] + ex[:, None] * ey[None, :] + 1e-9
    links = near - slack >= threshold
    return links, (near + slack >= threshold) & ~links


def settle_open(links: np.ndarray, open_: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> int:
    """Adds the open pairs that link in double precision; their number."""
    i, j = np.nonzero(open_)
    for lo in range(0, len(i), EXACT_PAIRS):
        a, b = i[lo : lo + EXACT_PAIRS], j[lo : lo + EXACT_PAIRS]
        links[a, b] = cosines(x[a], y[b]) >= threshold
    return len(i)


def unit_codes(x: np.ndarray) -> Codes:
    return quantise(x / np.linalg.norm(x, axis=1)[:, None])


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Boolean matrix of the pairs with cosine >= threshold, and how many pairs were recomputed."""
    links, open_ = code_links(unit_codes(x), unit_codes(y), threshold)
    return links, settle_open(links, open_, x, y, threshold)


def spanning(links: np.ndarray) -> np.ndarray:
    """Label of each row and column node (rows first) of a bipartite link matrix: the smallest node index reachable."""
    n, m = links.shape
    label = np.arange(n + m)
    while True:
        row, col = label[:n], label[n:]
        low_row = np.where(links, col[None, :], n + m).min(1, initial=n + m)
        low_col = np.where(links, row[:, None], n + m).min(0, initial=n + m)
        new = np.minimum(label, np.concatenate([low_row, low_col]))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest_roots(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the edges."""
    a, b = (np.concatenate([e[i] for e in edges] or [np.zeros(0, np.int64)]) for i in (0, 1))
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(x: tuple, y: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Link weight and smallest reachable index of each vector of two tiles (x first, y after it unless it is the same tile).

    A tile is (codes, scales, errors, weights, components or None); without the
    components the result is None as soon as a pair is open."""
    n, m = len(x[1]), len(y[1])
    count, edges = np.zeros(n if same else n + m, np.int64), []
    shift = 0 if same else n
    for i in range(0, n, SUB):
        for j in range(i if same else 0, m, SUB):
            u, v = ([None if c is None else c[k : k + SUB] for c in t] for t, k in ((x, i), (y, j)))
            links, open_ = code_links(tuple(u[:3]), tuple(v[:3]), threshold)
            if open_.any():
                if u[4] is None:
                    return None
                settle_open(links, open_, u[4], v[4], threshold)
            twin = same and i == j
            if twin:
                np.fill_diagonal(links, False)
            count[i : i + len(u[1])] += links @ v[3]
            if not twin:
                count[shift + j : shift + j + len(v[1])] += links.T @ u[3]
            if links.any():
                label = spanning(links)
                place = np.concatenate([np.arange(len(u[1])) + i, np.arange(len(v[1])) + shift + j])
                moved = label != np.arange(len(label))
                edges.append((place[moved], place[label[moved]]))
    return count, forest_roots(len(count), edges)


_TILE = "label string, dim int, tile long, rows int, low double, high double, ids binary, weights binary, codes binary, scales binary, errors binary, vectors binary"
_TILE_SCHEMA = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("tile", pa.int64()), ("rows", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), *[(c, pa.binary()) for c in ("ids", "weights", "codes", "scales", "errors", "vectors")]])


def _tiles(tile_bytes: int):
    """Sorted (label, dim, place, node, weight, vector) rows into tiles, numbered as ``monotonically_increasing_id`` numbers rows."""

    def close(group: list[tuple], turn: int) -> tuple:
        vectors = np.stack([g[5] for g in group])
        codes, scale, error = unit_codes(vectors)
        pack = lambda i: np.array([g[i] for g in group], np.int64).tobytes()
        return (group[0][0], group[0][1], turn, len(group), group[0][2], group[-1][2], pack(3), pack(4), codes.tobytes(), scale.tobytes(), error.tobytes(), vectors.tobytes())

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(_TILE_SCHEMA)], schema=_TILE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group, turn, done, size = [], TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            vector = batch.column(5)
            flat, at = vector.flatten().to_numpy(zero_copy_only=False), vector.offsets.to_numpy() - vector.offsets[0].as_py()
            for k, row in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
                if group and (row[:2] != group[0][:2] or len(group) >= max(2, tile_bytes // row[1])):
                    done.append(close(group, turn))
                    size += len(done[-1][-1])
                    group, turn = [], turn + 1
                    if size >= 8 * TILE_BYTES or len(done) >= 4096:
                        yield batch_of(done)
                        done, size = [], 0
                group.append((*row, flat[at[k] : at[k + 1]]))
        if group:
            done.append(close(group, turn))
        if done:
            yield batch_of(done)

    return run


_PAIR = ("label", "dim", "tile_a", "tile_b")
_SIDE = ("ids", "weights", "codes", "scales", "errors")
_FOUND = "label string, dim int, tile_a long, tile_b long, node long, links long, root long"
_FOUND_SCHEMA = pa.schema([("label", pa.string()), ("dim", pa.int32()), *[(c, pa.int64()) for c in ("tile_a", "tile_b", "node", "links", "root")]])


def _compare(threshold: float, exact: bool):
    """For each tile pair: links of each vector, and the smallest node of its part of the link graph; one row without a node where pairs are open."""

    def side(dim: int, ids: bytes, weights: bytes, codes: bytes, scales: bytes, errors: bytes, vectors: bytes | None = None) -> tuple:
        full = None if vectors is None else np.frombuffer(vectors, np.float64).reshape(-1, dim)
        tile = np.frombuffer(codes, np.int8).reshape(-1, dim), np.frombuffer(scales, np.float64), np.frombuffer(errors, np.float64), np.frombuffer(weights, np.int64), full
        return np.frombuffer(ids, np.int64), tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(_SIDE) + exact
        for batch in batches:
            found: list[tuple] = []
            for k in range(batch.num_rows):
                label, dim, tile_a, tile_b, *raw = (c[k].as_py() for c in batch.columns)
                same = tile_a == tile_b
                (ids, x), (others, y) = side(dim, *raw[:width]), side(dim, *raw[width:])
                done = block_links(x, y, same, threshold)
                if done is None:
                    found.append((label, dim, tile_a, tile_b, None, None, None))
                    continue
                count, part = done
                every = ids if same else np.concatenate([ids, others])
                # indices follow the tiles, ids need not: the root is the smallest id of the part
                low = np.full(len(every), np.iinfo(np.int64).max)
                np.minimum.at(low, part, every)
                keep = (count > 0) | (low[part] != every)
                found += [(label, dim, tile_a, tile_b, *r) for r in zip(every[keep].tolist(), count[keep].tolist(), low[part][keep].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(_FOUND_SCHEMA)], schema=_FOUND_SCHEMA)

    return run


def _compared(pairs: DataFrame, tiles: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """``_compare`` over settled tile pairs (label, dim, tile_a, tile_b, products)."""
    columns = (*_SIDE, "vectors") if exact else _SIDE
    n, products = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("products"), F.lit(0))).first()
    side = lambda n: tiles.select("label", "dim", F.col("tile").alias(f"tile_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in columns])
    full = pairs.join(side("a"), ["label", "dim", "tile_a"]).join(side("b"), ["label", "dim", "tile_b"])
    work = full.select(*_PAIR, *[f"{c}_{n}" for n in "ab" for c in columns])
    tasks = max(1, min(n, PAIR_TASKS, int(products) // TASK_PRODUCTS + 1))
    return settle(work.repartition(tasks).mapInArrow(_compare(threshold, exact), _FOUND), "found")


def near_vectors(embeddings: DataFrame, threshold: float = 0.98, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings(vec_id, embedding, label)``."""
    plain = pick(embeddings, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    rows = settle(plain.withColumn("row", F.monotonically_increasing_id()), "vectors")
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    # equal vectors are one node: the digest of the components' text names them (0.0 and -0.0 as one)
    digest = F.sha2(F.concat_ws(",", F.length("label"), "label", F.transform(v, lambda x: (x + 0.0).cast("string"))), 256)
    named = group_best(sound.select("vec_id", "row", digest.alias("digest"), F.struct("vec_id", "row").alias("order")), "digest", "order", "row")
    copies = settle(named.select("vec_id", "row", F.col("best.vec_id").alias("node"), F.col("best.row").alias("node_row"), "group_size"), "copies")
    firsts = copies.filter("row = node_row").select("row", F.col("group_size").alias("weight"))

    # a fixed direction: nearby unit vectors have nearby projections
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    along = F.aggregate(F.transform(v, lambda x, i: x * (F.pmod(i * 7919 + 3, F.lit(2)) * 2 - 1)), F.lit(0.0), lambda a, x: a + x)
    place = along / (norm * F.sqrt(F.size(v).cast("double")))
    nodes = rows.join(firsts, "row").select("label", F.size(v).alias("dim"), place.alias("place"), F.col("row").alias("node"), "weight", F.col("embedding").alias("vector"))
    order = ["label", "dim", "place", "node"]
    tiles = settle(nodes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tiles(tile_bytes), _TILE), "tiles")

    # |u - v| <= sqrt(2 - 2 threshold) bounds how far apart the projections of a link lie
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    a, b = (tiles.select("label", "dim", *[F.col(c).alias(f"{c}_{n}") for c in ("tile", "rows", "low", "high")]) for n in "ab")
    pairs = a.join(b, ["label", "dim"]).filter(f"tile_a <= tile_b and low_b - high_a <= {reach!r} and low_a - high_b <= {reach!r}")
    pairs = settle(pairs.select(*_PAIR, (F.col("rows_a").cast("double") * F.col("rows_b") * F.col("dim")).alias("products")), "pairs")
    coded = _compared(pairs, tiles, threshold, exact=False)
    again = _compared(settle(pairs.join(coded.filter("node is null").select(*_PAIR), list(_PAIR)), "open"), tiles, threshold, exact=True)
    found = coded.filter("node is not null").unionByName(again).select("node", "links", "root")

    ids = copies.filter("row = node_row").select(F.col("row").alias("node_row"), F.col("node").alias("id"))
    ends = found.filter("node <> root").select("node", "root").distinct()
    named_a = ends.join(ids.select(F.col("node_row").alias("node"), F.col("id").alias("a")), "node")
    edges = named_a.join(ids.select(F.col("node_row").alias("root"), F.col("id").alias("b")), "root").select("a", "b")
    same = copies.filter("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    classes = connected_components(union_all([edges, same]))
    counts = found.groupBy(F.col("node").alias("node_row")).agg(F.sum("links").alias("links"))
    # back to the copies: by (digest group, salt), so that no hot vector meets in one task
    linked = _spread(copies, counts)
    done = linked.select("row", (F.col("group_size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("row", "vec_id").join(done, "row", "left").join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _spread(copies: DataFrame, counts: DataFrame) -> DataFrame:
    from tidemark.llm.common import SALTS

    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    keys = copies.select("node_row", salt).distinct().join(counts, "node_row")
    return copies.withColumn("salt", salt).join(keys, ["node_row", "salt"], "left")
