"""Clusters of similar vectors, such as those of error messages: random-hyperplane buckets, verified cosines, connected components.

Two vectors at an angle a fall on the same side of a random hyperplane with a probability of 1 - a / pi. A vector's bucket in a table is the signs
of its BITS hyperplanes, and TABLES tables make it likely that a similar pair meets at least once; `miss` tells how unlikely the rest is.
Where buckets would compare more pairs than there are, all rows are one bucket, and no pair is missed. Buckets are compared in tiles of bounded
size, so one bucket may hold any share of the rows, and a tile returns stars, not pairs. Single-precision products decide, and pairs close to
the wanted cosine are settled in double precision.

Clusters need no list of pairs. Where one bucket would hold all rows, rows near the same of PIVOTS drawn rows make parts; groups are found within
parts and through the pivots first, and then only rows outside the largest group look for partners in other parts, among the cells of
pivots that the triangle inequality leaves. So no pair is missed there either, but pairs inside the largest group aren't compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.lineage import cut
from ontoloom.operators.components import components
from ontoloom.operators.ivf import usable

BITS, TABLES = 12, 24
#: Most rows of a bucket on one side of a tile; up to SPREAD parts are made of a quarter of that, so that small tables have tiles for all cores.
TILE, SPREAD = 65_536, 8
#: Products that a tile holds at once, close pairs that it settles at once, and bytes of vectors that are dealt at once.
BLOCK, CLOSE, SLICE = 1 << 22, 1 << 16, 1 << 24
#: Most pivots, and rows for each; least parts of a large table; tasks at most; rows that look for partners at once; cells of a pivot; what angles of single-precision products may be off by.
PIVOTS, OWN, LEAST_PARTS, MOST_TASKS, TOGETHER, SHELLS, SLACK = 4_096, 64, 64, 400, 512, 8, 0.004


def miss(cosine: float, bits: int = BITS, tables: int = TABLES) -> float:
    """The probability that a pair with this cosine meets in no table."""
    return (1 - (1 - math.acos(cosine) / math.pi) ** bits) ** tables


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the smallest known place of each place's group, after the places a and b were joined."""
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _stars(x: np.ndarray, y: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(root, met) of the unit rows of x, then of y: the smallest place of a row's group and how many partners it met. Without y, x meets itself.

    Pairs are used block by block, never kept.
    """
    alone, d = y is None, x.shape[1]
    y = x if alone else y
    shift = 0 if alone else len(x)
    x_single, y_single = x.astype(np.float32), y.astype(np.float32).T
    close = (d + 8) * 2.0**-23  # what single-precision products of unit rows may be off by
    label, met = np.arange(shift + len(y)), np.zeros(shift + len(y), np.int64)
    step = max(1, BLOCK // max(1, len(y)))
    for i in range(0, len(x), step):
        scores = x_single[i : i + step] @ y_single[:, i:] if alone else x_single[i : i + step] @ y_single
        at = np.flatnonzero(scores >= np.float32(cosine - 2 * close))
        p, q = np.divmod(at, scores.shape[1])
        if alone:
            above = p < q
            at, p, q = at[above], p[above], q[above]
        kept = scores.ravel()[at] > cosine + 2 * close
        unsure = np.flatnonzero(~kept)
        p, q = p + i, q + (i if alone else 0)
        for k in range(0, len(unsure), CLOSE):
            some = unsure[k : k + CLOSE]
            kept[some] = np.einsum("ij,ij->i", x[p[some]], y[q[some]]) >= cosine
        p, q = p[kept], q[kept] + shift
        met += np.bincount(p, minlength=len(met)) + np.bincount(q, minlength=len(met))
        label = _merged(label, p, q)
    return label, met


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(batch: pa.RecordBatch, d: int, kind: np.dtype) -> np.ndarray:
    """The vectors of a batch as they are."""
    column = batch.column("embedding")
    if not (np.diff(column.offsets.to_numpy()) == d).all():
        raise ValueError("dimension mismatch")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind)


def _kind(vectors: DataFrame) -> np.dtype:
    return np.dtype("<f8" if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else "<f4")


def _mixed(node: np.ndarray) -> np.ndarray:
    return node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)


def _keys(d: int, bits: int, tables: int, seed: int):
    """A function of unit rows that gives a bucket in each table."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, d))
    weights = 1 << np.arange(bits)
    return lambda x: ((x @ planes.T > 0).reshape(len(x), tables, bits) @ weights) + (np.arange(tables) << bits)


def _bucket_sizes(rows: DataFrame, d: int, bits: int, tables: int, seed: int) -> tuple[np.ndarray, int, bool]:
    """The rows of each bucket, the rows, and whether buckets would compare more pairs than there are."""
    keys, kind = _keys(d, bits, tables, seed), _kind(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tables << bits, np.int64)
        for batch in batches:
            total += np.bincount(keys(_units(_raw(batch, d, kind))).ravel(), minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["bucket", "n"])

    found = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # tables * 2 ** bits rows at most
    sizes = np.zeros(tables << bits, np.int64)
    for r in found:
        sizes[r["bucket"]] = r["n"]
    n = int(sizes.sum()) // tables
    return sizes, n, float((sizes.astype(float) ** 2).sum()) >= float(n) ** 2


def similar_edges(vectors: DataFrame, cosine: float, bits: int = BITS, tables: int = TABLES, tile: int = TILE, seed: int = 1) -> DataFrame:
    """(a, b, links): for each vector (node, embedding) and tile in which it has a partner, a node of its group there and how many partners it met.

    The edges connect what the pairs would. A pair that shares several buckets is met in each of them. Unequal dimensions are an error.
    """
    rows = usable(vectors).select("node", "embedding")
    first = rows.first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    d = len(first["embedding"])
    return _tiled(rows, cosine, d, bits, tables, tile, seed, *_bucket_sizes(rows, d, bits, tables, seed))


def _tiled(rows: DataFrame, cosine: float, d: int, bits: int, tables: int, tile: int, seed: int, sizes: np.ndarray, n: int, together: bool) -> DataFrame:
    keys, kind, units = _keys(d, bits, tables, seed), _kind(rows), _units  # vectors travel as they are
    if together:
        sizes = np.array([n])
    parts = np.maximum(-(-sizes // tile), np.minimum(SPREAD, -(-sizes // max(1, tile // 4))))
    parts[sizes < 2] = 0  # nobody to meet
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for batch in batches:
            x, node = _raw(batch, d, kind), batch.column("node").to_numpy()
            bucket = np.zeros((len(x), 1), np.int64) if together else keys(units(x))
            copies = parts[bucket]
            own = (_mixed(node)[:, None] % np.maximum(copies, 1).astype(np.uint64)).astype(np.int64)
            ends = np.cumsum(copies.sum(axis=1)) * d * kind.itemsize // SLICE
            for rows in np.split(np.arange(len(x)), np.flatnonzero(np.diff(ends)) + 1):
                n = copies[rows].ravel()
                row, b, s = (np.repeat(v, n) for v in (np.repeat(rows, copies.shape[1]), bucket[rows].ravel(), own[rows].ravel()))
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                key = np.stack([b, np.minimum(s, other), np.maximum(s, other), s > other])
                order = np.lexsort(key[::-1])
                key, row = key[:, order], row[order]
                starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if len(row) else order
                if len(starts):
                    groups = np.split(row, starts[1:])
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(k, t) for k, t in zip(key[:, starts], [pa.int64(), pa.int32(), pa.int32(), pa.int32()])), pa.array([node[g].astype("<i8").tobytes() for g in groups], pa.binary()), pa.array([x[g].tobytes() for g in groups], pa.binary())],
                        ["bucket", "first", "second", "side", "nodes", "packed"],
                    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alone = key[1] == key[2]
        sides = []
        for side in (0,) if alone else (0, 1):
            own = rows[rows["side"] == side]
            sides.append((np.frombuffer(b"".join(own["nodes"]), "<i8"), units(np.frombuffer(b"".join(own["packed"]), kind).reshape(-1, d))))
        root, met = _stars(sides[0][1], None if alone else sides[1][1], cosine)
        node = np.concatenate([nodes for nodes, _ in sides])
        hit = np.flatnonzero(met)
        return pd.DataFrame({"a": node[hit], "b": node[root[hit]], "links": met[hit]})

    dealt = rows.mapInArrow(deal, "bucket long, `first` int, `second` int, side int, nodes binary, packed binary")
    return dealt.groupBy("bucket", "first", "second").applyInPandas(compare, "a long, b long, links long")


def _groups(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each of the unit rows of x the smallest place of its group. Large groups grow from a row, so that their pairs aren't compared."""
    single, close = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
    low, high = np.float32(cosine - 2 * close), np.float32(cosine + 2 * close)
    label, left = np.arange(len(x)), np.arange(len(x))

    def met(some: np.ndarray) -> np.ndarray:
        """Which of the rows left have a partner in some."""
        best = np.concatenate([(single[some] @ single[left[i : i + TILE]].T).max(axis=0) for i in range(0, len(left), TILE)])
        hit = best > high
        unsure = np.flatnonzero((best >= low) & ~hit)
        for k in range(0, len(unsure), TOGETHER):
            at = unsure[k : k + TOGETHER]
            hit[at] = ((x[some] @ x[left[at]].T) >= cosine).any(axis=0)
        return hit

    while len(left) > TOGETHER:
        tried = left[np.linspace(0, len(left) - 1, 64).astype(int)]
        seed = tried[(single[tried] @ single[left].T > high).sum(axis=1).argmax()]
        group, ahead = [np.array([seed])], np.array([seed])
        left = left[left != seed]
        while len(ahead) and len(left):
            some, ahead = ahead[:TOGETHER], ahead[TOGETHER:]
            hit = met(some)
            group.append(left[hit])
            ahead, left = np.concatenate([ahead, left[hit]]), left[~hit]
        group = np.concatenate(group)
        label[group] = group.min()
        if len(group) < len(left) / 8:
            break
    if len(left):
        label[left] = left[_stars(x[left], None, cosine)[0]]
    return label


def _near_order(x: np.ndarray, rows: np.ndarray) -> list[int]:
    """The rows in an order in which neighbours are mostly near: halves along their main direction, and so on."""
    if len(rows) <= 4:
        return rows.tolist()
    own = x[rows] - x[rows].mean(axis=0)
    rows = rows[np.argsort(own @ np.linalg.svd(own.T @ own)[0][:, 0], kind="stable")]
    return _near_order(x, rows[: len(rows) // 2]) + _near_order(x, rows[len(rows) // 2 :])


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x.astype(np.float32) @ y.astype(np.float32).T, -1, 1))


def _between(x: np.ndarray, y: np.ndarray, x_single: np.ndarray, y_single: np.ndarray, p: np.ndarray, q: slice, x_group: np.ndarray, y_group: np.ndarray, cosine: float) -> set[tuple[int, int]]:
    """Pairs of groups of which rows p of x and rows q of y link two; pairs inside a group don't count."""
    low, high = (np.float32(cosine + sign * 2 * (x.shape[1] + 8) * 2.0**-23) for sign in (-1, 1))
    out, there, step = set(), y_single[q].T, max(1, BLOCK // max(1, q.stop - q.start))
    for i in range(0, len(p), step):
        some = p[i : i + step]
        scores = x_single[some] @ there
        hit = np.flatnonzero(scores.max(axis=1) >= low)
        if not len(hit):
            continue
        scores, some = scores[hit], some[hit]
        a, b = np.nonzero(scores >= low)
        apart = x_group[some[a]] != y_group[q.start + b]
        a, b = a[apart], b[apart]
        sure, a, b = scores[a, b] > high, some[a], b + q.start
        unsure = np.flatnonzero(~sure)
        for k in range(0, len(unsure), CLOSE):
            few = unsure[k : k + CLOSE]
            sure[few] = np.einsum("ij,ij->i", x[a[few]], y[b[few]]) >= cosine
        out |= set(map(tuple, np.unique(np.stack([x_group[a[sure]], y_group[b[sure]]], axis=1), axis=0).tolist()))
    return out


def linked(rows: DataFrame, cosine: float, d: int, n: int, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect what all pairs of rows (node, embedding) with this cosine or more would.

    Each row belongs to a cell of its nearest pivot, one of SHELLS by its angle to it; cells near each other are parts of about `tile` rows, and a
    large cell is several parts.
    """
    rows = rows.select(F.col("node").cast("long").alias("node"), "embedding")
    spark, kind, wanted = rows.sparkSession, _kind(rows), math.acos(max(-1.0, min(1.0, cosine)))
    drawn = rows.orderBy(F.xxhash64("node"), "node").limit(max(1, min(PIVOTS, n // OWN))).collect()
    if any(len(r["embedding"]) != d for r in drawn):
        raise ValueError("dimension mismatch")
    pivots, names = _units(np.array([r["embedding"] for r in drawn])), np.array([r["node"] for r in drawn])
    order = _near_order(pivots, np.arange(len(pivots)))
    pivots, names = pivots[order], names[order]
    far = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _raw(batch, d, kind)
            unit = _units(x)
            scores = unit.astype(np.float32) @ far.value.astype(np.float32).T
            pivot = scores.argmax(axis=1)
            near = np.einsum("ij,ij->i", unit, far.value[pivot])
            cell = pivot * SHELLS + np.minimum(np.arccos(np.clip(near, -1, 1)) * 2 / max(wanted, 1e-3), SHELLS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(cell), pa.array(near), pa.array([v.tobytes() for v in x], pa.binary())], ["node", "cell", "near", "packed"])

    placed = cut(rows.mapInArrow(place, "node long, cell long, near double, packed binary"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max("near").alias("most")).collect()  # PIVOTS * SHELLS rows at most
    cells.sort(key=lambda r: (r["cell"] % SHELLS > 1, r["cell"]))  # outer ones apart, as many rows are within their reach
    pivot, held = np.array([r["cell"] // SHELLS for r in cells]), np.array([r["n"] for r in cells])
    inner, outer = (np.arccos(np.clip([r[c] for r in cells], -1, 1)) for c in ("most", "least"))
    size = min(tile, max(tile // 16, n // LEAST_PARTS, 1))
    pieces = np.maximum(1, -(-held // size))
    share = np.cumsum(held // pieces) // size + np.cumsum(pieces - 1)  # the last part of each cell: a cell in pieces ends one of its own
    first = share - pieces + 1
    parts = int(share[-1]) + 1
    at = spark.createDataFrame([(r["cell"], k, int(first[k]), int(pieces[k]), int(names[pivot[k]])) for k, r in enumerate(cells)], "old long, cell long, first long, pieces long, pivot long")
    placed = placed.withColumnRenamed("cell", "old").join(F.broadcast(at), "old").select("node", "cell", "near", "pivot", (F.col("first") + F.pmod(F.xxhash64("node"), "pieces")).alias("part"), "packed")

    def within(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        root = node[_groups(_units(np.frombuffer(b"".join(rows["packed"]), kind).reshape(-1, d)), cosine)]
        return pd.DataFrame({"a": node, "b": root})[node != root]

    near_ones = names[_groups(pivots, cosine)]
    known = spark.createDataFrame([(int(a), int(b)) for a, b in zip(names, near_ones) if a != b], "a long, b long")
    own = placed.where((F.col("near") >= cosine + 1e-12) & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    inside = cut(placed.repartition(min(parts, MOST_TASKS), "part").groupBy("part").applyInPandas(within, "a long, b long").unionByName(own).unionByName(known).distinct())
    if parts == 1:
        return inside
    named = cut(components(inside))
    joined = cut(placed.join(named, "node", "left").select("node", "cell", "part", "packed", F.coalesce("component", "node").alias("group")))
    most = joined.groupBy("group").count().orderBy(F.desc("count"), "group").first()
    main, outside = most["group"], n - most["count"]
    slices = max(1, -(-outside // tile))
    bounds = spark.sparkContext.broadcast((pivot, inner, outer, first, pieces))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Residents go to all slices of their part, rows outside the main group also to other parts that may hold a partner."""
        pivot, _, _, first, pieces = bounds.value
        for batch in batches:
            node, cell, part, group = (batch.column(c).to_numpy() for c in ("node", "cell", "part", "group"))
            packed = batch.column("packed")
            row, to = np.divmod(np.arange(len(node) * slices), slices)
            yield out(node, cell, part, group, packed, row, part[row], to, np.zeros(len(row), np.int64))
            free = np.flatnonzero(group != main)
            x = _units(np.frombuffer(b"".join(packed.take(pa.array(free)).to_pylist()), kind).reshape(-1, d))
            for k in range(0, len(free), TOGETHER):
                some = free[k : k + TOGETHER]
                met, c = np.nonzero(reached(x[k : k + TOGETHER], cell[some], np.arange(len(pivot))))
                n = pieces[c]
                to = np.repeat(first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                asked = np.zeros((len(some), parts), bool)
                asked[np.repeat(met, n), to] = True
                asked[np.arange(len(some)), part[some]] = False  # its own part has been gone through
                met, to = np.nonzero(asked)
                row = some[met]
                yield out(node, cell, part, group, packed, row, to, (_mixed(node[row]) % np.uint64(slices)).astype(np.int64), np.ones(len(row), np.int64))

    def reached(x: np.ndarray, cell: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of some cells may hold a partner of each row: by a cell's least and largest angle, and as a partner there is nearer to that pivot than to the row's own."""
        pivot, inner, outer = bounds.value[:3]
        far_off, which = np.unique(pivot[cells], return_inverse=True)
        angles = _angles(x, far.value[far_off])
        nearest = np.arccos(np.clip(np.einsum("ij,ij->i", x, far.value[pivot[cell]]), -1, 1))
        angles[angles > nearest[:, None] + 2 * wanted + SLACK] = np.inf
        angles = angles[:, which]
        return (angles <= (outer[cells] + wanted + SLACK).astype(np.float32)) & (angles >= (inner[cells] - wanted - SLACK).astype(np.float32))

    def out(node, cell, part, group, packed, row, to, part_slice, side) -> pa.RecordBatch:
        columns = [pa.array(to), pa.array(part_slice), pa.array(side), *(pa.array(v[row]) for v in (node, cell, part, group)), packed.take(pa.array(row))]
        return pa.RecordBatch.from_arrays(columns, ["to", "slice", "side", "node", "cell", "part", "group", "packed"])

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = set()
        here, guests = rows[rows["side"] == 0], rows[rows["side"] == 1]
        vectors = lambda some: _units(np.frombuffer(b"".join(some["packed"]), kind).reshape(-1, d))
        if len(guests):
            here = here.iloc[np.lexsort([here["group"].to_numpy() != main, here["cell"].to_numpy()])]  # those of the main group first in each cell
            x, y = vectors(guests), vectors(here)
            x_single, y_single = x.astype(np.float32), y.astype(np.float32)
            x_group, y_group = guests["group"].to_numpy(), here["group"].to_numpy()
            early = guests["part"].to_numpy() < key[0]  # pairs of rows outside the main group meet once
            cells, start = np.unique(here["cell"].to_numpy(), return_index=True)
            reach = reached(x, guests["cell"].to_numpy(), cells)
            for column, begin, end in zip(reach.T, start, [*start[1:], len(here)]):
                middle = begin + int((y_group[begin:end] == main).sum())
                for p, q in ((np.flatnonzero(column & early), slice(begin, end)), (np.flatnonzero(column & ~early), slice(begin, middle))):
                    if len(p) and q.stop > q.start:
                        found |= _between(x, y, x_single, y_single, p, q, x_group, y_group, cosine)
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    schema = "to long, slice long, side long, node long, cell long, part long, group long, packed binary"
    across = joined.mapInArrow(visit, schema).repartition(min(parts * slices, MOST_TASKS), "to", "slice").groupBy("to", "slice").applyInPandas(compare, "a long, b long")
    return named.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across.distinct())


def group_edges(vectors: DataFrame, cosine: float, bits: int = BITS, tables: int = TABLES, tile: int = TILE, seed: int = 1) -> DataFrame:
    """(a, b): edges that connect what similar_edges would, without a count of partners."""
    rows = usable(vectors).select("node", "embedding")
    first = rows.first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long")
    d = len(first["embedding"])
    sizes, n, together = _bucket_sizes(rows, d, bits, tables, seed)
    return linked(rows, cosine, d, n, tile) if together else _tiled(rows, cosine, d, bits, tables, tile, seed, sizes, n, together).select("a", "b")


def _named(vectors: DataFrame, cosine: float, **how) -> DataFrame:
    """(node, cluster) of vectors (node, embedding)."""
    rows = usable(cut(vectors.select("node", "embedding")))  # embeddings may be costly, and a filter would make them twice
    firsts = cut(rows.groupBy("embedding").agg(F.min("node").alias("first")))  # equal vectors are compared once
    equal = rows.join(firsts, "embedding").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = group_edges(firsts.select(F.col("first").alias("node"), "embedding"), cosine, **how).unionByName(equal)
    found = cut(found.distinct())
    return vectors.select("node").join(components(found), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def similarity_clusters(vectors: DataFrame, cosine: float = 0.9, **how) -> DataFrame:
    """(node, cluster, size) of vectors (node: long, embedding): clusters linked by cosines of at least this, named after their smallest node.

    A node without a similar one, or with an unusable vector, is its own cluster of size 1. Nodes differ.
    """
    named = _named(vectors, cosine, **how)
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size"))
    return named.join(sizes, "cluster").select("node", "cluster", "size")


def error_clusters(errors: DataFrame, cosine: float = 0.9, **how) -> DataFrame:
    """(cluster, size, example, first_ts, last_ts) of errors (node, message, ts, embedding) whose messages' vectors are similar: one row per cluster, largest first.

    The example is the message of the smallest node.
    """
    named = _named(errors, cosine, **how).join(errors.select("node", "message", "ts"), "node")
    facts = named.groupBy("cluster").agg(F.count("*").alias("size"), F.min(F.struct("node", "message"))["message"].alias("example"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return facts.orderBy(F.desc("size"), "cluster")
