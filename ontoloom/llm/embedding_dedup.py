"""Embedding near-dedup: a subspace pigeonhole join, verified exactly.

Unit vectors with cosine c lie at a squared distance of 2 - 2c. A seeded rotation spreads it evenly, then the vectors are cut into blocks
of about 16 components. Two vectors within the squared distance r are, in at least one block, within the share of r that the block's
components are of all. So each block is range-joined alone: its space is parted into the cells of sampled pivots, a vector lives in its
nearest pivot's cell and visits each cell in which a partner within the budget can live, which the distance to the bisecting plane decides.
A cell is compared in tiles of bounded size. What passes a block's budget is verified by its cosine in the same task; a pair counts
in the first block whose budget it meets. No pair leaves a task: a tile returns for each vector its links there and its smallest partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.llm.common import Saved
from ontoloom.llm.components import connected_components

#: Components of a block, about.
BLOCK = 16
#: Vectors a cell has on average, and at most on one side of a tile.
CELL = TILE = 16_384
#: Most pivots of a block.
PIVOTS = 1_024
#: Pairs that are compared at once in a tile.
ROWS, COLUMNS = 512, 2_048


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """The rows as unit vectors in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Blocks:
    """The rotation of vectors with d components, their blocks, and each block's budget for pairs with at least this cosine."""

    def __init__(self, d: int, cosine: float, seed: int):
        q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
        self.rotation = q * np.sign(np.diag(r))
        edges = np.linspace(0, d, max(1, round(d / BLOCK)) + 1).astype(int)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        # A little more than the budget: rounding must not lose a pair, and the cosine decides.
        self.budgets = [(2 - 2 * cosine) * (b - a) / d * (1 + 1e-9) + 1e-12 for a, b in self.spans]

        #: What float32 products may be off by; pairs within it are decided in double precision.
        self.slack = 1e-6 * (16 + d)

    def rotated(self, units: np.ndarray) -> np.ndarray:
        """Row by row the same in whatever tile, which matrix products of a library needn't be."""
        return np.einsum("ij,jk->ik", units, self.rotation, optimize=False)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T), 0)


def visited(x: np.ndarray, pivots: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and which other cells it visits. Of two cells only one's vectors visit the other."""
    square = distances(x, pivots)
    home, number = square.argmin(axis=1), np.arange(len(pivots))
    apart = np.sqrt(distances(pivots, pivots))[home]
    gap = square - square[np.arange(len(x)), home][:, None]
    goes = ((home[:, None] + number) % 2 == 0) == (number < home[:, None])
    return home, (gap <= 2 * apart * math.sqrt(budget) + 1e-9) & goes & (number != home[:, None])


def share(nodes: np.ndarray, parts: int) -> np.ndarray:
    return (((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that edges a-b reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (shorter := label[label])).any():
            label = shorter


class Side:
    """The vectors of one side of a tile. For each block up to its own, products of left and right forms are minus half the squared distances."""

    def __init__(self, units: np.ndarray, block: int, blocks: Blocks):
        self.units, self.single, self.rotated = units, units.astype(np.float32), blocks.rotated(units)
        self.left, self.right = [], []
        for a, b in blocks.spans[: block + 1]:
            x = self.rotated[:, a:b]
            half, one = -0.5 * (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1))
            self.left.append(np.hstack([x, half, one]).astype(np.float32))
            self.right.append(np.hstack([x, one, half]).astype(np.float32))

    def __len__(self) -> int:
        return len(self.units)


def _exact(x: Side, y: Side, p: np.ndarray, q: np.ndarray, block: int, blocks: Blocks, cosine: float) -> np.ndarray:
    """Which of the pairs p-q are links and meet this block's budget as the first one, in double precision."""
    out = np.zeros(len(p), bool)
    for k in range(0, len(p), 1 << 15):
        at = np.arange(k, min(len(p), k + (1 << 15)))
        for n, (a, b) in enumerate(blocks.spans[: block + 1]):
            gap = x.rotated[p[at], a:b] - y.rotated[q[at], a:b]
            met = (gap * gap).sum(axis=1) <= blocks.budgets[n]
            at = at[met if n == block else ~met]
        out[at[(x.units[p[at]] * y.units[q[at]]).sum(axis=1) >= cosine]] = True
    return out


def linked(x: Side, y: Side, i: slice, j: slice, block: int, blocks: Blocks, cosine: float, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of x[i] and y[j] that are links and meet no budget before this block's. above: only with the second index larger."""
    slack = blocks.slack
    low, high = ([-0.5 * (t + sign * slack) for t in blocks.budgets] for sign in (1, -1))
    s = x.left[block][i] @ y.right[block][j].T
    near = s >= low[block]
    if above:
        near &= np.arange(i.start, i.start + len(s))[:, None] < np.arange(j.start, j.start + s.shape[1])
    n = np.count_nonzero(near)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    if n * 50 > near.size:  # many, as among copies: most are decided by matrices
        sure = s >= high[block]
        for k in range(block):
            s = x.left[k][i] @ y.right[k][j].T
            near &= s < high[k]
            sure &= s < low[k]
        s = x.single[i] @ y.single[j].T
        near &= s > cosine - slack
        sure &= near & (s > cosine + slack)
        near &= ~sure
        found.append(np.nonzero(sure))
    p, q = np.nonzero(near)
    hit = _exact(x, y, p + i.start, q + j.start, block, blocks, cosine)
    found.append((p[hit], q[hit]))
    return np.concatenate([p for p, _ in found]) + i.start, np.concatenate([q for _, q in found]) + j.start


def _pack(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _links(nodes: DataFrame, cosine: float, seed: int, cell: int, tile: int) -> DataFrame:
    """(node, links, root): partial counts of links, and nodes that a tile connects. nodes: node, n, vector (distinct and usable)."""
    spark = nodes.sparkSession
    kind = "<f4" if nodes.schema["vector"].dataType.elementType == T.FloatType() else "<f8"
    found = {r["d"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row per length
    every = {d: max(cell, math.ceil(n / PIVOTS)) for d, n in found.items() if n > cell}
    pivots = {d: [np.zeros((1, d))] for d in found}
    if every:
        steps = F.create_map(*[F.lit(x) for d, step in every.items() for x in (d, step)])
        picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(seed)), steps[F.size("vector")]) == 0)  # about one in `step`, PIVOTS of a length
        for r in picked.select("vector").collect():
            pivots[len(r["vector"])].append(unit(np.array([r["vector"]])))
    pivots = {d: np.concatenate(x[1:] or x) for d, x in pivots.items()}

    def dealt(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(d, block, cell, visits, rows, vectors) of the batch's vectors, rows by place."""
        column = batch.column("vector")
        size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
        first = column.offsets.to_numpy() - column.offsets.to_numpy()[0]
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            raw = flat[first[rows][:, None] + np.arange(d)]
            blocks = Blocks(d, cosine, seed)
            x, p = blocks.rotated(unit(raw)), blocks.rotated(pivots[d])
            for k, (a, b) in enumerate(blocks.spans):
                home, visits = visited(x[:, a:b], p[:, a:b], blocks.budgets[k])
                for c in range(len(p)):
                    for goes, at in ((0, home == c), (1, visits[:, c])):
                        if at.any():
                            yield d, k, c, goes, rows[at], raw[at]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for *key, rows, _ in dealt(batch):
                total[tuple(key)] = total.get(tuple(key), 0) + len(rows)
        if total:
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in zip(*total)], pa.array(list(total.values()), pa.int64())], ["d", "block", "cell", "goes", "n"])

    counted = nodes.select("vector").mapInArrow(count, "d int, block int, cell int, goes int, n long").groupBy("d", "block", "cell", "goes").agg(F.sum("n").alias("n"))
    parts = {tuple(r)[:4]: math.ceil(r["n"] / tile) for r in counted.collect()}  # two rows per pivot and block at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            out = []
            for d, k, c, goes, rows, raw in dealt(batch):
                live, guests = parts.get((d, k, c, 0), 0), parts.get((d, k, c, 1), 0)
                part = share(node[rows], parts[d, k, c, goes])
                for s in np.unique(part).tolist():
                    at = part == s
                    packed = _pack(node[rows[at]], "<i8"), _pack(n[rows[at]], "<i8"), _pack(raw[at], kind)
                    if goes:
                        tiles = [(q, live + s, 1) for q in range(live)]
                    else:
                        tiles = [(s, q, 0) for q in range(s, live + guests)] + [(q, s, 1) for q in range(s)]
                    out += [(d, k, c, *t, *packed) for t in tiles]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32()] * 6 + [pa.binary()] * 3)], ["d", "block", "cell", "left", "right", "side", "node", "n", "raw"])

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d, block, _, left, right = (int(x) for x in key)
        blocks, sides = Blocks(d, cosine, seed), []
        for side in (0, 1):
            own = rows[rows["side"] == side]
            raw = np.frombuffer(b"".join(own["raw"]), kind).reshape(-1, d)
            units = unit(raw) if len(raw) else raw.astype(np.float64)
            sides.append((np.frombuffer(b"".join(own["node"]), "<i8"), np.frombuffer(b"".join(own["n"]), "<i8"), Side(units, block, blocks)))
        alone = left == right
        (node, n, x), (node_y, n_y, y) = sides[0], sides[0 if alone else 1]
        both = node if alone else np.concatenate([node, node_y])
        at = np.argsort(both, kind="stable")  # places are numbered by node, so that a root is the smallest node
        place = np.empty(len(both), np.int64)
        place[at] = np.arange(len(both))
        links, label = np.zeros(len(both), np.int64), np.arange(len(both))
        for i in range(0, len(x), ROWS):
            for j in range(0, len(y), COLUMNS):
                if alone and j + COLUMNS <= i:
                    continue
                p, q = linked(x, y, slice(i, i + ROWS), slice(j, j + COLUMNS), block, blocks, cosine, alone and j < i + ROWS)
                if len(p):
                    second = q if alone else q + len(node)
                    np.add.at(links, p, n_y[q])
                    np.add.at(links, second, n[p])
                    a, b = place[p], place[second]
                    new = label[a] != label[b]
                    if new.any():
                        every = np.arange(len(label))
                        label = roots(np.concatenate([every, a[new]]), np.concatenate([label, b[new]]), len(label))
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": both[hit], "links": links[hit], "root": both[at[label[place[hit]]]]})

    tiles = nodes.mapInArrow(deal, "d int, block int, cell int, `left` int, `right` int, side int, node binary, n binary, raw binary")
    return tiles.groupBy("d", "block", "cell", "left", "right").applyInPandas(compare, "node long, links long, root long")


def link_vectors(vectors: DataFrame, cosine: float = 0.9, seed: int = 11, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding: array of float or double).

    Rows link if the cosine of their vectors in double precision is at least `cosine` (above 0), whatever other columns say; only vectors
    of one length are compared. Null, empty and zero vectors and those with null or non-finite components link with nothing and are kept.
    Equal vectors are one node with a weight, so a vector that very many rows share is compared once. Repeated rows link with each
    other; rows may share an id, and component_id is the smallest id, nulls aside, so rows with a null id are never kept.
    A group of m near copies costs m * m / 2 comparisons, in tiles of bounded size; none of its pairs is written.
    """
    rows = vectors.select("vec_id", "embedding")
    fine = rows.where(usable(F.col("embedding"))).withColumn("vector", F.transform("embedding", lambda x: x + F.lit(0).cast(rows.schema["embedding"].dataType.elementType)))
    distinct = Saved(fine.groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    links = Saved(_links(distinct.df.select("node", "n", "vector"), cosine, seed, cell, tile), "links")
    classes = connected_components(links.df.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.df.groupBy("node").agg(F.sum("links").alias("links"))
    named = Saved(
        distinct.df.select("node", "n", "first").join(counts, "node", "left").join(classes, "node", "left").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "named",
    )
    lowest = named.df.groupBy("component").agg(F.min("first").alias("component_id"))
    of_vector = distinct.df.select("vector", "node").join(named.df.join(lowest, "component").select("node", "n_links", "component_id"), "node").drop("node")
    out = fine.join(of_vector, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    links.delete()
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, in double precision.
OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), fine AS (
  SELECT k, vec_id, e, len(e) AS d, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.k AS a, b.k AS b FROM fine a JOIN fine b ON a.d = b.d AND a.k <> b.k WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT k AS a, k AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), lowest AS (
  SELECT r.a AS k, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.k = r.b GROUP BY r.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.k) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN lowest USING (k)
"""
