"""Centroid clustering: delta Lloyd over exact integers.

Vectors lie packed, a few thousand to a row, next to their owners and distances, in a table that each round writes anew without a shuffle.
The driver holds what is bounded by the number of centroids: their components, the sums of their vectors and the counts. In a round, a vector
whose owner stayed where it was compares its stored distance with the centroids that moved; one whose owner moved compares with all.
Vectors that change hands are added to the new owner's sums and taken from the old one's, as signed integers summed by task, so
that the sums are always those of the whole table without reading the vectors that stayed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved

#: Vectors of a packed row.
TOGETHER = 4_096
#: Bound of the integers: four times its square times the components fits in a long.
LARGEST = 1 << 27

STATE = "ids array<long>, vectors binary, owners binary, distances binary, owner array<int>, moved array<long>, sums array<array<long>>"


def usable(vector: Column, d: int) -> Column:
    """Whether a vector has exactly d components, none of them null or not finite."""
    return F.coalesce((F.size(vector) == d) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * x.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows: exact by doubles where all products and sums are below 2 ** 53, else by longs."""
    top = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, the smaller number among equals."""
    found = squares(x, centroids)
    owner = found.argmin(axis=1)
    return owner, found[np.arange(len(x)), owner]


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The assignment after the `changed` centroids (a mask) moved, given the one before."""
    owner, distance = owner.copy(), distance.copy()
    lost = changed[owner]
    if lost.any():
        owner[lost], distance[lost] = nearest(x[lost], centroids)
    stay, moved = np.flatnonzero(~lost), np.flatnonzero(changed)
    if len(stay) and len(moved):
        best, found = nearest(x[stay], centroids[moved])
        best = moved[best]
        better = (found < distance[stay]) | ((found == distance[stay]) & (best < owner[stay]))
        owner[stay[better]], distance[stay[better]] = best[better], found[better]
    return owner, distance


def transfers(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What each centroid wins and loses: sums of vectors and their number, signed."""
    sums, counts = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
    at = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    np.add.at(sums, new[at], x[at])
    np.add.at(counts, new[at], 1)
    if old is not None:
        np.subtract.at(sums, old[at], x[at])
        np.subtract.at(counts, old[at], 1)
    return sums, counts


def _state(ids: pa.Array, x: np.ndarray, width: str, owner: np.ndarray, distance: np.ndarray, gained: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    sums, counts = gained
    k = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
    columns = {
        "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([x.astype(width).tobytes()], pa.binary()),
        "owners": pa.array([owner.astype("<i4").tobytes()], pa.binary()), "distances": pa.array([distance.astype("<i8").tobytes()], pa.binary()),
        "owner": pa.array([k.tolist()], pa.list_(pa.int32())), "moved": pa.array([counts[k].tolist()], pa.list_(pa.int64())), "sums": pa.array([sums[k].tolist()], pa.list_(pa.list_(pa.int64()))),
    }
    return pa.RecordBatch.from_pydict(columns)


def first_centroids(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The k rows whose `seed:vec_id` has the smallest sha256, in this order; the vector decides between equal ids."""
    drawn = rows.withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256))
    return np.array([integers(np.array(r["embedding"], np.float64), scale) for r in drawn.orderBy("draw", "embedding").limit(k).collect()])


def delta_lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, d: int = 64, scale: int = 64, seed: int = 1, together: int = TOGETHER) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable row of vectors (vec_id, embedding).

    Usable: exactly d components, none null or not finite; other rows don't appear. A component x becomes floor(scale * x), held between
    -2 ** 27 and 2 ** 27 so that distances fit in longs. Repeated rows, rows that share an id and those with a null id (drawn as "null") are
    vectors like any other. With fewer than k vectors there are as many centroids as vectors; no usable vector gives no row. An
    empty centroid stays where it is. Sums beyond a long are null in the inertia columns.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding"), d))
    centroids = first_centroids(rows, k, scale, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).where(F.lit(False))
    k, first = len(centroids), centroids

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), together):
                part = batch.slice(a, together)
                x = integers(part.column("embedding").flatten().to_numpy().reshape(-1, d), scale)
                owner, distance = nearest(x, first)
                width = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4"
                yield _state(part.column("ids"), x, width, owner, distance, transfers(x, None, owner, k))

    def step(centroids: np.ndarray, changed: np.ndarray):
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    ids, vectors, owners, distances = (batch.column(c)[row] for c in ("ids", "vectors", "owners", "distances"))
                    owner, distance = np.frombuffer(owners.as_py(), "<i4").astype(np.int64), np.frombuffer(distances.as_py(), "<i8")
                    packed = vectors.as_py()
                    width = "<i2" if len(packed) == 2 * d * len(owner) else "<i4"
                    x = np.frombuffer(packed, width).reshape(-1, d).astype(np.int64)
                    new, distance = reassigned(x, owner, distance, centroids, changed)
                    yield _state(ids.values, x, width, new, distance, transfers(x, owner, new, k))

        return move

    def gained(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        each = state.select(F.explode(F.arrays_zip("owner", "moved", "sums")).alias("g")).select("g.*")
        total = each.groupBy("owner").agg(F.sum("moved").alias("moved"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"))
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for r in total.collect():  # a row per centroid
            sums[r["owner"]], counts[r["owner"]] = r["sums"], r["moved"]
        return sums, counts

    now = Saved(rows.select(F.col("vec_id").alias("ids"), "embedding").mapInArrow(start, STATE), "clusters")
    sums, counts = gained(now.df)
    for _ in range(rounds):
        better = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        changed = (better != centroids).any(axis=1)
        if not changed.any():
            break  # every later round would be the same
        centroids = better
        old, now = now, Saved(now.df.mapInArrow(step(centroids, changed), STATE), "clusters")
        old.delete()
        more = gained(now.df)
        sums, counts = sums + more[0], counts + more[1]
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, owners, distances in zip(batch.column("ids"), batch.column("owners"), batch.column("distances")):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(owners.as_py(), "<i4")), pa.array(np.frombuffer(distances.as_py(), "<i8"))], ["vec_id", "cluster", "distance"])

    out = now.df.select("ids", "owners", "distances").mapInArrow(unpack, "vec_id long, cluster int, distance long")
    whole = lambda x: F.expr(f"try_cast({x} AS long)")
    each = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster"))
    total = each.agg(F.sum("of_cluster").alias("of_all"))
    facts = names.join(each, "cluster").crossJoin(total).select("cluster", whole("of_cluster").alias("cluster_inertia"), whole("of_all").alias("inertia"), "centroid_sha256")  # a row per centroid, times one
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _lloyd_sql(k: int = 16, rounds: int = 3, d: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Plain Lloyd rounds: each compares all vectors with all centroids."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {d}
), c0 AS MATERIALIZED (SELECT k AS c, x AS y FROM v WHERE k < {k})"""]  # fmt: skip
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS MATERIALIZED (
  SELECT k, c, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS s FROM v, c{n}
), a{n} AS MATERIALIZED (
  SELECT k, c, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, c) AS r FROM d{n}) WHERE r = 1
)""")
        if n < rounds:
            parts.append(f"""m{n} AS MATERIALIZED (
  SELECT c, list(z ORDER BY i) AS y FROM (
    SELECT c, i, CASE WHEN t % n < 0 THEN t // n - 1 ELSE t // n END AS z FROM (
      SELECT c, i, sum(x[i])::BIGINT AS t, count(*) AS n FROM a{n} JOIN v USING (k), range(1, {d + 1}) r(i) GROUP BY c, i)) GROUP BY c
), c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.y, o.y) AS y FROM c{n} o LEFT JOIN m{n} m USING (c))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, c::INT AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (k) JOIN c{rounds} USING (c)"""


OP13_SQL = _lloyd_sql()
