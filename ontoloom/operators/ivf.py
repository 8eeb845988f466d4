"""Approximate vector search: an inverted-file index kept as tables. Exact search (operators.vector) stays the default.

Vectors are scaled to unit length and fall into lists around trained centroids; a posting holds a vector's residual in a byte per component. A
query probes the lists whose centroids are most like it, scores their postings by the codes, and its best candidates are scored again
by their own vectors, so that scores are exact and only the choice of candidates is approximate.

An index is a folder: centroids (list, centroid), types of the ids, and postings/list=<n>/ (entity_id, collection, code). append() adds postings to
the lists of a trained index; rebuild() trains anew, in a folder beside the old one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ontoloom.functions.lineage import shared_folder
from ontoloom.operators import vector as V

#: Most lists, so that centroids stay small on the driver and in tasks.
MOST_LISTS = 4_096
#: Residual components are kept within so many times 1 / sqrt(dimension).
REACH = 4.0
#: Candidates that are scored exactly, for each wanted row.
REFINE = 4


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose embedding is a finite vector other than zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return rows.where(F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False)))


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """The vectors of an Arrow column as unit rows; all must have d components."""
    if not (np.diff(column.offsets.to_numpy()) == d).all():
        raise ValueError("dimension mismatch")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def train(vectors: DataFrame, lists: int | None = None, rounds: int = 5, seed: int = 1) -> np.ndarray:
    """Centroids by spherical k-means over all rows; each round sums by task, and one row per list reaches the driver."""
    rows = usable(vectors).select("entity_id", "embedding")
    n = rows.count()
    lists = min(lists or math.ceil(math.sqrt(n)), MOST_LISTS, max(n, 1))
    first = rows.withColumn("draw", F.xxhash64(F.lit(seed), "entity_id")).orderBy("draw", "entity_id").limit(lists).collect()
    if not first:
        return np.zeros((0, 0))
    if len({len(r["embedding"]) for r in first}) > 1:
        raise ValueError("dimension mismatch")
    centroids = np.array([r["embedding"] for r in first], np.float64)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    d = centroids.shape[1]
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                x = matrix(batch.column("embedding"), d)
                near = (x @ shared.value.T).argmax(axis=1)
                np.add.at(sums, near, x)
                counts += np.bincount(near, minlength=len(counts))
            k = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(counts[k]), pa.array(sums[k].tolist(), pa.list_(pa.float64()))], ["list", "n", "total"])

        def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:  # a row per task
            return pd.DataFrame({"list": [key[0]], "n": [parts["n"].sum()], "total": [np.sum(parts["total"].tolist(), axis=0).tolist()]})

        summed = rows.select("embedding").mapInArrow(gather, "list int, n long, total array<double>").groupBy("list").applyInPandas(add, "list int, n long, total array<double>")
        better = centroids.copy()
        for r in summed.collect():
            total = np.array(r["total"])
            if norm := np.linalg.norm(total):
                better[r["list"]] = total / norm
        shared.destroy()
        done = np.abs(better - centroids).max() < 1e-6
        centroids = better
        if done:
            break
    return centroids


class IvfIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # MOST_LISTS at most
        types = {r["name"]: r["type"] for r in spark.read.parquet(f"{folder}/types").collect()}
        self.schema = f"collection {types['collection']}, entity_id {types['entity_id']}, code binary, list int"
        self.centroids = np.array([r["centroid"] for r in rows], np.float64)
        self.step = REACH / math.sqrt(max(1, self.centroids.shape[1])) / 127 if len(rows) else 1.0

    @classmethod
    def build(cls, vectors: DataFrame, folder: str | None = None, lists: int | None = None, rounds: int = 5, seed: int = 1) -> IvfIndex:
        """Trains on all rows of vectors (collection, entity_id, embedding) and indexes them; unusable vectors are left out, unequal dimensions are an error."""
        spark = vectors.sparkSession
        folder = folder or f"{shared_folder(spark)}/ontoloom/ivf-{uuid.uuid4().hex}"
        centroids = train(vectors, lists, rounds, seed)
        table = spark.createDataFrame([(k, c) for k, c in enumerate(centroids.tolist())], "list int, centroid array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
        types = [(c, vectors.schema[c].dataType.simpleString()) for c in ("collection", "entity_id")]
        spark.createDataFrame(types, "name string, type string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/types")
        index = cls(spark, folder)
        index._write(vectors, "overwrite")
        return index

    def append(self, vectors: DataFrame) -> None:
        """Adds rows to the lists of the trained centroids; their entity_ids must be new."""
        self._write(vectors, "append")

    def rebuild(self, vectors: DataFrame, **how) -> IvfIndex:
        """An index trained anew beside this one, with its folder's name and a suffix; drop the old folder when no search uses it."""
        return IvfIndex.build(vectors, f"{self.folder}-{uuid.uuid4().hex[:8]}", **how)

    def _write(self, vectors: DataFrame, mode: str) -> None:
        centroids, step, d = self.centroids, self.step, self.centroids.shape[1] if len(self.centroids) else 0

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("embedding"), d)
                near = (x @ centroids.T).argmax(axis=1)
                code = np.clip(np.rint((x - centroids[near]) / step), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("collection"), batch.column("entity_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(near.astype(np.int32))], ["collection", "entity_id", "code", "list"])

        rows = usable(vectors).select("collection", "entity_id", "embedding").mapInArrow(encode, self.schema)
        # A list's rows lie together, a long list in eight parts.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, "list", F.pmod(F.xxhash64("entity_id"), F.lit(8)))
        dealt.write.mode(mode).partitionBy("list").parquet(f"{self.folder}/postings")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/postings")

    def _nearest_lists(self, queries: np.ndarray) -> np.ndarray:
        """For each query all lists, most similar first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")

    def candidates(self, queries: DataFrame, n: int, probes: int) -> DataFrame:
        """(query_id, collection, entity_id, score): the n best postings of each query (query_id, embedding) by their codes, among `probes` lists."""
        id_type, of = queries.schema["query_id"].dataType, self.postings().schema
        schema = f"query_id {id_type.simpleString()}, collection {of['collection'].dataType.simpleString()}, entity_id {of['entity_id'].dataType.simpleString()}, score double"
        kinds = [to_arrow_type(x) for x in (id_type, of["collection"].dataType, of["entity_id"].dataType)] + [pa.float64()]
        out, centroids, step = self.spark.createDataFrame([], schema), self.centroids, self.step
        for block in V._query_blocks(usable(queries)):
            names, asked = [q for q, _ in block], np.array([x for _, x in block], np.float64)
            asked /= np.linalg.norm(asked, axis=1, keepdims=True)
            if asked.shape[1] != centroids.shape[1]:
                raise ValueError("dimension mismatch")
            near = self._nearest_lists(asked)[:, :probes]
            order = np.argsort(near, axis=None, kind="stable")  # by list, then by query
            found, starts = np.unique(near.ravel()[order], return_index=True)
            wanted = dict(zip(found.tolist(), np.split((order // near.shape[1]).astype(np.int32), starts[1:])))
            shared = self.spark.sparkContext.broadcast((names, asked, wanted))

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, asked, wanted = shared.value
                best: dict[int, tuple[np.ndarray, list, list]] = {}
                for batch in batches:
                    of_list = batch.column("list").to_numpy()
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(-1, asked.shape[1])
                    for c in np.unique(of_list).tolist():
                        at, who = np.flatnonzero(of_list == c), wanted.get(c, [])
                        x = centroids[c] + step * code[at]
                        scores = asked[who] @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                        ids, kinds_of = batch.column("entity_id").take(pa.array(at)).to_pylist(), batch.column("collection").take(pa.array(at)).to_pylist()
                        for q, row in zip(who, scores):
                            top = np.argsort(-row, kind="stable")[:n].tolist()
                            new = (row[top], [ids[k] for k in top], [kinds_of[k] for k in top])
                            if q in best:
                                new = tuple(a + b if isinstance(a, list) else np.append(a, b) for a, b in zip(best[q], new))
                                top = np.argsort(-new[0], kind="stable")[:n].tolist()
                                new = (new[0][top], [new[1][k] for k in top], [new[2][k] for k in top])
                            best[q] = new
                for q, (scores, ids, kinds_of) in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([names[q]] * len(ids), kinds_of, ids, scores), kinds)], ["query_id", "collection", "entity_id", "score"])

            rows = self.postings().where(F.col("list").isin(list(wanted)))
            out = out.unionByName(rows.select("collection", "entity_id", "code", "list").mapInArrow(search, schema))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int, refine: int = REFINE) -> DataFrame:
        """(query_id, collection, entity_id, score, rank): the k most similar rows of vectors that the index finds, with exact scores; ties by id.

        probes of all lists with a large refine is an exact search. Null, zero and non-finite queries give no row, an empty index none.
        """
        found = self.candidates(queries, k * refine, probes).drop("score")
        asked = queries.select("query_id", F.col("embedding").alias("asked"))
        both = found.join(vectors.select("collection", "entity_id", "embedding"), ["collection", "entity_id"]).join(asked, "query_id")
        scored = both.select("query_id", "collection", "entity_id", V.cosine(F.col("asked"), F.col("embedding")).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def probes_for(self, vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """The fewest probes with which at least this share of the k true neighbours of these queries lies in a probed list.

        queries is a sample that fits the driver. One exact search tells in which list each neighbour lies, and how far down the query's order.
        """
        exact = V.top_k_of_queries(usable(vectors), usable(queries), k).select("query_id", "entity_id")
        lists = exact.join(self.postings().select("entity_id", "list"), "entity_id").select("query_id", "list").collect()
        asked = {r["query_id"]: r["embedding"] for r in usable(queries).select("query_id", "embedding").collect()}
        if not lists:
            return 1
        names = list(asked)
        x = np.array([asked[q] for q in names], np.float64)
        place = np.argsort(self._nearest_lists(x / np.linalg.norm(x, axis=1, keepdims=True)), axis=1)
        at = {q: n for n, q in enumerate(names)}
        depth = np.sort([place[at[r["query_id"]], r["list"]] for r in lists])
        return int(depth[max(0, math.ceil(recall * len(depth)) - 1)]) + 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows (query_id, entity_id) of exact that are in found."""
    hit = exact.select("query_id", "entity_id").join(found.select("query_id", "entity_id").withColumn("hit", F.lit(1)), ["query_id", "entity_id"], "left")
    row = hit.agg(F.count("hit").alias("hits"), F.count("*").alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
