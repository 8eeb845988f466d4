"""Exact vector search over a table (collection, entity_id, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ontoloom.functions.embedding import Provider, embed_texts
from ontoloom.functions.lineage import cut
from ontoloom.functions.text import cosine, metadata_text, normalise_threshold


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col("embedding"), literal)).where(F.col("score").isNotNull()).drop("embedding")


def top_k(vectors: DataFrame, query: list[float], k: int, collection: object = None) -> DataFrame:
    """The k most similar rows, of one collection if given (one that doesn't exist gives none), ranked from 1; ties by id."""
    if collection is not None:
        vectors = vectors.where(F.col("collection") == F.lit(collection))
    best = scored(vectors, query).orderBy(F.desc("score"), "entity_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "entity_id")))


def top_k_per_collection(vectors: DataFrame, query: list[float], k: int, collections: list | None = None) -> DataFrame:
    """The k most similar rows of each collection."""
    if collections is not None:
        vectors = vectors.where(F.col("collection").isin(collections))
    order = Window.partitionBy("collection").orderBy(F.desc("score"), "entity_id")
    return scored(vectors, query).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_query(vectors: DataFrame, entities: DataFrame, query: list[float], collections: list, limit: int = 10, min_score: float | None = None) -> DataFrame:
    """Top limit of each collection, then the threshold, then the entities (missing ones are dropped), best first, cut to limit.

    total_count is the number of rows before the cut.
    """
    hits = top_k_per_collection(vectors, query, limit, collections)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    found = hits.drop("rank").join(entities, "entity_id")  # limit rows of each collection at most
    found = found.withColumn("total_count", F.count("*").over(Window.partitionBy()))
    order = Window.orderBy(F.desc("score"), "entity_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def similar_to_item(vectors: DataFrame, item_id: object, n: int, threshold: float) -> DataFrame:
    """The n nearest rows of an item of the table, less the item itself, with at least the threshold: n - 1 rows at most."""
    item = vectors.where(F.col("entity_id") == F.lit(item_id)).select("embedding").first()
    if item is None:
        return vectors.select("collection", "entity_id", F.lit(0.0).alias("score")).limit(0)
    return top_k(vectors, item["embedding"], n).where((F.col("entity_id") != F.lit(item_id)) & (F.col("score") >= threshold)).drop("rank")


#: Queries that are sent to all rows at once, and rows that meet them at once.
BLOCK_QUERIES, BLOCK_ROWS = 2048, 512
#: More than a product of unit vectors in any order can be off by.
ROUGH = 1e-9


def _dots(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(query, row) inner products, summed in the order of the dimensions so that equal rows have equal scores."""
    out = np.zeros((len(queries), len(rows)))
    for k in range(rows.shape[1]):
        out += np.multiply.outer(queries[:, k], rows[:, k])
    return out


def _matrix(rows: list[list[float]]) -> np.ndarray:
    if len({len(x) for x in rows}) > 1:
        raise ValueError("dimension mismatch")
    return np.array(rows, np.float64)


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    queries = queries.select("query_id", "embedding").where("query_id is not null and embedding is not null")
    blocks = -(-queries.count() // BLOCK_QUERIES)
    for n in range(blocks):
        if block := queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect():
            yield [tuple(r) for r in block]


def _candidates(vectors: DataFrame, queries: DataFrame, k: int, per_collection: bool) -> DataFrame:
    """(query_id, collection, entity_id, score): the k best rows of each query in each task, or in each task and collection."""
    types = {c: vectors.schema[c].dataType.simpleString() for c in ("collection", "entity_id")}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, collection {types['collection']}, entity_id {types['entity_id']}, score double"
    batch_types = [to_arrow_type(x) for x in (queries.schema["query_id"].dataType, vectors.schema["collection"].dataType, vectors.schema["entity_id"].dataType)]
    out = vectors.sparkSession.createDataFrame([], schema)
    for block in _query_blocks(queries):
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = [q for q, _ in shared.value], _matrix([x for _, x in shared.value])
            norms, kept = np.sqrt((asked * asked).sum(axis=1)), {}
            for batch in batches:
                rows = [r for r in batch.to_pylist() if r["embedding"] is not None]
                for a in range(0, len(rows), BLOCK_ROWS):
                    part = rows[a : a + BLOCK_ROWS]
                    data = _matrix([r["embedding"] for r in part])
                    if data.shape[1] != asked.shape[1]:
                        raise ValueError("dimension mismatch")
                    lengths = np.sqrt((data * data).sum(axis=1))
                    found = (data != 0).any(axis=1)
                    groups: dict = {}
                    for n, r in enumerate(part):
                        if found[n]:
                            groups.setdefault(r["collection"] if per_collection else None, []).append(n)
                    for group, at in groups.items():
                        asks, own = slice(None), data[at]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            if group in kept and kept[group][0].shape[1] == k > 0:
                                # Only queries for which one of these rows may be among the k best are scored in order; a plain product tells.
                                rough = (asked / norms[:, None]) @ (own / lengths[at][:, None]).T
                                asks = np.flatnonzero((~(rough < kept[group][0][:, -1:] - ROUGH)).any(axis=1))
                                if not len(asks):
                                    continue
                            scores = _dots(own, asked[asks]) / np.multiply.outer(norms[asks], lengths[at])
                        ids = np.broadcast_to(np.array([part[n]["entity_id"] for n in at]), scores.shape)
                        of = np.broadcast_to(np.array([part[n]["collection"] for n in at], object), ids.shape)
                        new = [scores, ids, of]
                        if group in kept:
                            new = [np.concatenate((x[asks], y), axis=1) for x, y in zip(kept[group], new)]
                        order = np.lexsort((new[1], -new[0]), axis=1)[:, :k]
                        new = [np.take_along_axis(x, order, 1) for x in new]
                        if isinstance(asks, slice):
                            kept[group] = new
                        else:
                            # Text ids may be longer than those kept so far.
                            kept[group] = [x.astype(np.promote_types(x.dtype, y.dtype), copy=False) for x, y in zip(kept[group], new)]
                            for x, y in zip(kept[group], new):
                                x[asks] = y
            for scores, ids, of in kept.values():
                for n in np.flatnonzero(norms > 0).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([names[n]] * ids.shape[1], batch_types[0]), pa.array(of[n].tolist(), batch_types[1]), pa.array(ids[n].tolist(), batch_types[2]), pa.array(scores[n])], names=["query_id", "collection", "entity_id", "score"])

        out = out.unionByName(vectors.select("collection", "entity_id", "embedding").mapInArrow(search, schema))
    return out


def top_k_of_queries(vectors: DataFrame, queries: DataFrame, k: int, per_collection: bool = False) -> DataFrame:
    """(query_id, collection, entity_id, score, rank): top_k, or top_k_per_collection, for every row of queries (query_id, embedding), whose ids differ.

    Each task keeps its k best rows of each query before they are shuffled. Null and zero vectors on either side give no row; ids
    of entities aren't null; unequal dimensions are an error.
    """
    keys = ["query_id", "collection"] if per_collection else ["query_id"]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "entity_id")
    return _candidates(vectors, queries, k, per_collection).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_query_of_queries(vectors: DataFrame, entities: DataFrame, queries: DataFrame, collections: list, limit: int = 10, min_score: float | None = None) -> DataFrame:
    """vector_query for every row of queries (query_id, embedding); total_count and rank are those of each query."""
    hits = top_k_of_queries(vectors.where(F.col("collection").isin(collections)), queries, limit, per_collection=True)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    found = hits.drop("rank").join(entities, "entity_id")
    found = found.withColumn("total_count", F.count("*").over(Window.partitionBy("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def similar_to_items(vectors: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """similar_to_item for every row of items (query_id, embedding), whose ids are those of the items."""
    return top_k_of_queries(vectors, items, n).where((F.col("entity_id") != F.col("query_id")) & (F.col("score") >= threshold)).drop("rank")


def filtered_top_k(vectors: DataFrame, entities: DataFrame, query: list[float], k: int) -> DataFrame:
    """top_k among the given entities only, such as those whose metadata pass a filter; the filter comes before the ranking."""
    return top_k(vectors.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").select("collection", "entity_id", "embedding"), query, k)


def similar_before_insert(vectors: DataFrame, entities: DataFrame, new: DataFrame, n: int, threshold: float) -> DataFrame:
    """(query_id, collection, entity_id, score, and the entity's columns): for each new row (query_id, embedding) its n nearest known rows with at least the threshold."""
    return top_k_of_queries(vectors, new, n).where(F.col("score") >= threshold).drop("rank").join(entities, "entity_id")


def similar_with_edges(vectors: DataFrame, relations: DataFrame, query: list[float], threshold: float) -> DataFrame:
    """(collection, entity_id, score, edges): all rows with at least the threshold, and their outgoing edges (relation_type, target_id) in order; none is an empty list."""
    hits = scored(vectors, query).where(F.col("score") >= threshold)
    near = relations.join(hits.select(F.col("entity_id").alias("source_id")).distinct(), "source_id", "left_semi")
    lists = near.groupBy(F.col("source_id").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("relation_type", "target_id"))).alias("edges"))
    return hits.join(lists, "entity_id", "left").withColumn("edges", F.coalesce("edges", F.array()))


def with_inferred(hits: DataFrame, inferred: DataFrame) -> DataFrame:
    """Hits (entity_id, type, ...) with the relations that the ontology infers for their types (type, relation, source, target, reason); types without any give no row."""
    return hits.join(inferred, "type")


def collection_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("collection").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dimension"))


#: How many rows a search by metadata returns and how similar they are at least, unless told otherwise; and the fields it shows.
METADATA_LIMIT, METADATA_THRESHOLD = 10, 0.65
SHOWN = ("role", "goal", "backstory", "description", "expected_output")


def similar_by_metadata(items: DataFrame, asked: DataFrame, provider: Provider, limit: int = METADATA_LIMIT, threshold: float = METADATA_THRESHOLD) -> DataFrame:
    """(query_id, entity_id, similarity, role, goal, backstory, description, expected_output) for rows asked (query_id, metadata) among items (entity_id, metadata).

    Both are compared by the vectors of their metadata's text: the limit nearest items, of these the ones with at least the threshold, as a share or
    in percent. Metadata without text, or with a zero vector, ask nothing and are never found. Ids of either side differ.
    """
    text = metadata_text(F.col("metadata")).alias("text")
    shown = [F.try_element_at("metadata", F.lit(k)).alias(k) for k in SHOWN]
    # Written once: every block of queries reads them.
    known = cut(embed_texts(items.select(F.lit(0).alias("collection"), "entity_id", text).where("text <> ''"), provider).select("collection", "entity_id", "embedding"))
    sought = cut(embed_texts(asked.select("query_id", text).where("text <> ''"), provider).select("query_id", "embedding"))
    hits = top_k_of_queries(known, sought, limit)
    hits = hits.where(F.col("score") >= normalise_threshold(F.lit(float(threshold))))
    return hits.join(items.select("entity_id", *shown), "entity_id").select("query_id", "entity_id", F.col("score").alias("similarity"), *SHOWN)
