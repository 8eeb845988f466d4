"""Fusion of vector and graph results: tables (entity_id, score), both without repeats."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.lineage import settled
from ontoloom.operators import graph as G
from ontoloom.operators import vector as V

RRF_K = 60

#: Other names that clients use for the strategies.
ALIASES = {"vector_prioritized": "vector_priority", "graph_prioritized": "graph_priority"}


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rn, the rank by score; a rank or position that they have already is taken over."""
    for known in ("rank", "position"):
        if known in rows.columns:
            return rows.withColumn("rn", F.col(known))
    return G.numbered(rows, [F.desc("score"), F.col("entity_id")], "rn")


def fuse(vector: DataFrame, graph: DataFrame, strategy: str = "rank_fusion") -> DataFrame:
    """(entity_id, score, source) by one of union, intersection, rank_fusion, vector_priority, graph_priority, vector_only, graph_only.

    union: the mean for common ids. intersection: common ids with the vector's score. rank_fusion: the sum of 1 / (60 + rank). vector_priority:
    all vector rows. graph_priority: all graph rows, with the vector's score where there is one. vector_only, graph_only: one side as it is.
    """
    strategy = ALIASES.get(strategy, strategy)
    if strategy in ("vector_only", "graph_only"):
        side = strategy.removesuffix("_only")
        return (vector if side == "vector" else graph).select("entity_id", "score", F.lit(side).alias("source"))
    v = vector.select("entity_id", F.col("score").alias("vs"))
    g = graph.select("entity_id", F.col("score").alias("gs"))
    both = F.col("vs").isNotNull() & F.col("gs").isNotNull()
    if strategy == "rank_fusion":
        sides = [_ranked(x).select("entity_id", (1.0 / (RRF_K + F.col("rn"))).alias("part")) for x in (vector, graph)]
        return sides[0].unionByName(sides[1]).groupBy("entity_id").agg(F.sum("part").alias("score")).withColumn("source", F.lit("hybrid"))
    how, score, keep = {
        "union": ("full_outer", F.when(both, (F.col("vs") + F.col("gs")) / 2).otherwise(F.coalesce("vs", "gs")), None),
        "intersection": ("inner", F.col("vs"), None),
        "vector_priority": ("left", F.col("vs"), None),
        "graph_priority": ("right", F.coalesce("vs", "gs"), None),
    }[strategy]
    source = F.when(both, "hybrid").when(F.col("vs").isNotNull(), "vector").otherwise("graph")
    return v.join(g, "entity_id", how).select("entity_id", score.alias("score"), source.alias("source"))


def finish(fused: DataFrame, limit: int) -> DataFrame:
    """Best first, ties by id, with the count before the cut to limit."""
    fused = settled(fused)
    best = fused.orderBy(F.desc("score"), "entity_id").limit(limit)  # only these are ranked in one task
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "entity_id")))
    return ranked.crossJoin(F.broadcast(fused.agg(F.count("*").alias("total_count"))))  # one row


@dataclass(frozen=True)
class VectorQuery:
    query: list[float]
    collections: list = field(default_factory=list)  # none are searched if it is empty
    limit: int = 10
    min_score: float | None = None


@dataclass(frozen=True)
class GraphQuery:
    start: object
    relation_types: list[str] = field(default_factory=list)
    depth: int = 2
    direction: str = "outgoing"


@dataclass(frozen=True)
class HybridQuery:
    vector: VectorQuery
    graph: GraphQuery | None = None
    strategy: str = "rank_fusion"


def graph_query(relations: DataFrame, entities: DataFrame, q: GraphQuery) -> DataFrame:
    if q.direction == "both":
        found = G.reach_both(relations, q.start, q.depth, q.relation_types, entities)
    else:
        found = G.reach(relations, q.start, q.depth, q.relation_types, q.direction, entities)
    return G.position_scores(found)


def hybrid(vectors: DataFrame, entities: DataFrame, relations: DataFrame, q: HybridQuery) -> DataFrame:
    """The vector part, the graph part from its own start, fused and cut to the vector part's limit. Without a graph part, the vector result as it is."""
    hits = V.vector_query(vectors, entities, q.vector.query, q.vector.collections, q.vector.limit, q.vector.min_score)
    if q.graph is None:
        return hits.select("entity_id", "score", F.lit("vector").alias("source"), "total_count", "rank")
    return finish(fuse(hits, graph_query(relations, entities, q.graph), q.strategy), q.vector.limit)
