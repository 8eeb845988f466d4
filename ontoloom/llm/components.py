"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large: both directions, larger neighbours move to the smallest one. Small: the smaller neighbours do."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = around.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long): the component is its smallest node.

    Loops, repeated edges, both directions and nulls are allowed (nulls and loops are dropped). The minimum of a
    node's neighbours is a partial aggregate, and the join that hands it out can be split, so a node with very many
    neighbours isn't gathered in one task. Each round is written to the shared folder; the number of rounds
    grows with the logarithm of the size of the largest component.
    """
    now = Saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum("v").cast("string").alias("s")).first()
        if state == seen or not state["n"]:
            break
        seen, old = state, now
        now = Saved(_star(_star(old.df, True), False), "edges")
        old.delete()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
