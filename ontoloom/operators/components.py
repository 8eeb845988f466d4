"""Connected components by alternating stars, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.lineage import cut, drop


def _larger(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour, or itself, to its larger neighbours."""
    around = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    smallest = around.groupBy("high").agg(F.least(F.min("low"), F.first("high")).alias("to"))
    return around.where("low > high").join(smallest, "high").select(F.col("low").alias("high"), F.col("to").alias("low"))


def _smaller(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its other smaller ones, and keeps an edge to it."""
    smallest = edges.groupBy("high").agg(F.min("low").alias("to"))
    handed = edges.join(smallest, "high").select(F.col("low").alias("high"), F.col("to").alias("low"))
    return handed.unionByName(smallest.select("high", F.col("to").alias("low")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b: long); a component is named after its smallest node.

    Minima are partial aggregates and the joins can be split, so a node with very many edges isn't gathered in one task. The number of
    rounds grows with the logarithm of the largest component. Loops and null ends are dropped.
    """
    now, before = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")), F.bit_xor(F.xxhash64("low", "high"))).first()
        if mark == before or not mark[0]:
            break
        before, old = mark, now
        now = cut(_smaller(_larger(old).where("high > low").distinct()).where("high > low").distinct())
        drop(old)
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
