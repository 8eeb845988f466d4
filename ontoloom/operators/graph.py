"""Bounded traversals over a table of edges (relation_type, source_id, target_id), by one join a level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions import lineage
from ontoloom.functions.lineage import cut


def _steps(relations: DataFrame, types: list[str], direction: str) -> DataFrame:
    if types:
        relations = relations.where(F.col("relation_type").isin(types))
    ends = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    return relations.select(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("to"))


def reach(relations: DataFrame, start: object, depth: int, types: list[str] = (), direction: str = "outgoing", entities: DataFrame | None = None) -> DataFrame:
    """(entity_id, depth) of the nodes within depth steps, the start excluded. Nodes that aren't among entities are neither returned nor passed."""
    steps = _steps(relations, types, direction)
    if entities is not None:
        steps = steps.join(entities.select(F.col("entity_id").alias("to")), "to", "left_semi")
    spark, schema = relations.sparkSession, f"entity_id {steps.schema['at'].dataType.simpleString()}, depth int"
    known, last = {start: 0}, [start]
    for level in range(1, depth + 1):
        rows = steps.where(F.col("at").isin(last)).select("to").where("to is not null").distinct().limit(FEW + 1).collect() if last else []
        if len(known) + len(rows) > FEW:
            break
        last = [r["to"] for r in rows if r["to"] not in known]
        known |= dict.fromkeys(last, level)
    else:
        return spark.createDataFrame([(k, v) for k, v in known.items() if v], schema)
    # Too many for the driver: from this level on, nodes are tables. A frontier of known small size is broadcast by Spark.
    seen = cut(spark.createDataFrame(list(known.items()), schema))
    frontier = seen.where(F.col("depth") == level - 1)
    for k in range(level, depth + 1):
        frontier = cut(_next(steps, frontier).join(seen, "entity_id", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0)


#: Nodes of a traversal that are kept on the driver and sent with the query; a larger one uses tables.
FEW = 1000


def _next(steps: DataFrame, frontier: DataFrame) -> DataFrame:
    """The distinct ends of the steps from a frontier. As a semi-join, it can move below the unions and aggregates that make the edges."""
    return steps.join(frontier.select(F.col("entity_id").alias("at")), "at", "left_semi").select(F.col("to").alias("entity_id")).distinct()


def with_symmetric(relations: DataFrame, symmetric: list[str]) -> DataFrame:
    """Edges, and those of symmetric types turned around as well, so that traversals pass them both ways."""
    edges = relations.select("relation_type", "source_id", "target_id")
    turned = edges.where(F.col("relation_type").isin(symmetric)).select("relation_type", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return edges.unionByName(turned)


def into_set(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose target is one of the entities."""
    return relations.join(entities.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")


def pattern(relations: DataFrame, first: str, second: str) -> DataFrame:
    """(first_id, second_id, third_id): an edge of the first type followed by one of the second."""
    a = relations.where(F.col("relation_type") == first).select(F.col("source_id").alias("first_id"), F.col("target_id").alias("second_id"))
    b = relations.where(F.col("relation_type") == second).select(F.col("source_id").alias("second_id"), F.col("target_id").alias("third_id"))
    return a.join(b, "second_id").select("first_id", "second_id", "third_id")


def paths(relations: DataFrame, start: object, depth: int, types: list[str] = ()) -> DataFrame:
    """(path, entity_id, depth): every path of 1 to depth outgoing steps that meets no node twice; parallel edges give equal paths."""
    steps = _steps(relations, types, "outgoing")
    kind = steps.schema["at"].dataType.simpleString()
    level = relations.sparkSession.createDataFrame([([start], start, 0)], f"path array<{kind}>, entity_id {kind}, depth int")
    found = []
    for k in range(1, depth + 1):
        near = steps.join(level.select(F.col("entity_id").alias("at")), "at", "left_semi")
        longer = near.join(level, F.col("at") == F.col("entity_id")).where(~F.array_contains("path", F.col("to")))
        level = cut(longer.select(F.array_append("path", F.col("to")).alias("path"), F.col("to").alias("entity_id"), F.lit(k).alias("depth")))
        found.append(level)
    return reduce(DataFrame.unionByName, found) if found else level.limit(0)


def numbered(rows: DataFrame, order: list, column: str) -> DataFrame:
    """rows with their place in an order, from 1: sorted by ranges, numbered within each, and moved by the sizes of those before. No task has all rows, unless they are few."""
    rows = lineage.settled(rows)
    if not rows.inputFiles():  # a local table
        return rows.withColumn(column, F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    ranged = cut(ranged.withColumn("_part", F.shiftright(local, 33)).withColumn("_at", local.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per task
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def reach_both(relations: DataFrame, start: object, depth: int, types: list[str] = (), entities: DataFrame | None = None) -> DataFrame:
    """What is reached outgoing, then what is reached incoming; each node where it comes first. Not a walk over undirected edges."""
    both = [reach(relations, start, depth, types, d, entities).withColumn("way", F.lit(k)) for k, d in enumerate(("outgoing", "incoming"))]
    first = Window.partitionBy("entity_id").orderBy("way", "depth")
    return both[0].unionByName(both[1]).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def position_scores(found: DataFrame) -> DataFrame:
    """score = 1 / position in the order (way, depth, id)."""
    keys = [c for c in ("way", "depth", "entity_id") if c in found.columns]
    return numbered(found, keys, "position").withColumn("position", F.col("position").cast("int")).withColumn("score", 1.0 / F.col("position"))


def traverse_multiset(relations: DataFrame, start: object, depth: int, types: list[str] = ()) -> DataFrame:
    """Every edge followed: (entity_id, depth) with repeats, the start included if a cycle leads to it; each node is expanded once."""
    steps = _steps(relations, types, "outgoing")
    nodes = reach(relations, start, depth - 1, types).unionByName(relations.sparkSession.createDataFrame([(start, 0)], f"entity_id {steps.schema['at'].dataType.simpleString()}, depth int"))
    return steps.join(nodes, F.col("at") == F.col("entity_id")).select(F.col("to").alias("entity_id"), (F.col("depth") + 1).alias("depth"))


#: Levels that a closure walks one by one before it looks for chains.
SHALLOW = 6


def _along_chains(start: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """start (entity_id, distinct) and all that chains lead to from there, by jumps over 1, 2, 4, ... links: log2(n) rounds for n links.

    jumps begins with the table (at, to) of the nodes with one next node; longer jumps are added to it when they are needed.
    """
    seen, size, k = start, start.count(), 0
    while True:
        if k == len(jumps):
            last = jumps[-1]
            jumps.append(cut(last.select("at", F.col("to").alias("mid")).join(last.select(F.col("at").alias("mid"), "to"), "mid").select("at", "to")))
        old, seen = seen, cut(seen.unionByName(_next(jumps[k], seen)).distinct())
        if old is not start:
            lineage.drop(old)
        before, size = size, seen.count()
        if size == before:  # what single links reach lies within 2 ** k of them, so nothing is further
            return seen
        k += 1


def closure(relations: DataFrame, start: object, relation_type: str, transitive: bool) -> DataFrame:
    """Nodes reachable by one step or more (the start only on a cycle); direct neighbours for a relation that isn't transitive.

    The first levels are walked one by one. Deeper ones take a round for each branching on the way: chains of nodes with one next node
    each, and cycles of such nodes, are passed by doubled jumps.
    """
    steps = _steps(relations, [relation_type], "outgoing").where("at is not null and to is not null")
    seen = frontier = cut(steps.where(F.col("at") == F.lit(start)).select(F.col("to").alias("entity_id")).distinct())
    for _ in range(SHALLOW):
        if not transitive or frontier.isEmpty():
            return seen
        frontier = cut(_next(steps, frontier).join(seen, "entity_id", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    ends = steps.groupBy("at").agg(F.min("to").alias("to"), F.max("to").alias("last"))
    jumps = [cut(ends.where("to = last").select("at", "to"))]
    forks = cut(steps.join(jumps[0].select("at"), "at", "left_anti").distinct())
    seen = frontier = _along_chains(seen, jumps)
    while True:
        new = cut(_next(forks, frontier).join(seen, "entity_id", "left_anti"))
        if new.isEmpty():
            lineage.drop(forks, *jumps)
            return seen
        frontier = cut(_along_chains(new, jumps).join(seen, "entity_id", "left_anti"))
        old, seen = seen, cut(seen.unionByName(frontier))
        lineage.drop(old)


def degree_summary(relations: DataFrame) -> DataFrame:
    """(relation_type, n_edges, n_sources, n_targets): edges with repeats, distinct ends without nulls.

    One pass with a row for each end. A task joins its equal ends before they are moved, so that a frequent end comes once from each task, but
    it holds all its distinct ends in memory: edges that come in large parts should be dealt over more tasks first.
    """
    ends = F.array(F.struct(F.lit(True).alias("out"), F.col("source_id").alias("id")), F.struct(F.lit(False).alias("out"), F.col("target_id").alias("id")))
    found = relations.select("relation_type", F.inline(ends)).groupBy("relation_type", "out", "id").agg(F.count("*").alias("n"))
    ids = lambda out: F.count(F.when(F.col("out") == out, F.col("id")))
    return found.groupBy("relation_type").agg(F.sum(F.when(F.col("out"), F.col("n"))).alias("n_edges"), ids(True).alias("n_sources"), ids(False).alias("n_targets"))


def ui_graph(agents: DataFrame, tasks: DataFrame, thoughts: DataFrame, relations: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a picture: agents with their tasks, and the thoughts of agents and of tasks.

    agents and tasks: entity_id, name; thoughts: entity_id, step_index, content. nodes: id, kind, label, each id once: all agents, the tasks that belong to
    one, the thoughts with an edge; a thought's label has its step and the first 80 characters. edges: source, target, type, for BELONGS_TO,
    GENERATED_THOUGHT and HAS_THOUGHT whose ends exist. limit: of agents, and of either kind of edges to thoughts, by id; None: all.
    """
    cut_to = lambda rows, *by: rows if limit is None else rows.orderBy(*by).limit(limit)
    of = lambda kind: relations.where(F.col("relation_type") == kind).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type")).distinct()
    among = lambda rows, column, known: rows.join(known.select(F.col("entity_id").alias(column)), column, "left_semi").select("source", "target", "type")
    listed = cut_to(agents, "entity_id")
    belongs = among(among(of("BELONGS_TO"), "target", listed), "source", tasks)
    made = cut_to(among(among(of("GENERATED_THOUGHT"), "source", agents), "target", thoughts), "source", "target")
    had = cut_to(among(among(of("HAS_THOUGHT"), "source", tasks), "target", thoughts), "source", "target")
    own = tasks.join(belongs.select(F.col("source").alias("entity_id")), "entity_id", "left_semi")
    seen = thoughts.join(made.unionByName(had).select(F.col("target").alias("entity_id")), "entity_id", "left_semi")
    label = F.format_string("Step %d: %s", "step_index", F.substring("content", 1, 80))
    nodes = listed.select(F.col("entity_id").alias("id"), F.lit("Agent").alias("kind"), F.col("name").alias("label"))
    nodes = nodes.unionByName(own.select(F.col("entity_id").alias("id"), F.lit("Task").alias("kind"), F.col("name").alias("label")))
    nodes = nodes.unionByName(seen.select(F.col("entity_id").alias("id"), F.lit("Thought").alias("kind"), label.alias("label")))
    return nodes.dropDuplicates(["id"]), belongs.unionByName(made).unionByName(had)
