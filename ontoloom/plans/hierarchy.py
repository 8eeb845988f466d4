"""Ontologies of any size as tables: types (id, parent), relation types (id, domain, range, inverse, symmetric). plans.ontology is the form for small ones.

Each type has one parent at most. Ancestors come from pointer doubling: a table of jumps over 1, 2, 4, ... steps, and a closure that each round
extends by the next jump, so a chain of n types takes log2(n) rounds. A parent that isn't defined is an ancestor by its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.lineage import cut, drop


def _parents(types: DataFrame) -> DataFrame:
    return types.where("parent IS NOT NULL").select(F.col("id").alias("sub"), F.col("parent").alias("super"))


def closure(types: DataFrame) -> DataFrame:
    """(sub, super, depth): each type with itself at 0 and its ancestors at their distance, nearest first by depth.

    On a cycle each other member counts once, at its first distance. Ids differ; a row without id is dropped.
    """
    types = types.where("id IS NOT NULL")
    jump = cut(_parents(types).where("sub <> super"))
    found, step = cut(types.select(F.col("id").alias("sub"), F.col("id").alias("super"), F.lit(0).alias("depth"))), 1
    limit = types.count()
    while not jump.isEmpty() and step <= 2 * limit:
        # All ancestors at distances step to 2 * step - 1 are those below `step` of what a jump leads to.
        hop = jump.select("sub", F.col("super").alias("mid"))
        further = hop.join(found.select(F.col("sub").alias("mid"), "super", "depth"), "mid").select("sub", "super", (F.col("depth") + step).alias("depth"))
        missing = hop.join(types.select(F.col("id").alias("mid")), "mid", "left_anti").select("sub", F.col("mid").alias("super"), F.lit(step).alias("depth"))
        every = found.unionByName(further).unionByName(missing)
        old_found, old_jump = found, jump
        found = cut(every.groupBy("sub", "super").agg(F.min("depth").alias("depth")))
        jump = cut(hop.join(jump.select(F.col("sub").alias("mid"), "super"), "mid").select("sub", "super"))
        drop(old_found, old_jump)
        step *= 2
    return found


def on_cycles(types: DataFrame) -> DataFrame:
    """(id) of the types from which the parents never end, because they come to a cycle."""
    jump, n, step = cut(_parents(types)), types.count(), 1
    while step < n + 1 and not jump.isEmpty():
        old, jump = jump, cut(jump.select("sub", F.col("super").alias("mid")).join(jump.select(F.col("sub").alias("mid"), "super"), "mid").select("sub", "super"))
        drop(old)
        step *= 2
    return jump.select(F.col("sub").alias("id"))


def errors(types: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id, name): a cycle above a type, a missing parent, an unknown domain, range or inverse; all of them, where plans.ontology raises the first."""
    known = types.select(F.col("id").alias("name")).distinct()
    lacks = lambda rows, kind, column, of: rows.where(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), "id", F.col(column).alias("name")).join(of, "name", "left_anti").select("kind", "id", "name")
    out = on_cycles(types).select(F.lit("cycle").alias("kind"), "id", F.lit(None).cast("string").alias("name"))
    for rows, kind, column, of in ((types, "missing parent", "parent", known), (relations, "unknown domain", "domain", known), (relations, "unknown range", "range", known), (relations, "unknown inverse", "inverse", relations.select(F.col("id").alias("name")))):
        out = out.unionByName(lacks(rows, kind, column, of))
    return out


def inferred(closed: DataFrame, relations: DataFrame) -> DataFrame:
    """(type, relation, source, target, reason) of all types: the relations whose domain is the type or above it, reversed if symmetric, and their inverses."""
    met = relations.join(closed.select(F.col("sub").alias("type"), F.col("super").alias("domain")), "domain")
    s = lambda rel, a, b, why: F.struct(rel.alias("relation"), a.alias("source"), b.alias("target"), F.lit(why).alias("reason"))
    made = F.array(
        s(F.col("id"), F.col("type"), F.col("range"), "SubtypeInheritance"),
        F.when(F.col("symmetric"), s(F.col("id"), F.col("range"), F.col("type"), "Symmetric")),
        F.when(F.col("inverse").isNotNull(), s(F.col("inverse"), F.col("range"), F.col("type"), "Inverse")),
    )
    return met.select("type", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select("type", "i.*")


def expansions(closed: DataFrame, relations: DataFrame) -> DataFrame:
    """(type, type_count, relation_count) of every type: how many types it stands for in a query, itself included, and how many relations are inferred for it."""
    types = closed.groupBy(F.col("super").alias("type")).agg(F.count("*").alias("type_count"))
    defined = closed.where("depth = 0").select(F.col("sub").alias("type"))
    counts = inferred(closed, relations).groupBy("type").agg(F.count("*").alias("relation_count"))
    return defined.join(types, "type").join(counts, "type", "left").select("type", "type_count", F.coalesce("relation_count", F.lit(0)).alias("relation_count"))


#: Types on one side of a block of `compatible`, and of a slice of a block: a task gets pairs of blocks, and makes the rows of two slices at once.
BLOCK, SLICE = 2048, 64


def _meetings(closed: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, sources, targets): for each relation and pair of slices below its domain and its range, the types in both; pairs of blocks are dealt out."""
    wanted = relations.where("domain is not null and range is not null").select("domain", "range", "id")
    ends = wanted.select(F.col("domain").alias("super")).unionByName(wanted.select(F.col("range").alias("super"))).distinct()
    below = cut(closed.join(ends, "super", "left_semi").select("super", "sub"))
    sizes = below.groupBy("super").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = below.join(sizes, "super").select("super", "sub", F.pmod(F.xxhash64("sub"), F.col("blocks")).alias("block"), F.pmod(F.hash("sub"), F.lit(-(-BLOCK // SLICE))).alias("slice"))
    slices = cut(placed.groupBy("super", "block", "slice").agg(F.collect_list("sub").alias("subs")))
    blocks = slices.select("super", "block").distinct()
    of = lambda rows, end: rows.select(F.col("super").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in rows.columns if c != "super"))
    plan = cut(wanted.join(of(blocks, "domain"), "domain").join(of(blocks, "range"), "range").withColumn("pair", F.monotonically_increasing_id()))
    tasks = max(1, min(plan.count(), 2000))

    def side(end: str, name: str) -> DataFrame:
        own = plan.select("pair", "id", end, f"{end}_block").join(of(slices, end), [end, f"{end}_block"])
        return own.select("pair", *["id"] * (end == "domain"), F.col(f"{end}_subs").alias(name)).repartition(tasks, "pair")

    # A merge join hands on two slices at a time. All rows that an explode makes of one row are held at once.
    return side("domain", "sources").join(side("range", "targets").hint("merge"), "pair").select("id", "sources", "targets")


def compatible(closed: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_type, target_type, relation_type) for all that the relations' domains and ranges allow.

    The result has as many rows as the subtypes of a domain times those of its range. Both sides are dealt in blocks of BLOCK types, so that a
    relation with many pairs is made by many tasks, and meet in slices of about SLICE types, so that a task holds few pairs.
    """
    pairs = _meetings(closed, relations)
    return pairs.select("id", "targets", F.explode("sources").alias("source_type")).select("source_type", F.explode("targets").alias("target_type"), F.col("id").alias("relation_type"))


def functional_repeats(facts: DataFrame, functional: DataFrame) -> DataFrame:
    """(source_id, relation_type, n) of sources with more than one target by a relation type in functional (id)."""
    return facts.join(functional.select(F.col("id").alias("relation_type")), "relation_type", "left_semi").groupBy("source_id", "relation_type").agg(F.countDistinct("target_id").alias("n")).where("n > 1")


def expand_relations(relations: DataFrame, extended: bool = False) -> DataFrame:
    """(relation, stands_for): what each relation type stands for in a query: itself, and if extended the relation types that it is the inverse of or that are its inverse."""
    own = relations.select(F.col("id").alias("relation"), F.col("id").alias("stands_for"))
    if not extended:
        return own
    pairs = relations.where("inverse IS NOT NULL")
    there, back = pairs.select(F.col("id").alias("relation"), F.col("inverse").alias("stands_for")), pairs.select(F.col("inverse").alias("relation"), F.col("id").alias("stands_for"))
    return own.unionByName(there).unionByName(back).distinct()
