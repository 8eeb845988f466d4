"""The driver's tables seen as vectors, entities, relations, events and metric points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.plans.ontology import Constraint, EntityType, Ontology, Property, RelationType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").alias("entity_id"), "embedding")


def vector_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.concat(F.lit("item-"), F.col("vec_id").cast("string")).alias("name"))


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relation types over the vectors' ids: v to (7 v + 1) mod n and v to (3 v + 2) mod n."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"))
    n = ids.count()
    edge = lambda kind, to: ids.select(F.lit(kind).alias("relation_type"), "source_id", to.alias("target_id"))
    return edge("near", (F.col("source_id") * 7 + 1) % n).unionByName(edge("refers", (F.col("source_id") * 3 + 2) % n))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The embedding of one item."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()["embedding"]]


def query_vectors(spark: SparkSession, sf_dir: str, step: int = 100) -> DataFrame:
    """(query_id, embedding) of all items whose id is divisible by step."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, entity_type, name) of regions, nations, customers, suppliers, orders and parts."""
    read = lambda t: table(spark, sf_dir, t)
    parts = [
        read("region").select(_id("region", "r_regionkey").alias("entity_id"), F.lit("Region").alias("entity_type"), F.col("r_name").alias("name")),
        read("nation").select(_id("nation", "n_nationkey"), F.lit("Nation"), "n_name"),
        read("customer").select(_id("customer", "c_custkey"), F.lit("Customer"), "c_name"),
        read("supplier").select(_id("supplier", "s_suppkey"), F.lit("Supplier"), "s_name"),
        read("orders").select(_id("order", "o_orderkey"), F.lit("Order"), F.lit(None).cast("string")),
        read("part").select(_id("part", "p_partkey"), F.lit("Part"), "p_name"),
    ]
    return reduce(DataFrame.union, parts)


#: Rows of a large table for each task that they are dealt over.
SHARE = 1 << 19


def relations(spark: SparkSession, sf_dir: str, share: int | None = None) -> DataFrame:
    """(relation_type, source_id, target_id): IN_REGION, IN_NATION, PLACED, CONTAINS.

    share: for steps that hold what a task has, deals customers, orders and lines, by their keys and before ids are made of these, over as
    many tasks as take so many rows each; smaller tables stay as they are. None leaves all to the files' splits and to Spark, for steps that filter first.
    """
    read = lambda t: table(spark, sf_dir, t)

    def dealt(name: str, *keys: str) -> DataFrame:
        rows = read(name).select(*keys)
        tasks = -(-rows.count() // share) if share else 1  # the count comes from the files' footers
        return rows if tasks <= 1 else rows.repartition(max(tasks, spark.sparkContext.defaultParallelism), *keys)

    parts = [
        read("nation").select(F.lit("IN_REGION").alias("relation_type"), _id("nation", "n_nationkey").alias("source_id"), _id("region", "n_regionkey").alias("target_id")),
        dealt("customer", "c_custkey", "c_nationkey").select(F.lit("IN_NATION"), _id("customer", "c_custkey"), _id("nation", "c_nationkey")),
        read("supplier").select(F.lit("IN_NATION"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")),
        dealt("orders", "o_custkey", "o_orderkey").select(F.lit("PLACED"), _id("customer", "o_custkey"), _id("order", "o_orderkey")),
        dealt("lineitem", "l_orderkey", "l_partkey").distinct().select(F.lit("CONTAINS"), _id("order", "l_orderkey"), _id("part", "l_partkey")),
    ]
    return reduce(DataFrame.union, parts)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as one series per event type."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), ms.alias("timestamp"), "value")


ONTOLOGY = Ontology(
    "trade", "1",
    {
        t.id: t
        for t in (
            EntityType("Thing", properties=(Property("name", "String", True),)),
            EntityType("Party", "Thing"),
            EntityType("Customer", "Party", properties=(Property("balance", "Number", True, "One"), Property("segment", "String")), constraints=(Constraint("ValueRange", {"min": 0, "max": 9000}), Constraint("StringLength", {"max": 18}))),
            EntityType("Supplier", "Party", properties=(Property("balance", "Number", True),)),
            EntityType("Place", "Thing"),
            EntityType("Region", "Place"),
            EntityType("Nation", "Place"),
            EntityType("Order", "Thing"),
            EntityType("Part", "Thing", properties=(Property("size", "String", True),)),
        )
    },
    {
        r.id: r
        for r in (
            RelationType("IN_REGION", "Nation", "Region", transitive=True),
            RelationType("IN_NATION", "Party", "Nation"),
            RelationType("PLACED", "Customer", "Order", inverse="PLACED_BY"),
            RelationType("PLACED_BY", "Order", "Customer"),
            RelationType("CONTAINS", "Order", "Part"),
            RelationType("PARTNER_OF", "Party", "Party", symmetric=True),
        )
    },
)


def property_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and parts with VARIANT properties, for validation."""
    read = lambda t: table(spark, sf_dir, t)
    variant = lambda *pairs: F.parse_json(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in pairs])))
    parts = [
        read("customer").select(_id("customer", "c_custkey").alias("entity_id"), F.lit("Customer").alias("entity_type"), variant(("name", "c_name"), ("balance", "c_acctbal"), ("segment", "c_mktsegment")).alias("properties")),
        read("supplier").select(_id("supplier", "s_suppkey"), F.lit("Supplier"), variant(("name", "s_name"))),
        read("part").select(_id("part", "p_partkey"), F.lit("Part"), variant(("name", "p_name"), ("size", "p_size"))),
        read("region").select(_id("region", "r_regionkey"), F.lit("Continent"), variant(("name", "r_name"))),
    ]
    return reduce(DataFrame.union, parts)
