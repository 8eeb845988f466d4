"""Tables as append logs: latest version, tombstones, endpoint checks, listing, ingestion of events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last version of each key: an update replaces the whole row."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def delete(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows without those whose keys are deleted. Relations to deleted entities stay."""
    return rows.join(tombstones.select(key), key, "left_anti")


def with_accepted(relations: DataFrame, entities: DataFrame, source: Column | None = None, target: Column | None = None) -> DataFrame:
    """relations with `accepted`: whether both ends exist. source and target are the ends' ids where they aren't the columns source_id and target_id."""
    ids = entities.where("entity_id is not null").select("entity_id").distinct()
    out = relations
    for end, column in (("source", source), ("target", target)):
        known = ids.select(F.col("entity_id").alias(f"_{end}"), F.lit(True).alias(f"_has_{end}"))
        column = F.col(f"{end}_id") if column is None else column
        out = out.join(known, column == F.col(f"_{end}"), "left").drop(f"_{end}")
    return out.withColumn("accepted", F.coalesce(F.col("_has_source") & F.col("_has_target"), F.lit(False))).drop("_has_source", "_has_target")


def check_endpoints(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): both ends of an accepted relation exist. with_accepted gives both in one pass."""
    rows = with_accepted(relations, entities)
    return rows.where("accepted").drop("accepted"), rows.where("not accepted").drop("accepted")


def insert_new(rows: DataFrame, existing: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """existing and, of rows, the first with each key that it lacks in the given order (by all columns if none is given); nothing is overwritten."""
    first = latest(rows, key, order or [F.col(c) for c in sorted(rows.columns)])
    return existing.unionByName(first.join(existing.select(key), key, "left_anti"))


def _orderable(rows: DataFrame) -> list[Column]:
    """Columns by which rows can be put in order, by name."""
    return [F.col(f"`{c}`") for c in sorted(rows.columns) if not any(t in rows.schema[c].dataType.simpleString() for t in ("map<", "variant"))]


def create_entities(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, rejected): rows appended with one clock for created_at and updated_at. Ids that exist already are rejected, and so are all rows of an id in the batch but the first, by all columns."""
    now = F.current_timestamp()
    w = Window.partitionBy("entity_id").orderBy(*_orderable(rows))
    placed = rows.withColumn("_k", F.row_number().over(w))
    known = existing.select("entity_id")
    new = placed.where("_k = 1").drop("_k").join(known, "entity_id", "left_anti").withColumns({"created_at": now, "updated_at": now})
    rejected = placed.where("_k = 1").join(known, "entity_id", "left_semi").unionByName(placed.where("_k > 1")).drop("_k")
    return existing.unionByName(new, allowMissingColumns=True), rejected


def upsert_vectors(existing: DataFrame, new: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, rejected) for vectors (collection, entity_id, embedding): a new one replaces the old; its collection must exist. new has one row for each id."""
    known = new.join(collections.select("collection"), "collection", "left_semi")
    kept = existing.join(known.select("collection", "entity_id"), ["collection", "entity_id"], "left_anti")
    return kept.unionByName(known), new.join(collections.select("collection"), "collection", "left_anti")


def merge_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing without repeats of (source, type, target), and of new the first of each that it lacks; an existing edge keeps its properties. First: by all columns."""
    keys = ["source_id", "relation_type", "target_id"]
    first = lambda rows: rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*_orderable(rows)))).where("_k = 1").drop("_k")
    return first(existing).unionByName(first(new).join(existing.select(*keys), keys, "left_anti"))


def get(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows with the given ids; unknown ids give none."""
    return rows.where(F.col(key).isin(ids))


def put_schema(schemas: DataFrame, new: DataFrame) -> DataFrame:
    """Schemas (namespace, created_at, ...) with the new ones in place of older ones of the same namespace."""
    return latest(schemas.unionByName(new), "namespace", [F.desc("created_at")])


def list_by_label(entities: DataFrame, label: str, order: str, limit: int) -> DataFrame:
    """The first entities of a type by a column, ties by id."""
    return entities.where(F.col("entity_type") == label).orderBy(order, "entity_id").limit(limit)


def page(rows: DataFrame, key: str, skip: int, limit: int) -> DataFrame:
    """Rows skip + 1 to skip + limit in the order of the key."""
    return rows.orderBy(key).offset(skip).limit(limit)


def latest_schema(schemas: DataFrame) -> DataFrame:
    """The newest row of (namespace, version, body, created_at)."""
    return schemas.orderBy(F.desc("created_at"), F.desc("namespace")).limit(1)


def assign_sessions(events: DataFrame) -> DataFrame:
    """Set-based trace assignment: the given trace_id, else one trace per session, started by its earliest event.

    events: event_id, ts, session_id, agent_id, trace_id. Events without either get a trace of their own. The
    sequential rules, with agents and the one-hour limit, are in streaming.traces.
    """
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    opener = F.concat(F.lit("trace:"), F.first("event_id").over(w).cast("string"))
    inside = events.where(F.col("session_id").isNotNull()).withColumn("trace_id", F.coalesce("trace_id", opener))
    own = F.concat(F.lit("trace:"), F.col("event_id").cast("string"))
    return inside.unionByName(events.where(F.col("session_id").isNull()).withColumn("trace_id", F.coalesce("trace_id", own)))


@dataclass(frozen=True)
class IngestOptions:
    auto_create_traces: bool = True
    generate_embeddings: bool = True


def ingest_options(given: dict | None) -> IngestOptions:
    """Options of a batch: fields that are left out are true, but without any options at all both are false."""
    return IngestOptions(False, False) if given is None else IngestOptions(**given)


def ingest_report(events: DataFrame, auto_create: bool = True) -> DataFrame:
    """events with ok and error: without a trace id where none may be made a row fails, even if its session has a trace; so does one without a timestamp."""
    error = F.when(F.col("ts").isNull(), "missing timestamp")
    if not auto_create:
        session = F.col("session_id") if "session_id" in events.columns else F.lit(None)
        lost = F.when(session.isNotNull(), "Trace not found and auto-create disabled").otherwise("No trace specified and auto-create disabled")
        error = F.coalesce(error, F.when(F.col("trace_id").isNull(), F.concat(F.lit("Failed to get/create trace: "), lost)))
    return events.withColumn("error", error).withColumn("ok", F.col("error").isNull())


def bulk_result(report: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, traces, errors) of reported rows (index, trace_id, ok, error): ingested and failed; trace ids by their first index; errors by index."""
    counts = report.agg(F.count_if("ok").alias("ingested"), F.count_if(~F.col("ok")).alias("failed"))
    traces = report.where("ok").groupBy("trace_id").agg(F.min("index").alias("first_index"))
    return counts, traces, report.where(~F.col("ok")).select("index", "error")


def event_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) that a write of assigned events appends: the event, and an edge 'contains' from its trace."""
    event, trace = F.concat(F.lit("agent_event:"), F.col("event_id").cast("string")), F.concat(F.lit("agent_trace:"), "trace_id")
    entities = events.select(event.alias("entity_id"), F.lit("agent_event").alias("entity_type"), "trace_id", "properties")
    return entities, events.select(F.lit("contains").alias("relation_type"), trace.alias("source_id"), event.alias("target_id"))


#: The one collection for vectors of events.
EVENTS_COLLECTION = "agent_events"


def event_vectors(events: DataFrame, text: Column, embed: Callable[[Column], Column]) -> DataFrame:
    """(collection, entity_id, embedding) of the events whose text isn't empty."""
    rows = events.select(F.col("event_id").cast("string").alias("entity_id"), text.alias("text")).where("text <> ''")
    return rows.select(F.lit(EVENTS_COLLECTION).alias("collection"), "entity_id", embed(F.col("text")).alias("embedding"))


def linked_rows(items: DataFrame, agents: DataFrame, tasks: DataFrame, made: str, has: str) -> tuple[DataFrame, DataFrame]:
    """(items, relations) of logs or thoughts (item_id, agent_id, task_id, ...): an edge from the agent, and one from the task; only from those that exist.

    made and has: GENERATED_LOG and HAS_LOG, or GENERATED_THOUGHT and HAS_THOUGHT. The item is written in any case.
    """
    by = lambda kind, c, known: items.join(known.select(F.col("entity_id").alias(c)), c, "left_semi").select(F.lit(kind).alias("relation_type"), F.col(c).alias("source_id"), F.col("item_id").alias("target_id"))
    return items, by(made, "agent_id", agents).unionByName(by(has, "task_id", tasks)).distinct()


def drop_replays(events: DataFrame, key: str = "log_id") -> DataFrame:
    """The first event of each log id."""
    return latest(events, key, [F.col("ts"), F.col("event_id")])


def recent_streams(logs: DataFrame) -> DataFrame:
    """Streams by their last event, most recent first."""
    return logs.groupBy("log_group", "log_stream").agg(F.max("timestamp").alias("last_event"), F.count("*").alias("n")).orderBy(F.desc("last_event"), "log_stream")
