"""Trace assignment as joins: which event opens each session's trace, and which trace every event belongs to.

The rules, in the order of (ts_ms, event_id): a given trace id stands. An event without session starts a trace, of session "default". An event
with a session belongs to the newest trace of that session, whichever agent started it; else to its agent's newest trace that started less than an
hour before; else it opens a trace of its session. So a session has one opener at most, and what is open is who it is: its first event
that no trace of its agent covers. Only traces of the last hour count, so an agent's events meet in buckets of an hour and never as a
whole history. Openers that no undecided event precedes are decided at once, in a few rounds; events that still wait for each other
are walked through in order, by connected components of agents' hours and sessions, as a sorted stream that holds open sessions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.lineage import cut, drop
from ontoloom.operators.components import components

HOUR_MS = 3_600_000
#: Rounds of joins before the rest is walked through.
ROUNDS = 3
#: The session of traces that events without session start.
DEFAULT = "default"


def _at(ts: str = "ts_ms", event: str = "event_id") -> Column:
    return F.struct(F.col(ts).alias("ts_ms"), F.col(event).alias("event_id"))


def covered(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows (agent_id, ts_ms, event_id, ...) with `by`: the agent's newest of starts (agent_id, ts_ms, event_id) that comes before and less than an hour ago, null if there is none."""
    bucket = F.floor(F.col("ts_ms") / HOUR_MS)
    known = starts.where("agent_id IS NOT NULL").select("agent_id", "ts_ms", "event_id", F.explode(F.array(bucket, bucket + 1)).alias("hour"))
    asked = rows.withColumn("hour", bucket)
    both = asked.withColumn("asks", F.lit(True)).unionByName(known.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    # At equal places the row that asks comes first, so that an event isn't covered by itself.
    before = Window.partitionBy("agent_id", "hour").orderBy("ts_ms", "event_id", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.last(F.when(~F.col("asks"), _at()), ignorenulls=True).over(before)
    found = both.withColumn("by", newest).where("asks").drop("asks", "hour")
    return found.withColumn("by", F.when(F.col("agent_id").isNotNull() & (F.col("by.ts_ms") > F.col("ts_ms") - HOUR_MS), F.col("by")))


def _newest_default(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows with `default`: the newest of starts before them, at any distance. Buckets of an hour, and one row per hour for what came before."""
    bucket = F.floor(F.col("ts_ms") / HOUR_MS)
    both = rows.withColumn("asks", F.lit(True)).unionByName(starts.select("ts_ms", "event_id").withColumn("asks", F.lit(False)), allowMissingColumns=True).withColumn("hour", bucket)
    start = F.when(~F.col("asks"), _at())
    inside = F.last(start, ignorenulls=True).over(Window.partitionBy("hour").orderBy("ts_ms", "event_id", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1))
    hours = both.groupBy("hour").agg(F.max(start).alias("last"))
    hours = hours.select("hour", F.last("last", ignorenulls=True).over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))  # a row per hour
    return both.withColumn("inside", inside).where("asks").join(hours, "hour").withColumn("default", F.coalesce("inside", "earlier")).drop("asks", "hour", "inside", "earlier")


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Openers among rows (component, session_id, agent_id, ts_ms, event_id) that are sorted by component and time."""
    component, opened, latest = None, set(), {}
    for batch in batches:
        out = []
        for c, session, agent, ts, event in batch.itertuples(index=False):
            if c != component:
                component, opened, latest = c, set(), {}
            if session in opened or (isinstance(agent, str) and latest.get(agent, ts - HOUR_MS) > ts - HOUR_MS):
                continue
            opened.add(session)
            if isinstance(agent, str):
                latest[agent] = ts
            out.append((session, agent, ts, event))
        yield pd.DataFrame(out, columns=["session_id", "agent_id", "ts_ms", "event_id"])


def openers(waiting: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(session_id, agent_id, ts_ms, event_id) of the openers among waiting, the events with sessions that no trace of an event without session covers."""
    columns = ["session_id", "agent_id", "ts_ms", "event_id"]
    left, known = cut(waiting.select(*columns)), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        first = left.groupBy("session_id").agg(F.min(_at()).alias("first"))
        marked = cut(covered(left, left).join(first, "session_id"))
        # Whoever comes first in a session, with nothing undecided of its agent in the hour before, opens it.
        new = cut(marked.where(F.col("by").isNull() & (F.col("first") == _at())).select(*columns))
        known.append(new)
        rest = left.join(new.select("session_id"), "session_id", "left_anti")
        old, left = left, cut(covered(rest, new).where("by IS NULL").select(*columns))
        drop(old, marked)
    if not left.isEmpty():
        place = F.xxhash64(F.lit("agent"), "agent_id", F.floor(F.col("ts_ms") / HOUR_MS))
        hours = left.where("agent_id IS NOT NULL")
        edges = hours.select(F.xxhash64(F.lit("session"), "session_id").alias("a"), place.alias("b"))
        edges = edges.unionByName(hours.select(place.alias("a"), F.xxhash64(F.lit("agent"), "agent_id", F.floor(F.col("ts_ms") / HOUR_MS) + 1).alias("b")))  # an hour without events links nothing, as it has no edge of its own to the next
        found = components(edges)
        named = left.withColumn("node", F.xxhash64(F.lit("session"), "session_id")).join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), *columns)
        known.append(named.repartition("component").sortWithinPartitions("component", "ts_ms", "event_id").mapInPandas(walk, waiting.select(*columns).schema))
    out = waiting.select(*columns).limit(0)
    for x in known:
        out = out.unionByName(x)
    return out


#: Traces: who opened them, and when; a trace's name is trace:<event_id>.
TRACES = "session_id string, agent_id string, ts_ms long, event_id long"


def resolve(events: DataFrame, before: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(assigned, new traces) for events (agent_id, event_id, ts_ms, session_id, trace_id) that all come after the traces before (see TRACES).

    assigned: agent_id, event_id, ts_ms, session_id, trace_id, created, by the rules above. Ids of events differ, and times aren't null. A session may
    belong to any agents, or to none. A group is an agent's hour or a session's openers.
    """
    spark = events.sparkSession
    e = cut(events.select("agent_id", "event_id", "ts_ms", "session_id", "trace_id"))
    before = before if before is not None else spark.createDataFrame([], TRACES)
    own = F.concat(F.lit("trace:"), F.col("event_id").cast("string"))
    given = e.where("trace_id IS NOT NULL").withColumn("created", F.lit(False))
    alone = e.where("trace_id IS NULL AND session_id IS NULL")
    asking = e.where("trace_id IS NULL AND session_id IS NOT NULL").drop("trace_id")
    made = alone.select(F.lit(DEFAULT).alias("session_id"), "agent_id", "ts_ms", "event_id").unionByName(before)
    # Traces of session "default" are all those that events without session start, so its events wait only before the first of them.
    first_default = made.where(F.col("session_id") == DEFAULT).agg(F.min(_at()).alias("first"))  # one row
    begun = before.where(F.col("session_id") != DEFAULT).groupBy("session_id").agg(F.max(_at()).alias("opener"))
    waits = covered(asking.join(begun.select("session_id"), "session_id", "left_anti"), made).where("by IS NULL").crossJoin(F.broadcast(first_default))
    waits = waits.where((F.col("session_id") != DEFAULT) | F.col("first").isNull() | (_at() < F.col("first")))
    opening = cut(openers(waits, rounds))
    starts = made.unionByName(opening)
    of_session = opening.select("session_id", _at().alias("opener")).unionByName(begun)
    placed = covered(asking.join(of_session, "session_id", "left"), starts)
    normal = placed.where(F.col("session_id") != DEFAULT).withColumn("newest", F.when(F.col("opener") <= _at(), F.col("opener")))
    odd = _newest_default(placed.where(F.col("session_id") == DEFAULT), starts.where(F.col("session_id") == DEFAULT))
    odd = odd.withColumn("newest", F.coalesce(F.when(F.col("opener") == _at(), F.col("opener")), F.col("default"))).drop("default")
    trace = F.concat(F.lit("trace:"), F.coalesce("newest.event_id", "by.event_id").cast("string"))
    chosen = normal.unionByName(odd).select("agent_id", "event_id", "ts_ms", "session_id", trace.alias("trace_id"), F.coalesce(F.col("opener") == _at(), F.lit(False)).alias("created"))
    columns = chosen.columns
    new = alone.select(F.lit(DEFAULT).alias("session_id"), "agent_id", "ts_ms", "event_id").unionByName(opening)
    return chosen.unionByName(given.select(*columns)).unionByName(alone.withColumns({"trace_id": own, "created": F.lit(True)}).select(*columns)), new


def assign(events: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """resolve() without earlier traces: agent_id, event_id, ts_ms, session_id, trace_id, created."""
    return resolve(events, None, rounds)[0]


def carried(before: DataFrame, new: DataFrame) -> DataFrame:
    """Of traces before and new, those that later events can still belong to: each session's newest, and each agent's of the hour before the last time."""
    both = before.unionByName(new)
    last = both.agg(F.max("ts_ms").alias("last"))  # one row
    newest = both.groupBy("session_id").agg(F.max(F.struct("ts_ms", "event_id", "agent_id")).alias("t")).select("session_id", "t.agent_id", "t.ts_ms", "t.event_id")
    recent = both.where("agent_id IS NOT NULL").crossJoin(F.broadcast(last)).where(F.col("ts_ms") > F.col("last") - HOUR_MS).groupBy("agent_id").agg(F.max(F.struct("ts_ms", "event_id", "session_id")).alias("t"))
    return newest.unionByName(recent.select("t.session_id", "agent_id", "t.ts_ms", "t.event_id")).distinct()
