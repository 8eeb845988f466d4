"""Trace assignment over shared sessions, as joins and as streams, against a plain loop."""

import random

import pytest

from ontoloom.operators import trace_sets
from ontoloom.streaming import traces

SCHEMA = "agent_id string, event_id long, ts_ms long, session_id string, trace_id string"
HOUR = 3_600_000


def plain(rows):
    """(event_id, trace_id, created) by one pass in order."""
    traces, out = [], []
    for agent, event, ts, session, given in sorted(rows, key=lambda r: (r[2], r[1])):
        found = given
        if found is None and session is not None:
            own = [t for t in traces if t[1] == session]
            recent = [t for t in traces if agent is not None and t[2] == agent and t[0][0] > ts - HOUR]
            pick = own or recent
            found = f"trace:{max(pick)[0][1]}" if pick else None
        created = found is None
        if created:
            found = f"trace:{event}"
            traces.append(((ts, event), session or "default", agent))
        out.append((event, found, created))
    return out


def some(seed, n=300, agents=6, sessions=25, hours=12):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        agent = None if rng.random() < 0.1 else f"a{rng.randrange(agents)}"
        session = rng.choice([None, "default"]) if rng.random() < (0.3 if seed % 2 else 0.05) else f"s{rng.randrange(sessions)}"
        if seed % 3 == 0 and session == "default":
            session = "s0"
        rows.append((agent, k, rng.randrange(hours * HOUR // 300_000) * 300_000, session, f"given{k % 3}" if rng.random() < 0.05 else None))
    return rows


@pytest.mark.parametrize("rounds", [3, 0])
def test_assignment_equals_loop(spark, rounds):
    """With 0 rounds every opener is found by the walk."""
    rows, want = [], []
    for seed in range(8):  # worlds that share nothing
        shift = lambda r, s=seed: (r[0] and f"{s}{r[0]}", r[1] + 1000 * s, r[2] + s * 100 * HOUR, r[3] and (r[3] if r[3] == "default" and s % 3 else f"{s}{r[3]}"), r[4])
        rows += [shift(r) for r in some(seed, agents=2 if seed == 3 else 6, sessions=80 if seed == 5 else 25)]
    want = plain(rows)
    got = trace_sets.assign(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds).collect()
    assert len(got) == len(rows)
    assert sorted((r.event_id, r.trace_id, r.created) for r in got) == sorted(want)
    assert sum(c for *_, c in want) > 100


def test_chain_of_hours(spark):
    """One agent, a new session every ten minutes: each trace covers the next five sessions."""
    rows = [("a", k, k * 600_000, f"s{k}", None) for k in range(600)]
    got = trace_sets.assign(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.event_id, r.trace_id, r.created) for r in got) == sorted(plain(rows))
    assert sum(r.created for r in got) == 100


def test_rules(spark):
    """Sessions first, over all agents, then the agent's trace of the last hour; no agent's trace for events without agent."""
    rows = [(None, 1, 0, "s1", None), (None, 2, 10, "s2", None), (None, 3, 20, "s1", None), ("a", 4, 30, None, None), ("a", 5, 40, "s3", None), ("a", 6, 50, None, None), ("b", 7, 60, "s1", None), ("b", 8, 70, "s3", None), ("a", 9, 80, "s3", "given"), ("a", 10, HOUR + 51, "s4", None)]
    got = {r.event_id: r.trace_id for r in trace_sets.assign(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(1, 11)] == ["trace:1", "trace:2", "trace:1", "trace:4", "trace:4", "trace:6", "trace:1", "trace:8", "given", "trace:10"]


def test_stream_equals_batch(spark, tmp_path):
    """Four micro-batches in order of time, the third one run twice."""
    rows = sorted(some(1, n=200, agents=4, sessions=30), key=lambda r: (r[2], r[1]))
    rows = [(a, k, ts, s, g) for k, (a, _, ts, s, g) in enumerate(rows)]
    whole = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):
        whole.where(f"event_id >= {50 * k} AND event_id < {50 * k + 50}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "part=*"))
    out = str(tmp_path / "out")

    def run():
        q = traces.assign_traces_stream(stream, out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None

    run()
    (tmp_path / "cp" / "commits" / "3").unlink()  # as after a failure before the last batch was committed
    (tmp_path / "cp" / "commits" / ".3.crc").unlink(missing_ok=True)
    run()
    got = spark.read.parquet(f"{out}/assigned").collect()
    assert sorted((r.event_id, r.trace_id, r.created) for r in got) == sorted(plain(rows))
    kept = spark.read.parquet(f"{out}/state/3")
    assert kept.count() < sum(c for *_, c in plain(rows))


def test_empty(spark):
    assert trace_sets.assign(spark.createDataFrame([], SCHEMA)).count() == 0
