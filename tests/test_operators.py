"""Golden values and properties of the library's own operators."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ontoloom.functions import embedding
from ontoloom.functions import text as T
from ontoloom.operators import analytics as A
from ontoloom.operators import fusion, graph, store, validate
from ontoloom.plans import ontology as O
from ontoloom.plans import views
from ontoloom.sources import logs
from ontoloom.streaming import traces

AGENTS = {
    "namespace": "t", "version": "1",
    "entity_types": {
        "Agent": {"id": "Agent", "properties": [{"name": "name", "property_type": {"type": "String"}, "required": True}]},
        "LLMAgent": {"id": "LLMAgent", "parent": "Agent", "constraints": [{"type": "ValueRange", "config": {"min": 0, "max": 2}}, {"type": "StringLength", "config": {"max": 4}}]},
        "HumanAgent": {"id": "HumanAgent", "parent": "Agent"}, "Task": {"id": "Task"},
    },
    "relation_types": {
        "executes": {"id": "executes", "domain": "Agent", "range": "Task"}, "collaborates_with": {"id": "collaborates_with", "domain": "Agent", "range": "Agent", "symmetric": True},
        "has_subtask": {"id": "has_subtask", "domain": "Task", "range": "Task", "transitive": True},
    },
}


@pytest.fixture(scope="module")
def agents():
    return O.parse(json.dumps(AGENTS))


def points(spark, values, step=1000):
    return spark.createDataFrame([("m", k, k * step, float(v)) for k, v in enumerate(values)], "name string, seq long, timestamp long, value double")


def test_ontology(agents):
    assert agents.subtypes("Agent") == ["Agent", "HumanAgent", "LLMAgent"]
    assert agents.subtypes("LLMAgent") == ["LLMAgent"] and agents.expand_or_self("Odd") == ["Odd"]
    with pytest.raises(O.OntologyError):
        agents.expand("Odd")
    assert [(r["relation"], r["reason"]) for r in agents.inferred("Agent")] == [("collaborates_with", "SubtypeInheritance"), ("collaborates_with", "Symmetric"), ("executes", "SubtypeInheritance")]
    assert agents.compatible("LLMAgent", "Task") == ["executes"] and agents.compatible("Task", "Agent") == []
    assert O.parse(O.to_json(agents)) == agents
    for broken in ({"A": {"id": "A", "parent": "None"}}, {"A": {"id": "A", "parent": "B"}, "B": {"id": "B", "parent": "A"}}):
        with pytest.raises(O.OntologyError):
            O.parse(json.dumps({"entity_types": broken}))
    with pytest.raises(O.OntologyError):
        O.parse("not an ontology {{{")


def test_validation(spark, agents):
    rows = spark.createDataFrame([(1, "LLMAgent", "{}"), (2, "LLMAgent", '{"name": null}'), (3, "LLMAgent", '{"name": "éé"}'), (4, "LLMAgent", '{"name": "ééé", "t": 4096}'), (5, "Odd", "{}"), (6, "Task", '{"name": 1}')], "entity_id int, entity_type string, p string")
    done = validate.validate_entities(rows.withColumn("properties", F.parse_json("p")), agents, ["t"]).collect()
    got = {r["entity_id"]: sorted((e["kind"], e["property"]) for e in r["errors"]) for r in done}
    assert got[1] == [("MissingRequiredProperty", "name")] and got[2] == [("InvalidPropertyType", "name")] and got[3] == [] and got[6] == []
    assert got[4] == [("ConstraintViolation", "name"), ("ConstraintViolation", "t")] and got[5] == [("UnknownEntityType", None)]


def test_analytics(spark):
    assert A.performance(points(spark, [100, 150, 120, 130, 140]), ["name"], "value").first().asDict() | {"std": 0} == {"name": "m", "mean": 128.0, "std": 0, "min_value": 100.0, "max_value": 150.0, "n": 5, "median": 130.0}
    one = A.z_score_anomalies(points(spark, [100] * 15 + [1000] + [100] * 4), 2.0).collect()
    assert [(r["seq"], r["expected"], round(r["z"], 6), r["severity"]) for r in one] == [(15, 145.0, 4.358899, "critical")]
    assert [r["moving_avg"] for r in A.moving_average(points(spark, [10, 20, 30]), 2).orderBy("seq").collect()] == [15.0, 25.0]
    assert A.moving_average(points(spark, [1]), 2).count() == A.moving_average(points(spark, [1]), 0).count() == 0
    got = A.percentiles(points(spark, range(1, 11)), ["name"], "value", (50, 95)).first()
    assert (got["p50"], got["p95"]) == (6.0, 10.0)
    buckets = spark.createDataFrame([("m", 0, 1000, 10.0), ("m", 1, 2000, 20.0), ("m", 2, 61000, 30.0), ("m", 3, -1, 5.0)], "name string, seq long, timestamp long, value double")
    assert sorted((r["bucket"], r["avg_value"]) for r in A.tumbling(buckets, "minute").collect()) == [(0, 35 / 3), (60000, 30.0)]
    assert A.z_score_anomalies(points(spark, [1] * 20)).count() == 0
    rows = spark.createDataFrame([("q", k, float(k), False) for k in range(10_500)], "op string, seq long, duration double, failed boolean")
    assert A.retained(rows, ["op"]).agg(F.min("seq"), F.count("*")).first() == (1000, 9500)
    with pytest.raises(ValueError):
        A.window_ms("year")


def test_fusion(spark):
    make = lambda *p: spark.createDataFrame(list(p), "entity_id string, score double")
    rrf = {r["entity_id"]: round(r["score"], 6) for r in fusion.fuse(make(("a", 0.9), ("b", 0.8)), make(("b", 1.0), ("c", 0.5))).collect()}
    assert rrf == {"a": 0.016393, "b": 0.032522, "c": 0.016129}
    union = {r["entity_id"]: round(r["score"], 6) for r in fusion.fuse(make(("a", 0.9), ("b", 0.8)), make(("b", 1.0), ("c", 0.5)), "union").collect()}
    assert union == {"a": 0.9, "b": 0.9, "c": 0.5}


def test_graph_against_a_loop(spark):
    pairs = [(k, (k * 7 + 1) % 40) for k in range(40)] + [(k, (k * 3 + 2) % 40) for k in range(40)]
    edges = spark.createDataFrame([("e", *p) for p in pairs], "relation_type string, source_id long, target_id long")
    depth, frontier = {3: 0}, [3]
    for level in (1, 2, 3):
        frontier = [b for a in frontier for x, b in pairs if x == a and b not in depth and not depth.update({b: level})]
    got = {r["entity_id"]: r["depth"] for r in graph.reach(edges, 3, 3).collect()}
    assert got == {k: v for k, v in depth.items() if v}
    assert graph.reach(edges, 3, 0).count() == 0
    only = spark.createDataFrame([(3,), (22,)], "entity_id long")
    assert {r["entity_id"] for r in graph.reach(edges, 3, 5, entities=only).collect()} <= {22}


def test_chunks_and_ranges_change_nothing(spark, monkeypatch):
    rows = [("a" if k % 3 else None, k * k, 1000 * k, float((k * 37) % 101) if k % 7 else 1e9 * k) for k in range(300)]
    points = spark.createDataFrame(rows, "name string, seq long, timestamp long, value double")
    timed = spark.createDataFrame([(n, q, v, False) for n, q, _, v in rows], "name string, seq long, duration double, failed boolean")
    forms = [lambda: A.moving_average(points, 5), lambda: A.moving_average(points, 1), lambda: A.rate_of_change(points), lambda: A.sudden_changes(points, 10.0), lambda: A.percentiles(timed, ["name"], "duration"), lambda: A.retained(timed, ["name"], 50, 20), lambda: A.performance(timed, ["name"], "duration")]
    want = [sorted(map(repr, f().collect())) for f in forms]
    for chunk, ranges in ((1, 1), (7, 3), (1000, 64)):
        monkeypatch.setattr(A, "CHUNK", chunk)
        monkeypatch.setattr(A, "RANGES", ranges)
        assert [sorted(map(repr, f().collect())) for f in forms] == want
    for name in ("a", None):
        values = sorted(v for n, _, _, v in rows if n == name)
        got = [r for r in A.percentiles(timed, ["name"], "duration").collect() if r["name"] == name][0]
        assert got["p50"] == values[int(0.5 * (len(values) - 1) + 0.5)] and got["p99"] == values[int(0.99 * (len(values) - 1) + 0.5)]
        series = [(q, v) for n, q, _, v in rows if n == name]
        means = {q: sum(v for _, v in series[k - 4 : k + 1]) / 5 for k, (q, _) in enumerate(series) if k >= 4}
        assert {r["seq"]: r["moving_avg"] for r in A.moving_average(points, 5).collect() if r["name"] == name} == pytest.approx(means)


def test_large_traversals_use_tables(spark, monkeypatch):
    edges = spark.createDataFrame([("x", k, (k * s + 1) % 40) for k in range(40) for s in (2, 3)], "relation_type string, source_id long, target_id long")
    want = [sorted(map(tuple, graph.reach(edges, 3, d).collect())) for d in (1, 3, 5)]
    for few in (1, 4, 9):
        monkeypatch.setattr(graph, "FEW", few)
        assert [sorted(map(tuple, graph.reach(edges, 3, d).collect())) for d in (1, 3, 5)] == want
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = graph.numbered(rows, ["v"], "place").collect()
    assert {r["v"]: r["place"] for r in got} == {k: k + 1 for k in range(1000)}
    assert graph.numbered(rows.limit(0), ["v"], "place").count() == 0


def test_logs(spark):
    lines = ["Running WebSearch tool with input: weather forecast", '{"event_type": "test", "request_id":"req-123"}', "session_id: s1 hello", None, ""]
    rules = [logs.Rule("l", "langchain"), logs.Rule("j", "json", mapping={"request_id": "rid"}, priority=1), logs.Rule("r", "regex", r"(\w+) failed with (\d+)", ("job", "code"), event_type="failure")]
    got = logs.parse_logs(spark.createDataFrame([(x,) for x in [*lines, "build failed with 7"]], "message string"), rules).collect()
    assert [r["event_type"] for r in got] == ["tool_call", "test", None, None, None, "failure"]
    assert got[1]["properties"]["rid"] == "req-123" and got[1]["session_id"] is None and got[2]["session_id"] == "s1"
    assert got[5]["properties"] == {"job": "build", "code": "7"}
    assert got[0]["properties"] == {"framework": "langchain", "tool_name": "WebSearch", "input": " with input: weather forecast"}
    more = ["Finished calc tool now", "Agent Finished", "query: a b\nresponse: c", "Retrieve from nodes: 12", "[1]", "7", "req_id: r-1 agent_name: bob"]
    rules = [logs.Rule("j", "json", priority=1), logs.Rule("l", "langchain"), logs.Rule("i", "llamaindex")]
    got = logs.parse_logs(spark.createDataFrame([(x,) for x in more], "message string"), rules).collect()
    assert [r["event_type"] for r in got] == ["tool_call", "agent_action", "query", "retrieval", None, None, None]
    assert got[0]["properties"]["tool_name"] == "calc" and got[1]["properties"] == {"framework": "langchain", "action": "Finished", "input": ""}
    assert got[2]["properties"]["query"] == "a b" and got[3]["properties"]["node_count"] == "2"
    assert got[4]["properties"] == {"message": "[1]"} and got[5]["properties"] == {"message": "7"}
    assert (got[6]["session_id"], got[6]["agent_id"]) == ("r-1", "bob")
    errors = spark.createDataFrame([("FATAL disk full at node 3",), ("fine",)], "m string").select(logs.error_parts(F.col("m")).alias("e")).collect()
    assert errors[0]["e"]["level"] == "FATAL" and errors[1]["e"] is None


def record(k, **more):
    base = {"timestamp": f"2024-01-01T00:00:0{k}Z", "requestId": f"r{k}", "modelId": "m", "identity": {"arn": "a1"}}
    return json.dumps(base | more)


def test_invocation_graph(spark, tmp_path):
    call = {"output": {"outputBodyJson": {"output": {"message": {"content": [{"toolUse": {"toolUseId": "t1", "name": "find", "input": {"patient_id": "PAT7"}}}]}}, "metrics": {"latencyMs": 858}, "usage": {"inputTokens": 1023, "outputTokens": 89, "totalTokens": 1112}}}}
    result = {"input": {"inputBodyJson": {"messages": [{"role": "user", "content": [{"text": "see patient-9 and pat7"}, {"toolResult": {"toolUseId": "t1", "content": [{"text": "ok"}]}}]}]}}}
    (tmp_path / "log.json").write_text("[" + ",".join([record(1, **result), record(2, **call), record(3, errorCode="ThrottlingException"), record(4, errorCode="Other")]) + "]")
    rows = logs.read_json_array(spark, str(tmp_path / "log.json"), logs.INVOCATION)
    events = {r["request_id"]: r for r in logs.invocation_events(rows).collect()}
    assert [events[f"r{k}"]["event_type"] for k in (1, 2, 3, 4)] == ["invocation", "tool_use", "error", "error"]
    assert (events["r2"]["latency_ms"], events["r2"]["input_tokens"], events["r2"]["output_tokens"]) == (858, 1023, 89)
    link = logs.tool_links(rows).first()
    assert (link["called_in"], link["returned_in"], link["result"]) == ("r2", "r1", "ok")
    nodes, edges = logs.invocation_graph(rows)
    assert {r["entity_id"] for r in nodes.collect()} == {"request:r1", "request:r2", "request:r4", "agent:a1", "patient:patient-9", "patient:pat7", "patient:PAT7", "tool_use:t1"}
    assert edges.groupBy("relation_type").count().where("relation_type = 'FOLLOWED_BY'").first()["count"] == 2


def test_text_and_embedding(spark):
    import base64
    import hashlib

    want = base64.b64encode(hashlib.sha1(b"seed").digest()).decode().translate(str.maketrans({"+": "A", "/": "B", "=": None}))[:10]
    assert spark.range(1).select(T.short_id(F.lit("seed"))).first()[0] == want
    p = embedding.hashing_provider(16)
    rows = embedding.embed_texts(spark.createDataFrame([("a b",), (None,), ("",)], "text string"), p).collect()
    assert rows[1]["embedding"] is None and abs(sum(x * x for x in rows[0]["embedding"]) - 1) < 1e-6
    registry = embedding.Registry()
    registry.register(p)
    assert registry.current() is p and registry.names() == ["hashing"]


def test_store(spark):
    e = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    r = spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, "x", "b"), (4, None, "b")], "relation_id int, source_id string, target_id string")
    ok, bad = store.check_endpoints(r, e)
    assert [x["relation_id"] for x in ok.collect()] == [1] and sorted(x["relation_id"] for x in bad.collect()) == [2, 3, 4]


def test_views(spark):
    assert views.ONTOLOGY.check() is None
