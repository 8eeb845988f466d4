"""Operators whose work or memory once grew faster than their input."""

import json
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ontoloom import catalogue, catalogue_more
from ontoloom.functions import embedding, fitted
from ontoloom.operators import clusters, graph, rates, store, vector
from ontoloom.plans import hierarchy, views
from ontoloom.sources import invocations, logs


def test_closure_passes_chains_by_doubled_jumps(spark, monkeypatch):
    # A chain of 300 with a fork in the middle, whose branches are a chain and a cycle; edges are repeated, and another type leads away.
    edges = [(k, k + 1) for k in range(300)] + [(150, 1000), (150, 1000), (300, None)]
    edges += [(k, k + 1) for k in range(1000, 1100)] + [(1100, 1000), (5, 6)]
    rows = spark.createDataFrame([("t", a, b) for a, b in edges] + [("u", 7, 5000)], "relation_type string, source_id long, target_id long")
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    assert sorted(r[0] for r in graph.closure(rows, 0, "t", True).collect()) == [*range(1, 301), *range(1000, 1101)]
    assert len(written) < 60  # one or two for each of 250 levels before
    assert sorted(r[0] for r in graph.closure(rows, 1050, "t", True).collect()) == list(range(1000, 1101))
    assert [r[0] for r in graph.closure(rows, 0, "t", False).collect()] == [1]
    assert graph.closure(rows, 300, "t", True).count() == 0


def test_clusters_compare_each_pair_once_where_buckets_would_not_help(spark):
    x = np.random.default_rng(3).standard_normal((200, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(enumerate(((unit @ unit.T >= 0.45).sum(axis=1) - 1).tolist()))
    for tile in (clusters.TILE, 40):
        got = clusters.similar_edges(rows, 0.45, bits=4, tables=80, tile=tile).groupBy("a").agg(F.sum("links")).collect()
        assert dict(map(tuple, got)) == {k: n for k, n in want.items() if n}  # pairs met in several buckets before


def test_a_tile_of_similar_rows_holds_no_list_of_pairs():
    x = np.full((6000, 8), 8**-0.5) + np.random.default_rng(5).standard_normal((6000, 8)) * 1e-4
    x = np.concatenate([x, -x[:10]])
    tracemalloc.start()
    root, met = clusters._stars(x / np.linalg.norm(x, axis=1, keepdims=True), None, 0.98)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6  # 36 million pairs of two places before
    assert met.tolist() == [5999] * 6000 + [9] * 10 and root.tolist() == [0] * 6000 + [6000] * 10


def _brute_groups(x, cosine):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, label = unit @ unit.T >= cosine, np.arange(len(x))
    while True:
        low = np.where(links, label[None, :], len(x)).min(axis=1)
        if (low == label).all():
            return label
        label = low


def test_a_large_group_grows_without_its_pairs(monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([np.full((4000, 8), 8**-0.5) + rng.standard_normal((4000, 8)) * 0.02, rng.standard_normal((300, 8))])
    x = x[rng.permutation(len(x))] * rng.uniform(0.5, 2, (len(x), 1))
    compared, stars = [], clusters._stars
    monkeypatch.setattr(clusters, "_stars", lambda a, b, cosine: compared.append(len(a)) or stars(a, b, cosine))
    got = clusters._groups(x / np.linalg.norm(x, axis=1, keepdims=True), 0.98)
    assert (got == _brute_groups(x, 0.98)).all()
    assert sum(compared) < 400  # all 4300 rows met each other before


def test_only_rows_outside_the_largest_group_meet_other_parts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((5, 12))
    x = np.concatenate([base[rng.integers(0, 2, 900)] + 0.15 * rng.standard_normal((900, 12)), base[2] + 0.1 * rng.standard_normal((200, 12)), base[3:].repeat(40, 0) + 0.4 * rng.standard_normal((80, 12)), rng.standard_normal((120, 12))])
    x = x[rng.permutation(len(x))]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, embedding array<double>")
    for own, tile, cosine in ((8, 64, 0.95), (64, 200, 0.85), (10_000, 200, 0.2)):  # many pivots, some, a single one
        monkeypatch.setattr(clusters, "OWN", own)
        edges = clusters.linked(rows, cosine, 12, len(x), tile)
        got = {r.node: r.component for r in clusters.components(edges).collect()}
        assert [got.get(k, k) for k in range(len(x))] == _brute_groups(x, cosine).tolist()


def test_clusters_embed_each_message_once(spark):
    made = spark.sparkContext.accumulator(0)

    def embed(texts):
        made.add(len(texts))
        return np.array([[1.0, len(x)] for x in texts], np.float32).reshape(-1, 2)

    rows = spark.range(40).selectExpr("id AS node", "repeat('x', int(id % 3) * 5) AS message", "id AS ts").repartition(2)
    got = clusters.error_clusters(embedding.embed_texts(rows, embedding.Provider("sizes", 2, embed), "message"), 0.99)
    assert [tuple(r)[:2] for r in got.collect()] == [(0, 14), (1, 26)][::-1] and made.value == 40  # 80 before


def test_grams_are_those_of_a_plain_loop():
    for text in ["", "a", "  Some  words, some WORDS \n again", "\u00e9\u00e8 " * 30]:
        data, want = f" {' '.join(text.lower().split())} ".encode(), {}
        for n in fitted.GRAMS:
            for i in range(len(data) - n + 1):
                h = n
                for byte in data[i : i + n]:
                    h = (h ^ byte) * 0x100000001B3 % 2**64
                    h ^= h >> 29
                want[h % 1000] = want.get(h % 1000, 0) + 1
        assert dict(zip(*(v.tolist() for v in fitted.grams(text, 1000)))) == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counter_rates_go_through_no_window_again(spark):
    rows = spark.createDataFrame([("m", k, k // 3 * 700, float(k * 7 % 11)) for k in range(60)] + [("m", 99, 5, None)], "name string, seq long, timestamp long, value double")
    got = {r.seq: r.increase for r in rates.counter_rates(rows, 2000).collect()}
    values = [float(k * 7 % 11) for k in range(60)]
    for k in range(60):
        first = next(j for j in range(60) if j // 3 * 700 > k // 3 * 700 - 2000)
        assert got[k] == sum(v if v < u else v - u for u, v in zip(values[first:k], values[first + 1 : k + 1])) and len(got) == 60
    assert "RangeFrame, -" not in _plan(rates.counter_rates(rows, 2000))  # a frame of that kind is gone through for each row


def test_endpoints_are_checked_in_one_pass(spark):
    lines = spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, None, "b"), (4, "a", "b")], "n long, source_id string, target_id string")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "entity_id string")
    assert sorted((r.n, r.accepted) for r in store.with_accepted(lines, ids).collect()) == [(1, True), (2, False), (3, False), (4, True)]
    ok, bad = store.check_endpoints(lines, ids)
    assert sorted(r.n for r in ok.collect()) == [1, 4] and sorted(r.n for r in bad.collect()) == [2, 3]


def test_records_are_parsed_once(spark, tmp_path):
    spark.range(7).selectExpr("id AS event_id", "timestamp_micros(id) AS ts", "id AS user_id", "'view' AS event_type", "1.5D AS value", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    records = catalogue_more.invocation_records(spark, str(tmp_path))
    nodes, edges = invocations.interaction_graph(records)
    assert [_plan(x).count("Relation [") for x in (nodes, edges, invocations.flat_logs(records))] == [1, 3, 1]  # 7, 8 and 7 before


def test_figures_are_made_in_one_pass_over_the_events(spark):
    rows = [
        ("tool_use", None, "find", 10, 3, 7), ("tool_use", None, "find", 10, 3, 7), ("error", "E", None, 5, None, None), ("error", "", "", None, 9, 2), (None, None, None, 4, 4, None),
        ("tokens", "numbers", "numbers", -1, 0, -3),
    ]
    schema = "event_type string, error_code string, tool string, input_tokens long, output_tokens long, latency_ms long"
    events = spark.createDataFrame(rows, schema)
    got = invocations.analysis(events)
    want = {("event_type", "tool_use"): 2, ("event_type", "error"): 2, ("event_type", "tokens"): 1, ("error_code", "E"): 1, ("error_code", ""): 1, ("error_code", "numbers"): 1, ("tool", "find"): 2, ("tool", ""): 1, ("tool", "numbers"): 1}
    want |= {("tokens", "input"): 23, ("tokens", "output"): 10, ("tokens", "total"): 33, ("tokens", "average_input"): 5, ("tokens", "average_output"): 2, ("latency", "average"): 3, ("latency", "min"): -3, ("latency", "max"): 7}
    assert got.count() == len(want) and {(r.figure, r.key): r.value for r in got.collect()} == want
    least = {(r.figure, r.key): r.value for r in invocations.analysis(events.where("event_type is null")).collect()}
    assert least == {("tokens", "input"): 4, ("tokens", "output"): 4, ("tokens", "total"): 8, ("tokens", "average_input"): 4, ("tokens", "average_output"): 4}
    assert invocations.analysis(spark.createDataFrame([], schema)).count() == 0
    assert invocations.analysis(spark.createDataFrame([(None,) * 6] * 3, schema)).count() == 0
    assert _plan(got).count("LogicalRDD") == 1  # 4 before


def test_throttled_records_are_left_out_without_a_second_parse(spark):
    user = lambda *parts: {"input": {"inputBodyJson": {"messages": [{"role": "assistant", "content": [{"text": "not asked"}]}, {"role": "user", "content": [*parts]}, {"role": "user"}]}}}
    said = lambda *parts: {"output": {"outputBodyJson": {"output": {"message": {"role": "assistant", "content": [*parts]}}}}}
    call, result = (lambda i: {"toolUse": {"toolUseId": i, "name": "n"}}), (lambda i, *t: {"toolResult": {"toolUseId": i, "content": [{"text": x} for x in t]}})
    lines = [
        {"requestId": "a", "timestamp": "1", **user({"text": "q"}, result("t", "an Error")), **said({"text": "x"}, call("t"), call("t"))},
        {"requestId": "b", "timestamp": "2", "errorCode": "ThrottlingException", **user({"text": "q"}, result("t", "ok")), **said(call("t"))},
        {"requestId": "c", "timestamp": "0", "errorCode": "Other", **user(result("t"), result(None, "error")), **said(call(None), {"text": ""})},
        {"requestId": None, "timestamp": None, **said()}, {"requestId": "d", "timestamp": "1", **user(result("u", "ok"))},
        {"requestId": "d", "timestamp": "1", **user(result("u", "ok"))},
    ]
    texts = spark.createDataFrame([(json.dumps(x),) for x in [*lines, {}]] + [("",), ("[]",), (None,)], "t string")
    records = texts.select(F.from_json("t", logs.INVOCATION).alias("r")).select("r.*")
    nodes, edges = invocations.interaction_graph(records)
    got = sorted(" ".join(map(str, x)) for x in edges.collect())
    want = ["triggers query:a:1:0 request:a", "produces request:a response:a", "contains response:a answer:a:0", "invokes response:a call:a:1", "invokes response:a call:a:2", "provides_context_to result:a:1:1 request:a"]
    want += ["contains result:a:1:1 error:result:a:1:1", "returns call:a:2 result:a:1:1", "returns call:a:2 result:c:1:0", "provides_context_to result:c:1:0 request:c", "provides_context_to result:c:1:1 request:c"]
    want += ["contains result:c:1:1 error:result:c:1:1", "produces request:c response:c", "invokes response:c call:c:0", "contains response:c answer:c:1", "produces request response"] + ["provides_context_to result:d:1:0 request:d"] * 2
    assert got == sorted(want)
    kinds = {r.entity_type: r["count"] for r in nodes.groupBy("entity_type").count().collect()}
    assert kinds == {"Request": 9, "Response": 3, "UserQuery": 1, "ToolResult": 5, "AssistantResponse": 2, "ToolCall": 3, "Error": 2}
    none = [x.count() for x in invocations.interaction_graph(records.where("requestId = 'b'"))]
    assert none == [0, 0]
    assert [_plan(x).count("from_json(") for x in (nodes, edges)] == [1, 3]  # 2 and 6 before


def test_compatible_deals_blocks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 8)
    types = spark.createDataFrame([("a", None), ("b", None)] + [(f"a{k}", "a") for k in range(60)] + [(f"b{k}", "b") for k in range(50)], "id string, parent string")
    links = spark.createDataFrame([("r", "a", "b"), ("s", "b", "b"), ("u", "none", "a"), ("v", None, "a")], "id string, domain string, range string")
    got = hierarchy.compatible(hierarchy.closure(types), links)
    assert sorted(map(tuple, got.groupBy("relation_type").count().collect())) == [("r", 61 * 51), ("s", 51 * 51)]
    assert got.distinct().count() == 61 * 51 + 51 * 51
    held = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    assert held < 61 * 51 / 2  # all pairs of a relation were made by one task before


def test_compatible_makes_few_pairs_of_one_row(spark):
    types = spark.range(2101).selectExpr("concat('a', id) AS id", "if(id > 0, 'a0', null) AS parent")
    links = spark.createDataFrame([("r", "a0", "a0"), ("r", "a0", "a7"), ("r", "a0", "a7"), (None, "a7", "a0")], "id string, domain string, range string")
    closed = hierarchy.closure(types)
    met = hierarchy._meetings(closed, links)
    made = met.agg(F.max(F.size("sources") * F.size("targets")), F.sum(F.size("sources").cast("long") * F.size("targets"))).first()
    assert made[0] < 3 * hierarchy.SLICE**2 < 100_000 and made[1] == 2101 * 2101 + 3 * 2101  # a row made a whole pair of blocks before, all held at once
    got = hierarchy.compatible(closed, links)
    assert got.count() == got.distinct().count() + 2 * 2101 == made[1]
    assert "explode" in _plan(got) and "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()  # which stops between rows


def test_top_k_scores_few_queries_once_the_best_are_known(spark):
    x = np.random.default_rng(8).standard_normal((4000, 6))
    x[1500:1600] = x[:100]  # equal rows are ordered by id
    rows = spark.createDataFrame([(k % 3, k, v.tolist()) for k, v in enumerate(x)], "collection int, entity_id long, embedding array<double>").coalesce(1)
    asked = rows.where("entity_id < 40").select(F.col("entity_id").alias("query_id"), "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for per, ways in ((False, [None]), (True, [0, 1, 2])):
        got = {(r.query_id, r.collection if per else None, r["rank"]): r.entity_id for r in vector.top_k_of_queries(rows, asked, 7, per).collect()}
        for q in range(40):
            for c in ways:
                best = sorted((j for j in range(4000) if c is None or j % 3 == c), key=lambda j: (-round(float(unit[q] @ unit[j]), 12), j))[:7]
                assert [got[q, c, n + 1] for n in range(7)] == best


def test_relation_counts_deal_large_tables_over_tasks_that_grow_with_them(spark, tmp_path, monkeypatch):
    tables = {
        "nation": spark.range(5).selectExpr("id AS n_nationkey", "id % 2 AS n_regionkey"),
        "customer": spark.range(40).selectExpr("if(id = 7, null, id) AS c_custkey", "id % 5 AS c_nationkey"),
        "supplier": spark.range(9).selectExpr("id AS s_suppkey", "if(id < 3, null, 1L) AS s_nationkey"),
        "orders": spark.range(1000).selectExpr("id AS o_orderkey", "if(id < 600, 1L, id % 30) AS o_custkey"),
        "lineitem": spark.range(9000).selectExpr("id % 3000 div 3 AS l_orderkey", "id % 6 AS l_partkey"),  # each pair three times
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(views, "SHARE", 200)
    counts = catalogue.graph_relation_counts(spark, str(tmp_path))
    got = {r.relation_type: tuple(r)[1:] for r in counts.collect()}
    assert got == {"IN_REGION": (5, 5, 2), "IN_NATION": (49, 48, 5), "PLACED": (1000, 30, 1000), "CONTAINS": (3000, 1000, 6)}
    assert _plan(counts).count("RepartitionByExpression") == 2 and "Expand" not in _plan(counts)  # no dealing, three rows an edge before
    dealt = views.relations(spark, str(tmp_path), 200)
    assert dealt.groupBy("relation_type", F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400  # all orders were in one task before
    assert sorted(map(str, dealt.collect())) == sorted(map(str, views.relations(spark, str(tmp_path)).collect()))


def test_degrees_count_edges_with_repeats_and_ends_without_nulls(spark):
    rows = [("a", "x", "y"), ("a", "x", "y"), ("a", None, "x"), ("b", "y", None), (None, "x", "x")]
    rows = spark.createDataFrame(rows, "relation_type string, source_id string, target_id string")
    assert {tuple(r) for r in graph.degree_summary(rows).collect()} == {("a", 3, 1, 2), ("b", 1, 1, 0), (None, 1, 1, 1)}
    assert graph.degree_summary(rows.limit(0)).count() == 0
