"""Rules, hierarchies, indexes, fitted embeddings, clusters and counters beyond what SQL compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.functions import embedding, fitted
from ontoloom.functions import text as T
from ontoloom.operators import clusters, ivf, rates, vector
from ontoloom.plans import hierarchy, rules, views

DATA = "/root/testdata/sf0.001"
FACTS = "subject string, predicate string, object string"


def test_rules_of_several_conditions(spark):
    """Three conditions with a constant, against a plain fixpoint; chains through cycles end."""
    facts = [(f"n{k}", "next", f"n{(k * 3 + 1) % 17}") for k in range(17)] + [(f"n{k}", "kind", "good" if k % 3 else "bad") for k in range(17)] + [("x", None, "y")]
    raw = [
        {"id": "a", "rule_type": "PropertyChain", "conditions": [{"subject": "?x", "predicate": "next", "object": "?y"}, {"subject": "?y", "predicate": "kind", "object": "good"}, {"subject": "?y", "predicate": "next", "object": "?z"}], "conclusion": {"subject": "?x", "predicate": "next", "object": "?z"}},
        {"id": "b", "rule_type": "Custom", "conditions": [{"subject": "?x", "predicate": "next", "object": "?x"}], "conclusion": {"subject": "?x", "predicate": "kind", "object": "loop"}},
    ]
    known = {f for f in facts if None not in f}
    while True:
        edges, good = {(s, o) for s, p, o in known if p == "next"}, {s for s, p, o in known if p == "kind" and o == "good"}
        new = {(x, "next", z) for x, y in edges if y in good for y2, z in edges if y == y2} | {(x, "kind", "loop") for x, y in edges if x == y}
        if new <= known:
            break
        known |= new
    compiled, stated = rules.compile_rules(raw)
    got = rules.infer(spark.createDataFrame(facts, FACTS), compiled).collect()
    assert not stated and len(got) == len(known) and {tuple(r)[:3] for r in got} == known
    assert max(r["round"] for r in got) > 1
    with pytest.raises(rules.RuleError):
        rules.compile_rules([{"id": "c", "rule_type": "Custom", "conditions": [{"subject": "?x", "predicate": "p", "object": "o"}], "conclusion": {"subject": "?y", "predicate": "p", "object": "o"}}])


def test_many_rounds(spark):
    """A rule that needs a round for each step: the merged tables of old rounds change nothing."""
    facts = [("r", "at", "n0")] + [(f"n{k}", "to", f"n{k + 1}") for k in range(14)]
    walk = rules.Rule("walk", (("?r", "at", "?a"), ("?a", "to", "?b")), ("?r", "at", "?b"))
    got = rules.infer(spark.createDataFrame(facts, FACTS), [walk]).where("predicate = 'at'").collect()
    assert sorted((r["object"], r["round"]) for r in got) == sorted((f"n{k}", k) for k in range(15))


def test_hierarchy_of_odd_types(spark):
    types = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "zz"), ("f", "g"), ("g", "f"), ("h", "f"), ("s", "s"), (None, "a")]
    frame = spark.createDataFrame(types, "id string, parent string")
    got = sorted(tuple(r) for r in hierarchy.closure(frame).collect())
    parent, want = dict(types), []
    for t, _ in types[:-1]:
        seen, at = [t], parent[t]
        while at and at not in seen:
            seen.append(at)
            at = parent.get(at)
        want += [(t, x, k) for k, x in enumerate(seen)]
    assert got == sorted(want)
    assert {r.id for r in hierarchy.on_cycles(frame.where("id IS NOT NULL")).collect()} == {"f", "g", "h", "s"}
    assert hierarchy.closure(frame.limit(0)).count() == 0


def test_long_chain(spark):
    chain = spark.range(300).select(F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("t"), F.col("id") - 1)).alias("parent"))
    got = hierarchy.closure(chain).agg(F.count("*"), F.sum("depth"), F.max("depth")).first()
    assert tuple(got) == (300 * 301 // 2, sum(k * (k + 1) // 2 for k in range(300)), 299)


def test_index_recall(spark):
    """At least nine of ten true neighbours, by fewer lists than there are, for queries that didn't choose the probes; appended rows are found."""
    rows = views.vectors(spark, DATA)
    index = ivf.IvfIndex.build(rows.where("entity_id % 5 <> 0"))
    index.append(rows.where("entity_id % 5 = 0"))
    probes = index.probes_for(rows, views.query_vectors(spark, DATA, 7), 10)
    asked = views.query_vectors(spark, DATA, 10).where("query_id % 7 <> 0")
    exact = vector.top_k_of_queries(rows, asked, 10)
    found = index.search(rows, asked, 10, probes)
    assert probes < len(index.centroids) and index.postings().count() == rows.count()
    assert ivf.recall(found, exact) >= 0.9
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 64), (3, [float("nan")] * 64)], "query_id long, embedding array<float>")
    assert index.search(rows, odd, 10, probes).count() == 0
    with pytest.raises(ValueError):
        index.search(rows, spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>"), 10, probes)
    assert ivf.IvfIndex.build(rows.limit(0)).postings().count() == 0


def test_fitted_embeddings_carry_meaning(spark):
    """A document's nearest neighbour that isn't a near copy has its language far more often than chance, and than hashed words tell."""
    docs = views.table(spark, DATA, "documents").select("text", "lang").toPandas()
    texts, lang = [x or "" for x in docs["text"]], docs["lang"].to_numpy()
    provider = fitted.fit(views.table(spark, DATA, "documents"), dimension=32)

    def agreement(p):
        x = p.embed(texts)
        near = x @ x.T
        near[near > 0.99] = -1
        return (lang == lang[near.argmax(axis=1)]).mean()

    chance = (docs["lang"].value_counts(normalize=True) ** 2).sum()
    assert agreement(provider) > 0.97 > chance + 0.3
    assert agreement(provider) > agreement(embedding.hashing_provider(32))
    assert provider.embed([]).shape == (0, 32) and not provider.embed(["", " "]).any()
    assert not fitted.fit(spark.createDataFrame([], "text string"), 4, 64).embed(["some text"]).any()


def test_clusters_recall_and_tiles(spark):
    """Every cluster of the true links is found again at this cosine; tiles of three rows change nothing; one bucket may hold all rows."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(k, (base[k % 40] + 0.08 * rng.standard_normal(16)).tolist()) for k in range(200)] + [(200, None), (201, [0.0] * 16)] + [(300 + k, [1.0] * 16) for k in range(30)]
    frame = spark.createDataFrame(rows, "node long, embedding array<double>")
    x = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v)}
    want = {}
    for k, _ in rows:
        want[k] = min([k, *[j for j in want if k in x and j in x and x[k] @ x[j] >= 0.9]], key=lambda j: want.get(j, j))
        want[k] = want.get(want[k], want[k])
    changed = True
    while changed:
        changed = False
        for k in x:
            low = min(want[j] for j in x if x[k] @ x[j] >= 0.9)
            changed |= low != want[k]
            want[k] = low
    for tile in (clusters.TILE, 3):
        got = {r.node: (r.cluster, r.size) for r in clusters.similarity_clusters(frame, 0.9, tile=tile).collect()}
        assert {k: c for k, (c, _) in got.items()} == want
        assert got[310] == (300, 30) and got[200] == (200, 1)
    assert clusters.miss(0.9) < 0.02
    assert clusters.similarity_clusters(frame.limit(0)).count() == 0


def test_similar_by_metadata(spark):
    meta = [(k, {"role": f"{a} {b}", "goal": f"{b} work"} if k % 9 else {"note": f"{a} {b}"}) for k, (a, b) in enumerate((a, b) for a in ("red", "blue", "green") for b in ("paint", "house", "painter", "houses"))] + [(50, {}), (51, None), (52, {"role": " "})]
    items = spark.createDataFrame(meta, "entity_id long, metadata map<string,string>")
    provider = embedding.hashing_provider(64)
    asked = items.withColumnRenamed("entity_id", "query_id")
    texts = {r[0]: r[1] for r in items.select("entity_id", T.metadata_text(F.col("metadata"))).collect()}
    assert texts[1] == "red house. house work" and texts[9] == "green house" and texts[50] == texts[51] == texts[52] == ""
    named = [k for k, x in texts.items() if x]
    e = provider.embed([texts[k] for k in named]).astype(float)
    want = []
    for k, row in zip(named, e @ e.T):
        best = sorted(zip(-row, named))[:4]
        want += [(k, j, round(-s, 5)) for s, j in best if -s >= 0.5 - 1e-9]
    got = vector.similar_by_metadata(items, asked, provider, limit=4, threshold=50)
    assert got.columns == ["query_id", "entity_id", "similarity", *vector.SHOWN]
    assert sorted((r.query_id, r.entity_id, round(r.similarity, 5)) for r in got.collect()) == sorted(want)


def test_counter_rates(spark):
    """Resets, ties and gaps against a plain loop."""
    rng = np.random.default_rng(6)
    rows = []
    for name in "ab":
        t, v = 0, 0.0
        for k in range(200):
            t += int(rng.choice([0, 10, 700, 5000, 90_000]))
            v = float(rng.integers(0, 5)) if rng.random() < 0.1 else v + float(rng.integers(0, 9))
            rows.append((name, k, t, v))
    frame = spark.createDataFrame([*rows, ("a", 900, 5, None)], "name string, seq long, timestamp long, value double")
    want = []
    for name, seq, t, v in rows:
        inside = [(q, s, x) for n, s, q, x in rows if n == name and t - 60_000 < q <= t and (q, s) <= (t, seq)]
        inside.sort()
        up = sum(b if b < a else b - a for (_, _, a), (_, _, b) in zip(inside, inside[1:]))
        want.append((name, seq, up, round(up / 60, 6)))
    got = rates.counter_rates(frame, 60_000).collect()
    assert sorted((r.name, r.seq, r.increase, round(r.rate, 6)) for r in got) == sorted(want)


def test_providers():
    assert embedding.local_dimension("all-mpnet-base-v2") == 768 and embedding.local_dimension("org/bge-small-en-v1.5") == embedding.local_dimension("unknown") == 384
    assert embedding.local_provider("all-mpnet-base-v2").embed(["a b"]).shape == (1, 768)
    mixed = embedding.indexed_provider("service", 1, lambda texts: [(k, [float(len(texts[k]))]) for k in reversed(range(len(texts)))])
    assert mixed.embed(["a", "bbb", "cc"]).ravel().tolist() == [1, 3, 2] and mixed.embed([]).shape == (0, 1)
    with pytest.raises(ValueError):
        embedding.indexed_provider("service", 1, lambda texts: [(0, [1.0]), (0, [1.0])]).embed(["a", "b"])


def test_store_keeps_what_exists(spark):
    from ontoloom.operators import store

    schema = "source_id string, relation_type string, target_id string, properties map<string,string>, weight int"
    old = spark.createDataFrame([("a", "r", "b", {"k": "old"}, 1)], schema)
    new = spark.createDataFrame([("a", "r", "b", {"k": "new"}, 0), ("a", "r", "c", {"k": "x"}, 5), ("a", "r", "c", {"k": "y"}, 4)], schema)
    got = sorted((r.target_id, r.properties["k"], r.weight) for r in store.merge_edges(old, new).collect())
    assert got == [("b", "old", 1), ("c", "y", 4)]
    rows = spark.createDataFrame([("e1", "x"), ("e2", "b"), ("e2", "a"), ("e3", "z")], "entity_id string, name string")
    table, rejected = store.create_entities(rows, spark.createDataFrame([("e1", "kept")], "entity_id string, name string"))
    assert sorted((r.entity_id, r["name"]) for r in table.collect()) == [("e1", "kept"), ("e2", "a"), ("e3", "z")]
    assert sorted((r.entity_id, r["name"]) for r in rejected.collect()) == [("e1", "x"), ("e2", "b")]
