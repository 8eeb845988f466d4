"""Searches for a table of queries against the search for one."""

import random

from ontoloom.operators import vector


def test_queries_equal_single_searches(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    made = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(40)]
    rows = [(f"c{k % 3}", k, x) for k, x in enumerate([*made, *made[:25], [0.0] * 5, None])]
    vectors = spark.createDataFrame(rows, "collection string, entity_id long, embedding array<float>").repartition(3)
    queries = vectors.where("entity_id % 6 = 0 or entity_id >= 65").selectExpr("entity_id as query_id", "embedding")
    asked = [(i, x) for _, i, x in rows if i % 6 == 0 and x and any(x)]
    pick = lambda df: sorted((r.collection, r.entity_id, round(r.score, 9), r.rank) for r in df.collect())
    for many, one in ((vector.top_k_of_queries(vectors, queries, 4), vector.top_k), (vector.top_k_of_queries(vectors, queries, 4, per_collection=True), vector.top_k_per_collection)):
        found = many.cache()
        assert {r.query_id for r in found.collect()} == {i for i, _ in asked}
        for i, x in (asked[0], asked[-1]):
            float32 = vectors.where(f"entity_id = {i}").first()["embedding"]
            assert pick(found.where(f"query_id = {i}")) == pick(one(vectors.where("embedding is not null"), float32, 4))
    assert vector.top_k_of_queries(vectors, queries.limit(0), 4).count() == vector.top_k_of_queries(vectors.limit(0), queries, 4).count() == 0
