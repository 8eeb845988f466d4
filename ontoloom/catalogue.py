"""All queries over the driver's tables, by name, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom import catalogue_more, catalogue_reason
from ontoloom.functions import text as T
from ontoloom.operators import analytics as A
from ontoloom.operators import fusion, graph, store, validate, vector
from ontoloom.plans import views
from ontoloom.sources import logs
from ontoloom.streaming import traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Vector search. Scores are rounded to six places.
_SCORES = "scores AS (SELECT label AS collection, vec_id AS entity_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings)"


def _rounded(df: DataFrame, column: str = "score", places: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, places))


@query("vec_topk", f"WITH {_SCORES} SELECT collection, entity_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, entity_id) AS rank FROM scores ORDER BY s DESC, entity_id LIMIT 10")
def vec_topk(spark, d):
    return _rounded(vector.top_k(views.vectors(spark, d), views.query_vector(spark, d), 10))


@query("vec_topk_per_type", f"WITH {_SCORES} SELECT collection, entity_id, round(s, 6) AS score, row_number() OVER (PARTITION BY collection ORDER BY s DESC, entity_id) AS rank FROM scores QUALIFY row_number() OVER (PARTITION BY collection ORDER BY s DESC, entity_id) <= 5")
def vec_topk_per_type(spark, d):
    return _rounded(vector.top_k_per_collection(views.vectors(spark, d), views.query_vector(spark, d), 5))


_HITS = """hits AS (SELECT entity_id, s FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY s DESC, entity_id) AS k FROM scores WHERE collection IN (0, 1, 2, 3)) WHERE k <= 10 AND s >= 0.05)"""


@query("vec_query_expanded", f"WITH {_SCORES}, {_HITS} SELECT entity_id, 'item-' || entity_id AS name, round(s, 6) AS score, count(*) OVER () AS total_count, row_number() OVER (ORDER BY s DESC, entity_id) AS rank FROM hits ORDER BY s DESC, entity_id LIMIT 10")
def vec_query_expanded(spark, d):
    found = vector.vector_query(views.vectors(spark, d), views.vector_entities(spark, d), views.query_vector(spark, d), [0, 1, 2, 3], 10, 0.05)
    return _rounded(found).drop("collection")


@query("vec_similar_to_item", f"WITH {_SCORES}, t AS (SELECT * FROM scores ORDER BY s DESC, entity_id LIMIT 20) SELECT collection, entity_id, round(s, 6) AS score FROM t WHERE entity_id <> 0 AND s >= 0.1")
def vec_similar_to_item(spark, d):
    return _rounded(vector.similar_to_item(views.vectors(spark, d), 0, 20, 0.1))


# The same searches for every item whose id is divisible by 100.
_ALL_SCORES = "scores AS (SELECT q.vec_id AS query_id, e.label AS collection, e.vec_id AS entity_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"


@query("vec_topk_queries", f"WITH {_ALL_SCORES} SELECT query_id, collection, entity_id, round(s, 6) AS score, row_number() OVER w AS rank FROM scores WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, entity_id) QUALIFY row_number() OVER w <= 10")
def vec_topk_queries(spark, d):
    return _rounded(vector.top_k_of_queries(views.vectors(spark, d), views.query_vectors(spark, d), 10))


@query("vec_topk_per_type_queries", f"WITH {_ALL_SCORES} SELECT query_id, collection, entity_id, round(s, 6) AS score, row_number() OVER w AS rank FROM scores WINDOW w AS (PARTITION BY query_id, collection ORDER BY s DESC, entity_id) QUALIFY row_number() OVER w <= 5")
def vec_topk_per_type_queries(spark, d):
    return _rounded(vector.top_k_of_queries(views.vectors(spark, d), views.query_vectors(spark, d), 5, per_collection=True))


@query("vec_expanded_queries", f"WITH {_ALL_SCORES}, hits AS (SELECT query_id, entity_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY s DESC, entity_id) AS k FROM scores WHERE collection IN (0, 1, 2, 3)) WHERE k <= 10 AND s >= 0.05) SELECT query_id, entity_id, 'item-' || entity_id AS name, round(s, 6) AS score, count(*) OVER (PARTITION BY query_id) AS total_count, row_number() OVER w AS rank FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, entity_id) QUALIFY row_number() OVER w <= 10")
def vec_expanded_queries(spark, d):
    found = vector.vector_query_of_queries(views.vectors(spark, d), views.vector_entities(spark, d), views.query_vectors(spark, d), [0, 1, 2, 3], 10, 0.05)
    return _rounded(found).drop("collection")


@query("vec_similar_to_items", f"WITH {_ALL_SCORES}, t AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entity_id) <= 20) SELECT query_id, collection, entity_id, round(s, 6) AS score FROM t WHERE entity_id <> query_id AND s >= 0.1")
def vec_similar_to_items(spark, d):
    return _rounded(vector.similar_to_items(views.vectors(spark, d), views.query_vectors(spark, d), 20, 0.1))


@query("vec_threshold_norm", "SELECT event_id, round(CASE WHEN value <= 0 THEN 0 WHEN value <= 1 THEN value ELSE value / 100 END, 9) AS threshold FROM events")
def vec_threshold_norm(spark, d):
    return views.table(spark, d, "events").select("event_id", F.round(T.normalise_threshold(F.col("value")), 9).alias("threshold"))


@query("vec_collection_stats", "SELECT label AS collection, count(*) AS n_vectors, max(len(embedding)) AS dimension FROM embeddings GROUP BY 1")
def vec_collection_stats(spark, d):
    return vector.collection_stats(views.vectors(spark, d)).withColumn("dimension", F.col("dimension").cast("long"))


# Graph. Starts and depths are those of the SQL.
_EDGES = "edges AS (SELECT 'near' AS t, vec_id AS a, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS b FROM embeddings UNION ALL SELECT 'refers', vec_id, (vec_id * 3 + 2) % (SELECT count(*) FROM embeddings) FROM embeddings)"


def _walk(name: str, start: int, depth: int, a: str, b: str, where: str = "true") -> str:
    return f"{name}_w(id, depth) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT e.{b}, w.depth + 1 FROM {name}_w w JOIN edges e ON e.{a} = w.id WHERE w.depth < {depth} AND {where}), {name} AS (SELECT id AS entity_id, min(depth) AS depth FROM {name}_w GROUP BY id HAVING min(depth) > 0)"


@query("graph_out", f"WITH RECURSIVE {_EDGES}, {_walk('o', 3, 4, 'a', 'b')} SELECT entity_id, CAST(depth AS INTEGER) AS depth FROM o")
def graph_out(spark, d):
    return graph.reach(views.vector_edges(spark, d), 3, 4)


@query("graph_in", f"WITH RECURSIVE {_EDGES}, {_walk('i', 3, 3, 'b', 'a')} SELECT entity_id, CAST(depth AS INTEGER) AS depth FROM i")
def graph_in(spark, d):
    return graph.reach(views.vector_edges(spark, d), 3, 3, direction="incoming")


@query("graph_typed", f"WITH RECURSIVE {_EDGES}, {_walk('o', 3, 5, 'a', 'b', chr(101) + '.t = ' + chr(39) + 'near' + chr(39))} SELECT entity_id, CAST(depth AS INTEGER) AS depth FROM o")
def graph_typed(spark, d):
    return graph.reach(views.vector_edges(spark, d), 3, 5, ["near"])


_BOTH = f"{_EDGES}, {_walk('o', 3, 3, 'a', 'b')}, {_walk('i', 3, 3, 'b', 'a')}, u AS (SELECT entity_id, 0 AS way, depth FROM o UNION ALL SELECT entity_id, 1, depth FROM i), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY way, depth) = 1)"


@query("graph_both", f"WITH RECURSIVE {_BOTH} SELECT entity_id, CAST(way AS INTEGER) AS way, CAST(depth AS INTEGER) AS depth FROM f")
def graph_both(spark, d):
    return graph.reach_both(views.vector_edges(spark, d), 3, 3)


@query("graph_position_score", f"WITH RECURSIVE {_BOTH} SELECT entity_id, CAST(row_number() OVER w AS INTEGER) AS position, round(1.0::DOUBLE / row_number() OVER w, 6) AS score FROM f WINDOW w AS (ORDER BY way, depth, entity_id)")
def graph_position_score(spark, d):
    return _rounded(graph.position_scores(graph.reach_both(views.vector_edges(spark, d), 3, 3))).select("entity_id", "position", "score")


@query("graph_multiset", f"WITH RECURSIVE {_EDGES}, {_walk('o', 3, 3, 'a', 'b')}, n AS (SELECT * FROM o UNION ALL SELECT 3, 0) SELECT e.b AS entity_id, CAST(n.depth + 1 AS INTEGER) AS depth FROM edges e JOIN n ON e.a = n.entity_id")
def graph_multiset(spark, d):
    return graph.traverse_multiset(views.vector_edges(spark, d), 3, 4)


@query("graph_closure", f"WITH RECURSIVE {_EDGES}, c(entity_id) AS (SELECT b FROM edges WHERE t = 'near' AND a = 3 UNION SELECT e.b FROM c JOIN edges e ON e.a = c.entity_id AND e.t = 'near') SELECT entity_id FROM c")
def graph_closure(spark, d):
    return graph.closure(views.vector_edges(spark, d), 3, "near", True)


_RELATIONS = """rel AS (SELECT 'IN_REGION' AS t, 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation
UNION ALL SELECT 'IN_NATION', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'IN_NATION', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'PLACED', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders UNION ALL SELECT 'CONTAINS', 'order:' || l_orderkey, 'part:' || l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))"""


@query("graph_relation_counts", f"WITH {_RELATIONS} SELECT t AS relation_type, count(*) AS n_edges, count(DISTINCT a) AS n_sources, count(DISTINCT b) AS n_targets FROM rel GROUP BY t")
def graph_relation_counts(spark, d):
    return graph.degree_summary(views.relations(spark, d, views.SHARE))


@query("graph_customer_parts", f"WITH {_RELATIONS} SELECT DISTINCT q.b AS entity_id FROM rel p JOIN rel q ON p.b = q.a AND p.t = 'PLACED' AND q.t = 'CONTAINS' WHERE p.a = 'customer:1'")
def graph_customer_parts(spark, d):
    """Provenance: parts two steps from a customer."""
    found = graph.reach(views.relations(spark, d), "customer:1", 2, ["PLACED", "CONTAINS"])
    return found.where(F.col("entity_id").startswith("part:")).select("entity_id")


@query("graph_ui_view", f"WITH {_RELATIONS} SELECT c.c_custkey, substr(c.c_name, 1, 80) AS label, 'nation:' || c.c_nationkey AS nation_id, count(DISTINCT r.b) AS n_orders, coalesce(list_sort(list(DISTINCT r.b) FILTER (WHERE r.b IS NOT NULL)), []::VARCHAR[]) AS orders FROM customer c LEFT JOIN rel r ON r.a = 'customer:' || c.c_custkey AND r.t = 'PLACED' GROUP BY ALL")
def graph_ui_view(spark, d):
    """Nodes with the set of their optional neighbours."""
    placed = views.relations(spark, d).where("relation_type = 'PLACED'")
    c = views.table(spark, d, "customer").withColumn("source_id", F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")))
    rows = c.join(placed, "source_id", "left").groupBy("c_custkey", F.substring("c_name", 1, 80).alias("label"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("nation_id"))
    return rows.agg(F.countDistinct("target_id").alias("n_orders"), F.array_sort(F.collect_set("target_id")).alias("orders"))


# Fusion of the vector result (top 20 of two collections) with a graph result from node 3.
_SIDES = f"""{_SCORES}, {_EDGES}, {_walk('o', 0, 4, 'a', 'b')},
v AS (SELECT entity_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY s DESC, entity_id) AS k FROM scores WHERE collection IN (0, 1, 2)) WHERE k <= 30 ORDER BY s DESC, entity_id LIMIT 30),
g AS (SELECT entity_id, 1.0::DOUBLE / row_number() OVER (ORDER BY depth, entity_id) AS score FROM o)"""


def _fused_sql(select: str) -> str:
    return f"WITH RECURSIVE {_SIDES}, f AS ({select}) SELECT entity_id, round(score, 6) AS score, source, count(*) OVER () AS total_count, row_number() OVER (ORDER BY score DESC, entity_id) AS rank FROM f ORDER BY score DESC, entity_id LIMIT 30"


_SOURCE = "CASE WHEN v.entity_id IS NOT NULL AND g.entity_id IS NOT NULL THEN 'hybrid' WHEN v.entity_id IS NOT NULL THEN 'vector' ELSE 'graph' END AS source"
_FUSIONS = {
    "fuse_union": ("union", f"SELECT coalesce(v.entity_id, g.entity_id) AS entity_id, CASE WHEN v.score IS NOT NULL AND g.score IS NOT NULL THEN (v.score + g.score) / 2 ELSE coalesce(v.score, g.score) END AS score, {_SOURCE} FROM v FULL JOIN g ON v.entity_id = g.entity_id"),
    "fuse_intersection": ("intersection", f"SELECT v.entity_id, v.score, {_SOURCE} FROM v JOIN g ON v.entity_id = g.entity_id"),
    "fuse_rrf": ("rank_fusion", "SELECT entity_id, sum(part) AS score, 'hybrid' AS source FROM (SELECT entity_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, entity_id)) AS part FROM v UNION ALL SELECT entity_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, entity_id)) FROM g) GROUP BY entity_id"),
    "fuse_vector_priority": ("vector_priority", f"SELECT v.entity_id, v.score, {_SOURCE} FROM v LEFT JOIN g ON v.entity_id = g.entity_id"),
    "fuse_vector_only": ("vector_only", "SELECT entity_id, score, 'vector' AS source FROM v"),
    "fuse_graph_only": ("graph_only", "SELECT entity_id, score, 'graph' AS source FROM g"),
    "fuse_graph_priority": ("graph_priority", f"SELECT g.entity_id, coalesce(v.score, g.score) AS score, {_SOURCE} FROM g LEFT JOIN v ON v.entity_id = g.entity_id"),
}


def _fusion(strategy: str):
    def run(spark, d):
        q = fusion.HybridQuery(fusion.VectorQuery(views.query_vector(spark, d), [0, 1, 2], 30), fusion.GraphQuery(0, depth=4), strategy)
        return _rounded(fusion.hybrid(views.vectors(spark, d), views.vector_entities(spark, d), views.vector_edges(spark, d), q)).select("entity_id", "score", "source", "total_count", "rank")

    return run


for _name, (_strategy, _select) in _FUSIONS.items():
    query(_name, _fused_sql(_select))(_fusion(_strategy))

# Time series.
_MS = "(epoch_us(ts) // 1000)"


def _bucket_sql(width: int) -> str:
    return f"SELECT event_type AS name, ({_MS} // {width}) * {width} AS bucket, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value, round(sum(value), 4) AS sum_value, count(*) AS n FROM events GROUP BY ALL"


def _tumbling(window: str):
    def run(spark, d):
        return _rounded(_rounded(A.tumbling(views.points(spark, d), window), "avg_value"), "sum_value", 4)

    return run


for _name, _width in A.WINDOWS.items():
    query(f"ts_{_name}", _bucket_sql(_width))(_tumbling(_name))


@query("ts_moving_avg", "SELECT event_type AS name, event_id AS seq, round(avg(value) OVER w, 6) AS moving_avg FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 9 PRECEDING) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) >= 10")
def ts_moving_avg(spark, d):
    return _rounded(A.moving_average(views.points(spark, d), 10), "moving_avg")


@query("ts_rate", f"SELECT name, seq, round(dv / (dt / 1000.0::DOUBLE), 10) AS rate FROM (SELECT event_type AS name, event_id AS seq, {_MS} - lag({_MS}) OVER w AS dt, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) WHERE dt > 0")
def ts_rate(spark, d):
    return _rounded(A.rate_of_change(views.points(spark, d)), "rate", 10)


_KEPT = "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY event_id) AS k, count(*) OVER (PARTITION BY op) AS m FROM q) WHERE k > CASE WHEN m > 10000 THEN ceil((m - 10000) / 1000.0) * 1000 ELSE 0 END)"


@query("ts_query_stats", f"""WITH q AS (SELECT 'all' AS op, event_id, value AS duration, event_type = 'error' AS failed FROM events UNION ALL SELECT event_type, event_id, value, value > 50 FROM events), {_KEPT},
p AS (SELECT op, avg(duration) AS avg_duration, list_sort(list(duration)) AS v FROM kept GROUP BY op)
SELECT op, total, round(error_rate, 6) AS error_rate, round(avg_duration, 6) AS avg_duration, v[CAST(round(0.5 * (len(v) - 1)) AS INT) + 1] AS p50, v[CAST(round(0.95 * (len(v) - 1)) AS INT) + 1] AS p95, v[CAST(round(0.99 * (len(v) - 1)) AS INT) + 1] AS p99
FROM (SELECT op, count(*) AS total, avg(CAST(failed AS DOUBLE)) AS error_rate FROM q GROUP BY op) JOIN p USING (op)""")
def ts_query_stats(spark, d):
    e = views.table(spark, d, "events")
    one = e.select(F.lit("all").alias("op"), F.col("event_id").alias("seq"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed"))
    each = e.select(F.col("event_type").alias("op"), F.col("event_id").alias("seq"), F.col("value").alias("duration"), (F.col("value") > 50).alias("failed"))
    return _rounded(_rounded(A.query_stats(one.unionByName(each), ["op"]), "error_rate"), "avg_duration")


@query("ts_perf", "SELECT event_type AS name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min_value, max(value) AS max_value, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1")
def ts_perf(spark, d):
    return _rounded(_rounded(A.performance(views.points(spark, d), ["name"], "value"), "mean"), "std")


@query("ts_zscore", """WITH s AS (SELECT event_type AS name, avg(value) AS expected, stddev_pop(value) AS sd, count(*) AS n FROM events GROUP BY 1), z AS (SELECT name, event_id AS seq, value, expected, abs(value - expected) / sd AS z FROM events JOIN s ON name = event_type WHERE n >= 10 AND sd > 0)
SELECT name, seq, value, round(expected, 6) AS expected, round(z, 6) AS z, CASE WHEN z > 3 THEN 'critical' WHEN z > 2.25 THEN 'high' WHEN z > 1.7999999999999998 THEN 'medium' ELSE 'low' END AS severity FROM z WHERE z > 1.5""")
def ts_zscore(spark, d):
    return _rounded(_rounded(A.z_score_anomalies(views.points(spark, d), 1.5), "expected"), "z")


@query("ts_sudden", """WITH c AS (SELECT event_type AS name, event_id AS seq, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before, value FROM events), x AS (SELECT *, abs((value - before) / before) * 100 AS change FROM c WHERE before <> 0)
SELECT name, seq, before, value, round(change, 6) AS change, CASE WHEN change > 100 THEN 'critical' WHEN change > 75 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE change > 50""")
def ts_sudden(spark, d):
    return _rounded(A.sudden_changes(views.points(spark, d), 50.0), "change")


@query("ts_slow", "SELECT event_id, value AS duration FROM events WHERE value > 90")
def ts_slow(spark, d):
    return A.slow_rows(views.table(spark, d, "events").select("event_id", F.col("value").alias("duration")), 90.0)


@query("ts_retention", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def ts_retention(spark, d):
    e = views.table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), F.col("ts") > F.expr("now - INTERVAL 1 DAY")).select("event_id")


@query("ts_peer_outliers", "WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) SELECT event_id, user_id, value FROM events JOIN s USING (user_id) WHERE sd > 0 AND abs(value - m) > 2.5 * sd")
def ts_peer_outliers(spark, d):
    return A.peer_outliers(views.table(spark, d, "events"), "user_id", "value").select("event_id", "user_id", "value")


@query("ts_sliding_rate", """WITH w AS (SELECT epoch_us(ts) // 1000000 // 1800 * 1800 - 1800 * k AS s FROM events, range(2) t(k)) SELECT make_timestamp(s * 1000000) AS start, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM w GROUP BY s""")
def ts_sliding_rate(spark, d):
    rows = A.sliding_rate(views.table(spark, d, "events"), "1 hour", "30 minutes")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("per_second", 9).alias("per_second"))


# Counts and logs.
@query("count_by_type", """SELECT 'Region' AS entity_type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part""")
def count_by_type(spark, d):
    return views.entities(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("trace_sizes", "SELECT size, count(*) AS n_traces FROM (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1) GROUP BY 1")
def trace_sizes(spark, d):
    sizes = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_traces"))


@query("error_rate_by_type", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate FROM events GROUP BY 1")
def error_rate_by_type(spark, d):
    errors = F.count_if(T.is_error_level(F.col("event_type")))
    return views.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), errors.alias("errors"), F.round(errors / F.count("*"), 6).alias("error_rate"))


@query("agent_counters", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def agent_counters(spark, d):
    return views.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("token_stats", "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(length(text))::BIGINT // count(*) AS avg_chars, max(length(text)) AS longest FROM conversations WHERE text IS NOT NULL GROUP BY role")
def token_stats(spark, d):
    c = views.table(spark, d, "conversations").where(F.col("text").isNotNull()).withColumn("k", F.length("text").cast("long"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum("k").alias("chars"), F.expr("sum(k) div count(*)").alias("avg_chars"), F.max("k").alias("longest"))


@query("recent_activity", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_activity(spark, d):
    return views.table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "event_type")


# Ontology and validation.
_ONTO = """types(t, p) AS (VALUES ('Thing', NULL), ('Party', 'Thing'), ('Customer', 'Party'), ('Supplier', 'Party'), ('Place', 'Thing'), ('Region', 'Place'), ('Nation', 'Place'), ('Order', 'Thing'), ('Part', 'Thing')),
closure(sub, super, depth) AS (SELECT t, t, 0 FROM types UNION ALL SELECT c.sub, t.p, c.depth + 1 FROM closure c JOIN types t ON c.super = t.t WHERE t.p IS NOT NULL),
rels(r, dom, ran, inv, sym) AS (VALUES ('IN_REGION', 'Nation', 'Region', NULL, false), ('IN_NATION', 'Party', 'Nation', NULL, false), ('PLACED', 'Customer', 'Order', 'PLACED_BY', false), ('PLACED_BY', 'Order', 'Customer', NULL, false), ('CONTAINS', 'Order', 'Part', NULL, false), ('PARTNER_OF', 'Party', 'Party', NULL, true))"""


_INFERRED = "SELECT sub AS type, r AS relation, sub AS source, ran AS target, 'SubtypeInheritance' AS reason FROM rels JOIN closure ON super = dom UNION ALL SELECT sub, r, ran, sub, 'Symmetric' FROM rels JOIN closure ON super = dom WHERE sym UNION ALL SELECT sub, inv, ran, sub, 'Inverse' FROM rels JOIN closure ON super = dom WHERE inv IS NOT NULL"


@query("scan_expanded", "SELECT 'customer:' || c_custkey AS entity_id, 'Customer' AS entity_type FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier' FROM supplier")
def scan_expanded(spark, d):
    return views.entities(spark, d).where(F.col("entity_type").isin(views.ONTOLOGY.expand_or_self("Party"))).select("entity_id", "entity_type")


@query("validate_entities", """SELECT 'customer:' || c_custkey AS entity_id, unnest(list_filter([CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'ConstraintViolation balance' END,
CASE WHEN strlen(c_name) > 18 THEN 'ConstraintViolation name' WHEN strlen(c_mktsegment) > 18 THEN 'ConstraintViolation segment' END], lambda x: x IS NOT NULL)) AS error FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'MissingRequiredProperty balance' FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'InvalidPropertyType size' FROM part UNION ALL SELECT 'region:' || r_regionkey, 'UnknownEntityType ' FROM region""")
def validate_entities(spark, d):
    checked = validate.validate_entities(views.property_rows(spark, d), views.ONTOLOGY, [])
    return checked.select("entity_id", F.explode("errors").alias("e")).select("entity_id", F.concat("e.kind", F.lit(" "), F.coalesce("e.property", F.lit(""))).alias("error"))


@query("validation_report", """SELECT 'Customer' AS entity_type, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000 OR strlen(c_name) > 18 OR strlen(c_mktsegment) > 18) AS n_invalid FROM customer UNION ALL SELECT 'Supplier', count(*), count(*) FROM supplier UNION ALL SELECT 'Part', count(*), count(*) FROM part UNION ALL SELECT 'Continent', count(*), count(*) FROM region""")
def validation_report(spark, d):
    checked = validate.validate_entities(views.property_rows(spark, d), views.ONTOLOGY, [])
    return checked.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("n_invalid"))


_BAD_RELATIONS = f"""{_RELATIONS}, odd AS (SELECT * FROM rel UNION ALL SELECT 'PLACED', b, a FROM rel WHERE t = 'PLACED' AND a LIKE 'customer:%7' UNION ALL SELECT 'UNHEARD_OF', a, b FROM rel WHERE t = 'IN_REGION' UNION ALL SELECT 'IN_NATION', a, 'nation:999' FROM rel WHERE t = 'IN_NATION' AND a LIKE 'supplier:%')"""


@query("validate_relations", f"SELECT relation_type, coalesce(error, 'none') AS error, count(*) AS n FROM (WITH {_BAD_RELATIONS} SELECT t AS relation_type, CASE WHEN t = 'UNHEARD_OF' THEN 'UnknownRelationType' WHEN b = 'nation:999' THEN 'MissingTarget' WHEN t = 'PLACED' AND a LIKE 'order:%' THEN 'IncompatibleTypes' END AS error FROM odd) GROUP BY ALL")
def validate_relations(spark, d):
    r = views.relations(spark, d)
    turned = r.where("relation_type = 'PLACED' AND source_id LIKE 'customer:%7'").select("relation_type", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    unknown = r.where("relation_type = 'IN_REGION'").withColumn("relation_type", F.lit("UNHEARD_OF"))
    lost = r.where("relation_type = 'IN_NATION' AND source_id LIKE 'supplier:%'").withColumn("target_id", F.lit("nation:999"))
    checked = validate.validate_relations(r.unionByName(turned).unionByName(unknown).unionByName(lost), views.entities(spark, d), views.ONTOLOGY)
    return checked.groupBy("relation_type", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


# Store.
@query("store_latest_wins", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def store_latest_wins(spark, d):
    return store.latest(views.table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("store_delete_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def store_delete_anti(spark, d):
    gone = views.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return store.delete(views.table(spark, d, "customer"), gone, "c_custkey").select("c_custkey", "c_name")


@query("relation_endpoints", "SELECT l_orderkey, l_partkey, l_linenumber, (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS accepted FROM lineitem")
def relation_endpoints(spark, d):
    ids = views.table(spark, d, "orders").where("o_totalprice > 100000").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("entity_id"))
    ids = ids.unionByName(views.table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("entity_id")))
    lines = views.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return store.with_accepted(lines, ids, F.concat(F.lit("o"), F.col("l_orderkey")), F.concat(F.lit("p"), F.col("l_partkey")))


@query("store_merge_edges", "SELECT DISTINCT user_id, event_type FROM events")
def store_merge_edges(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.lit("DID").alias("relation_type"), F.col("event_type").alias("target_id"))
    return store.merge_edges(e.limit(0), e).select(F.col("source_id").alias("user_id"), F.col("target_id").alias("event_type"))


@query("store_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def store_page(spark, d):
    return store.page(views.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 25)


@query("event_ingest_session", "SELECT event_id, 'trace:' || first_value(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS trace_id FROM events")
def event_ingest_session(spark, d):
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    e = views.table(spark, d, "events").select("event_id", "ts", session.alias("session_id"), F.col("user_id").alias("agent_id"), F.lit(None).cast("string").alias("trace_id"))
    return store.assign_sessions(e).select("event_id", "trace_id")


@query("ingest_report", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS ingested, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def ingest_report(spark, d):
    e = views.table(spark, d, "events").withColumn("trace_id", F.when(F.col("event_type") != "error", F.lit("t")))
    return store.ingest_report(e, auto_create=False).agg(F.count_if("ok").alias("ingested"), F.count_if(~F.col("ok")).alias("failed"))


@query("dedup_log_id", "SELECT event_id, user_id || '/' || event_type AS log_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedup_log_id(spark, d):
    e = views.table(spark, d, "events").withColumn("log_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return store.drop_replays(e).select("event_id", "log_id")


@query("trace_assignment", "SELECT CAST(user_id AS VARCHAR) AS agent_id, event_id, epoch_us(ts) // 1000 AS ts_ms, CAST(NULL AS VARCHAR) AS session_id, 'trace:' || event_id AS trace_id, true AS created FROM events")
def trace_assignment(spark, d):
    """Each user an agent without sessions: every event starts a trace. trace_assignment_sessions has the other rules."""
    e = views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("agent_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("trace_id"))
    return traces.assign_traces(e)


# Logs and text.
_MESSAGES = "SELECT event_id, CASE event_type WHEN 'click' THEN 'Running Search' || user_id || ' tool with input: q' WHEN 'view' THEN 'Entering new Chain' || user_id || ' chain' WHEN 'error' THEN 'query: ' || user_id || ' request_id: req-' || event_id WHEN 'purchase' THEN props ELSE 'plain session_id: s' || user_id END AS message FROM events"


@query("log_parse", rf"""WITH m AS ({_MESSAGES}) SELECT event_id, CASE WHEN starts_with(message, 'Running') OR starts_with(message, 'Entering') THEN 'tool_call' WHEN starts_with(message, 'query') THEN 'query' END AS event_type,
nullif(regexp_extract(message, 'session_id: ([\w-]+)', 1), '') AS own, coalesce(nullif(regexp_extract(message, 'session_id: ([\w-]+)', 1), ''), nullif(regexp_extract(message, 'request_id: ([\w-]+)', 1), '')) AS session_id,
nullif(regexp_extract(message, '(?:Running|Entering new) (\w+)', 1), '') AS tool, nullif(regexp_extract(message, 'query: (.+)', 1), '') AS query, json_extract_string(CASE WHEN starts_with(message, '{{') THEN message END, '$.k') AS k FROM m""")
def log_parse(spark, d):
    e = views.table(spark, d, "events")
    rules = [logs.Rule("chain", "langchain", priority=20), logs.Rule("index", "llamaindex", priority=30), logs.Rule("json", "json", priority=10)]
    message = F.expr(_MESSAGES.removeprefix("SELECT event_id, ").removesuffix(" AS message FROM events"))
    rows = logs.parse_logs(e.select("event_id", message.alias("message")), rules)
    p = lambda k: F.try_element_at("properties", F.lit(k))
    own = F.nullif(F.regexp_extract("message", logs.SESSION, 1), F.lit(""))
    return rows.select("event_id", "event_type", own.alias("own"), "session_id", p("tool_name").alias("tool"), p("query").alias("query"), p("k").alias("k"))


@query("props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_extract(spark, d):
    return views.table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("followed_by", "SELECT user_id, event_id AS item_id, lead(event_id) OVER w AS next_id, epoch_us(lead(ts) OVER w) // 1000 - epoch_us(ts) // 1000 AS time_delta_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lead(event_id) OVER w IS NOT NULL")
def followed_by(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("item_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))
    return logs.followed_by(e).withColumnRenamed("chain", "user_id")


@query("short_id", "SELECT c_custkey, substr(translate(to_base64(unhex(sha1(c_name))), '+/=', 'AB'), 1, 10) AS short_id FROM customer")
def short_id(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", T.short_id(F.col("c_name")).alias("short_id"))


@query("entity_text", "SELECT p_partkey, 'brand: ' || p_brand || '. name: ' || p_name || '. size: ' || p_size || '. type: ' || p_type AS text FROM part")
def entity_text(spark, d):
    p = views.table(spark, d, "part")
    entries = F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("none"), F.lit(None).cast("string"))
    return p.select("p_partkey", T.entity_text(entries).alias("text"))


@query("searchable_text", "SELECT c_custkey, c_name || ' | status: ' || c_mktsegment || ' | ' || c_nationkey AS text FROM customer")
def searchable_text(spark, d):
    c = views.table(spark, d, "customer")
    return c.select("c_custkey", T.searchable_text([F.col("c_name"), F.concat(F.lit("status: "), F.col("c_mktsegment"))], F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("x"), F.lit(None).cast("string"))).alias("text"))


@query("node_labels", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, ''), substr('order:' || o_orderkey, 1, 8)) AS label FROM orders")
def node_labels(spark, d):
    name = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))
    return views.table(spark, d, "orders").select("o_orderkey", T.node_label(name, F.lit(None).cast("string"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))).alias("label"))


@query("trace_with_events", "SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def trace_with_events(spark, d):
    c = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", "n", F.col("t.role").alias("roles"))


@query("agent_events_by_range", "SELECT event_id, ts, value FROM events WHERE user_id = 7 AND event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def agent_events_by_range(spark, d):
    e = views.table(spark, d, "events")
    return e.where("user_id = 7 AND event_type IN ('click', 'view') AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20'").select("event_id", "ts", "value")


@query("entity_lookup", "SELECT 'customer:' || c_custkey AS entity_id, 'Customer' AS entity_type FROM customer WHERE c_custkey IN (1, 5) UNION ALL SELECT 'part:' || p_partkey, 'Part' FROM part WHERE p_partkey = 2")
def entity_lookup(spark, d):
    return store.get(views.entities(spark, d), "entity_id", ["customer:1", "customer:5", "part:2", "part:none"]).select("entity_id", "entity_type")


@query("scan_type", "SELECT 'order:' || o_orderkey AS entity_id FROM orders")
def scan_type(spark, d):
    return views.entities(spark, d).where("entity_type = 'Order'").select("entity_id")


@query("list_by_label", "SELECT 'part:' || p_partkey AS entity_id, p_name AS name FROM part ORDER BY p_name, entity_id LIMIT 20")
def list_by_label(spark, d):
    return store.list_by_label(views.entities(spark, d), "Part", "name", 20).select("entity_id", "name")


@query("schema_put", "SELECT event_type AS namespace, max(event_id) AS version FROM events GROUP BY 1")
def schema_put(spark, d):
    """Even events are known schemas, odd ones new; ids serve as times."""
    e = views.table(spark, d, "events").select(F.col("event_type").alias("namespace"), F.col("event_id").alias("created_at"))
    return store.put_schema(e.where("created_at % 2 = 0"), e.where("created_at % 2 = 1")).select("namespace", F.col("created_at").alias("version"))


@query("vectors_with_metadata", "SELECT vec_id AS entity_id, 'item-' || vec_id AS name, label AS collection FROM embeddings")
def vectors_with_metadata(spark, d):
    return views.vectors(spark, d).drop("embedding").join(views.vector_entities(spark, d), "entity_id")


@query("graph_symmetric", f"WITH RECURSIVE {_EDGES.replace('edges AS', 'given AS', 1)}, edges AS (SELECT * FROM given UNION ALL SELECT t, b, a FROM given WHERE t = 'near'), {_walk('o', 3, 3, 'a', 'b')} SELECT entity_id, CAST(depth AS INTEGER) AS depth FROM o")
def graph_symmetric(spark, d):
    return graph.reach(graph.with_symmetric(views.vector_edges(spark, d), ["near"]), 3, 3)


@query("vec_similar_edges", f"WITH {_SCORES}, {_EDGES} SELECT entity_id, round(s, 6) AS score, string_agg(t || '>' || b, ' ' ORDER BY t, b) AS edges FROM scores JOIN edges ON a = entity_id WHERE s >= 0.1 GROUP BY ALL")
def vec_similar_edges(spark, d):
    found = _rounded(vector.similar_with_edges(views.vectors(spark, d), views.vector_edges(spark, d), views.query_vector(spark, d), 0.1))
    return found.select("entity_id", "score", F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["relation_type"], e["target_id"].cast("string"))), " ").alias("edges"))


@query("vec_inferred", f"WITH RECURSIVE {_ONTO}, {_SCORES}, h AS (SELECT * FROM scores WHERE collection BETWEEN 0 AND 2 QUALIFY row_number() OVER (PARTITION BY collection ORDER BY s DESC, entity_id) <= 3), i AS ({_INFERRED}) SELECT entity_id, i.relation, i.source, i.target, i.reason FROM h JOIN i ON i.type = (['Customer', 'Supplier', 'Nation'])[h.collection + 1]")
def vec_inferred(spark, d):
    """The best of three collections, taken as customers, suppliers and nations, with their types' relations."""
    kind = F.element_at(F.array(F.lit("Customer"), F.lit("Supplier"), F.lit("Nation")), F.col("collection").cast("int") + 1)
    hits = vector.top_k_per_collection(views.vectors(spark, d), views.query_vector(spark, d), 3, [0, 1, 2]).withColumn("type", kind)
    return vector.with_inferred(hits, views.ONTOLOGY.inferred_table(spark)).select("entity_id", "relation", "source", "target", "reason")


@query("event_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 7200500 MILLISECONDS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark, d):
    found = A.sessions(views.table(spark, d, "events"), ["user_id"], "7200 seconds 500 milliseconds")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("audit_by_day", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def audit_by_day(spark, d):
    return A.audit(views.table(spark, d, "events"), F.expr("TIMESTAMP_NTZ '2024-01-05'"), F.expr("TIMESTAMP_NTZ '2024-01-20'"), "event_type")


for _part in (catalogue_more, catalogue_reason):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
