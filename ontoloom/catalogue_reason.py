"""Queries of type hierarchies and rules over tables, shared sessions, indexes, fitted embeddings, clusters and counters, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import embedding, fitted
from ontoloom.functions import text as T
from ontoloom.operators import clusters, graph, ivf, rates, store, vector
from ontoloom.plans import hierarchy, rules, views
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


def _str(prefix: str, column) -> F.Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# Types: one for each customer, under the type of half its key. Relation types: one for each nation, between two subtrees.
_TYPES = "types AS (SELECT 't' || c_custkey AS id, CASE WHEN c_custkey > 0 THEN 't' || (c_custkey // 2) END AS parent FROM customer)"
_CLOSED = f"{_TYPES}, closed AS (SELECT id AS sub, id AS super, 0 AS depth FROM types UNION ALL SELECT c.sub, t.parent, c.depth + 1 FROM closed c JOIN types t ON c.super = t.id WHERE t.parent IS NOT NULL)"
_RELS = """rels AS (SELECT 'r' || n_nationkey AS id, 't' || (40 + n_nationkey) AS domain, 't' || (70 + n_nationkey) AS range,
CASE WHEN n_nationkey % 3 = 0 THEN 'inv' || n_nationkey END AS inverse, n_nationkey % 4 = 0 AS mutual FROM nation)"""


def _types(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    return views.table(spark, d, "customer").select(_str("t", key).alias("id"), F.when(key > 0, _str("t", F.floor(key / 2))).alias("parent"))


def _relation_types(spark, d) -> DataFrame:
    key = F.col("n_nationkey")
    return views.table(spark, d, "nation").select(
        _str("r", key).alias("id"), _str("t", key + 40).alias("domain"), _str("t", key + 70).alias("range"), F.when(key % 3 == 0, _str("inv", key)).alias("inverse"), (key % 4 == 0).alias("symmetric")
    )


@query("onto_closure", f"WITH RECURSIVE {_CLOSED} SELECT sub, super, depth FROM closed")
def onto_closure(spark, d):
    return hierarchy.closure(_types(spark, d))


@query(
    "onto_inferred",
    f"""WITH RECURSIVE {_CLOSED}, {_RELS}, met AS (SELECT r.*, c.sub AS type FROM rels r JOIN closed c ON c.super = r.domain)
SELECT type, id AS relation, type AS source, range AS target, 'SubtypeInheritance' AS reason FROM met UNION ALL SELECT type, id, range, type, 'Symmetric' FROM met WHERE mutual
UNION ALL SELECT type, inverse, range, type, 'Inverse' FROM met WHERE inverse IS NOT NULL""",
)
def onto_inferred(spark, d):
    return hierarchy.inferred(hierarchy.closure(_types(spark, d)), _relation_types(spark, d))


@query("onto_compatible", f"WITH RECURSIVE {_CLOSED}, {_RELS} SELECT a.sub AS source_type, b.sub AS target_type, r.id AS relation_type FROM rels r JOIN closed a ON a.super = r.domain JOIN closed b ON b.super = r.range")
def onto_compatible(spark, d):
    return hierarchy.compatible(hierarchy.closure(_types(spark, d)), _relation_types(spark, d))


@query(
    "onto_expansions",
    f"""WITH RECURSIVE {_CLOSED}, {_RELS}, met AS (SELECT c.sub AS type, 1 + CAST(mutual AS INTEGER) + CAST(inverse IS NOT NULL AS INTEGER) AS n FROM rels r JOIN closed c ON c.super = r.domain),
own AS (SELECT super AS type, count(*) AS type_count FROM closed GROUP BY 1), sums AS (SELECT type, sum(n) AS n FROM met GROUP BY 1)
SELECT type, type_count, CAST(coalesce(n, 0) AS BIGINT) AS relation_count FROM own LEFT JOIN sums USING (type)""",
)
def onto_expansions(spark, d):
    """For every type how many types and inferred relations a query for it stands for."""
    return hierarchy.expansions(hierarchy.closure(_types(spark, d)), _relation_types(spark, d))


_BROKEN = """types AS (SELECT 't' || c_custkey AS id, CASE WHEN c_custkey % 97 = 5 THEN 'lost' || c_custkey WHEN c_custkey % 50 = 20 THEN 't' || (c_custkey + 1) WHEN c_custkey % 50 = 21 THEN 't' || (c_custkey - 1)
WHEN c_custkey > 0 THEN 't' || (c_custkey // 2) END AS parent FROM customer)"""


@query(
    "onto_errors",
    f"""WITH RECURSIVE {_BROKEN}, {_RELS}, up AS (SELECT id AS sub, parent AS super FROM types WHERE parent IS NOT NULL UNION SELECT u.sub, t.parent FROM up u JOIN types t ON u.super = t.id WHERE t.parent IS NOT NULL),
loops AS (SELECT sub AS id FROM up WHERE sub = super)
SELECT 'cycle' AS kind, id, CAST(NULL AS VARCHAR) AS name FROM (SELECT id FROM loops UNION SELECT sub FROM up JOIN loops ON super = loops.id)
UNION ALL SELECT 'missing parent', id, parent FROM types WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM types)
UNION ALL SELECT 'unknown domain', id, domain FROM rels WHERE domain NOT IN (SELECT id FROM types) UNION ALL SELECT 'unknown range', id, range FROM rels WHERE range NOT IN (SELECT id FROM types)
UNION ALL SELECT 'unknown inverse', id, inverse FROM rels WHERE inverse IS NOT NULL AND inverse NOT IN (SELECT id FROM rels)""",
)
def onto_errors(spark, d):
    """Types with cycles and missing parents."""
    key = F.col("c_custkey")
    parent = F.when(key % 97 == 5, _str("lost", key)).when(key % 50 == 20, _str("t", key + 1)).when(key % 50 == 21, _str("t", key - 1)).when(key > 0, _str("t", F.floor(key / 2)))
    return hierarchy.errors(views.table(spark, d, "customer").select(_str("t", key).alias("id"), parent.alias("parent")), _relation_types(spark, d))


# Rules: parts have their brand and size as types; brands are under groups, one pair is equivalent, one pair disjoint; suppliers manage in chains.
RULES = [
    {"id": "brand", "rule_type": "SubClassOf", "conditions": [], "conclusion": {"subject": "group:1", "predicate": "subClassOf", "object": "Branded"}},
    {"id": "same", "rule_type": "Equivalent", "conditions": [], "conclusion": {"subject": "Brand#3", "predicate": "=", "object": "Premium"}},
    {"id": "apart", "rule_type": "Disjoint", "conditions": [], "conclusion": {"subject": "Branded", "predicate": "!=", "object": "size:7"}},
    {"id": "chain", "rule_type": "PropertyChain", "conditions": [{"subject": "?x", "predicate": "manages", "object": "?y"}, {"subject": "?y", "predicate": "manages", "object": "?z"}], "conclusion": {"subject": "?x", "predicate": "manages", "object": "?z"}},
    {"id": "back", "rule_type": {"Custom": "inverse"}, "conditions": [{"subject": "?x", "predicate": "manages", "object": "?y"}], "conclusion": {"subject": "?y", "predicate": "managed_by", "object": "?x"}},
]
_FACTS = """base AS (
  SELECT 'part:' || p_partkey AS s, 'type' AS p, p_brand AS o FROM part UNION SELECT 'part:' || p_partkey, 'type', 'size:' || p_size FROM part
  UNION SELECT p_brand, 'subClassOf', 'group:' || (CAST(substr(p_brand, 7) AS INTEGER) % 4) FROM part UNION SELECT 'group:1', 'subClassOf', 'Branded'
), subs(a, b) AS (
  SELECT s, o FROM base WHERE p = 'subClassOf' UNION SELECT 'Brand#3', 'Premium' UNION SELECT 'Premium', 'Brand#3' UNION SELECT x.a, y.b FROM subs x JOIN (SELECT s AS a, o AS b FROM base WHERE p = 'subClassOf' UNION SELECT 'Brand#3', 'Premium' UNION SELECT 'Premium', 'Brand#3') y ON x.b = y.a
), types(s, o) AS (SELECT s, o FROM base WHERE p = 'type' UNION SELECT t.s, b FROM base t JOIN subs ON t.o = subs.a WHERE t.p = 'type'),
manages(s, o) AS (SELECT s_suppkey // 2, s_suppkey FROM supplier WHERE s_suppkey > 0 UNION SELECT m.s, x.s_suppkey FROM manages m JOIN supplier x ON x.s_suppkey > 0 AND x.s_suppkey // 2 = m.o)"""


def _inferred(spark, d) -> DataFrame:
    part, supplier = views.table(spark, d, "part"), views.table(spark, d, "supplier")
    of = lambda s, p, o, rows: rows.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    facts = of(_str("part:", "p_partkey"), "type", F.col("p_brand"), part).unionByName(of(_str("part:", "p_partkey"), "type", _str("size:", "p_size"), part))
    facts = facts.unionByName(of(F.col("p_brand"), "subClassOf", _str("group:", F.substring("p_brand", 7, 9).cast("int") % 4), part))
    facts = facts.unionByName(of(_str("supplier:", F.floor(F.col("s_suppkey") / 2)), "manages", _str("supplier:", "s_suppkey"), supplier.where("s_suppkey > 0")))
    compiled, stated = rules.compile_rules(RULES)
    return rules.infer(facts.unionByName(spark.createDataFrame(stated, "subject string, predicate string, object string")), compiled)


@query(
    "rules_inferred",
    f"""WITH RECURSIVE {_FACTS} SELECT s AS subject, 'type' AS predicate, o AS object FROM types UNION ALL SELECT a, 'subClassOf', b FROM (SELECT DISTINCT a, b FROM subs)
UNION ALL SELECT * FROM (VALUES ('Brand#3', 'equivalentTo', 'Premium'), ('Premium', 'equivalentTo', 'Brand#3'), ('Branded', 'disjointWith', 'size:7'))
UNION ALL SELECT DISTINCT 'supplier:' || s, 'manages', 'supplier:' || o FROM manages UNION ALL SELECT DISTINCT 'supplier:' || o, 'managed_by', 'supplier:' || s FROM manages""",
)
def rules_inferred(spark, d):
    return _inferred(spark, d).select("subject", "predicate", "object")


@query("rules_violations", f"WITH RECURSIVE {_FACTS} SELECT DISTINCT x.s AS subject, 'Branded' AS first, 'size:7' AS second FROM types x JOIN types y ON x.s = y.s AND x.o = 'Branded' AND y.o = 'size:7'")
def rules_violations(spark, d):
    """Parts of disjoint types."""
    return rules.violations(_inferred(spark, d))


@query("functional_repeats", "SELECT 'customer:' || o_custkey AS source_id, 'PLACED' AS relation_type, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def functional_repeats(spark, d):
    """Customers with more than one order, if PLACED and IN_NATION were functional."""
    return hierarchy.functional_repeats(views.relations(spark, d), spark.createDataFrame([("PLACED",), ("IN_NATION",)], "id string"))


# Sessions that agents share: users are agents; ten teams have a session for every few hours.
_SHARED = """WITH RECURSIVE e AS (SELECT event_id AS id, user_id, user_id % 10 AS team, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'click' THEN (user_id % 10) || '/' || (epoch_us(ts) // 21600000000) || '/' || (event_id % 3) END AS session,
CASE WHEN event_id % 17 = 3 THEN 'given:' || user_id END AS given, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
w(team, k, id, user_id, ms, session, trace_id, created, sessions, latest) AS (
  SELECT team, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false, MAP {'': CAST('' AS VARCHAR)}, MAP {CAST(-1 AS BIGINT): {'ms': CAST(0 AS BIGINT), 'trace': CAST('' AS VARCHAR)}} FROM (SELECT DISTINCT team FROM e)
  UNION ALL
  SELECT team, k, id, user_id, ms, session, coalesce(found, own), found IS NULL, CASE WHEN found IS NULL AND session IS NOT NULL THEN map_concat(sessions, MAP {session: own}) ELSE sessions END,
    CASE WHEN found IS NULL THEN map_concat(latest, MAP {user_id: {'ms': ms, 'trace': own}}) ELSE latest END
  FROM (SELECT e.*, 'trace:' || e.id AS own, w.sessions, w.latest, CASE WHEN e.given IS NOT NULL THEN e.given WHEN e.session IS NULL THEN NULL
      ELSE coalesce(w.sessions[e.session], CASE WHEN w.latest[e.user_id].ms > e.ms - 3600000 THEN w.latest[e.user_id].trace END) END AS found
    FROM w JOIN e ON e.team = w.team AND e.k = w.k + 1))
SELECT CAST(user_id AS VARCHAR) AS agent_id, id AS event_id, ms AS ts_ms, session AS session_id, trace_id, created FROM w WHERE k > 0"""


@query("trace_assignment_shared", _SHARED)
def trace_assignment_shared(spark, d):
    """Sessions that users of a team share, events without session, and given traces."""
    team, ms = F.col("user_id") % 10, F.unix_millis(F.col("ts").cast("timestamp"))
    session = F.when(F.col("event_type") != "click", F.concat_ws("/", team.cast("string"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).cast("string"), (F.col("event_id") % 3).cast("string")))
    given = F.when(F.col("event_id") % 17 == 3, _str("given:", "user_id"))
    e = views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("agent_id"), "event_id", ms.alias("ts_ms"), session.alias("session_id"), given.alias("trace_id"))
    return traces.assign_traces(e)


# Counters: the events' values as counters that begin anew very often.
_RATE = """p AS (SELECT event_type AS name, event_id AS seq, epoch_us(ts) // 1000 AS timestamp, value FROM events WHERE value IS NOT NULL),
s AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS step FROM (SELECT *, lag(value) OVER (PARTITION BY name ORDER BY timestamp, seq) AS b FROM p)),
c AS (SELECT *, sum(step) OVER (PARTITION BY name ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY name ORDER BY timestamp, seq) AS k FROM s),
f AS (SELECT name, seq, timestamp, value, total, min(k) OVER (PARTITION BY name ORDER BY timestamp RANGE BETWEEN 6999999 PRECEDING AND CURRENT ROW) AS first FROM c),
r AS (SELECT f.name, f.seq, f.timestamp, f.value, greatest(f.total - c.total, 0) AS increase, greatest(f.total - c.total, 0) * 1000 / 7000000 AS rate FROM f JOIN c ON c.name = f.name AND c.k = f.first)"""


@query("ts_counter_rates", f"WITH {_RATE} SELECT name, seq, timestamp, value, round(increase, 4) AS increase, round(rate, 6) AS rate FROM r")
def ts_counter_rates(spark, d):
    found = rates.counter_rates(views.points(spark, d), 7_000_000)
    return found.select("name", "seq", "timestamp", "value", F.round("increase", 4).alias("increase"), F.round("rate", 6).alias("rate"))


@query("ts_summed_rates", f"WITH {_RATE}, last AS (SELECT name, (timestamp // 3600000 + 1) * 3600000 AS slot, rate, row_number() OVER (PARTITION BY name, timestamp // 3600000 ORDER BY timestamp DESC, seq DESC) AS k FROM r) SELECT slot AS timestamp, round(sum(rate), 6) AS rate FROM last WHERE k = 1 GROUP BY slot")
def ts_summed_rates(spark, d):
    return rates.summed_rates(views.points(spark, d), 7_000_000, 3_600_000).select("timestamp", F.round("rate", 6).alias("rate"))


# Indexes and clusters.
@query("vec_ivf")
def vec_ivf(spark, d):
    """The ten nearest of every item whose id is divisible by 100, by an index that probes as many lists as a sample of queries needs for 95 in 100."""
    rows = views.vectors(spark, d)
    index = ivf.IvfIndex.build(rows)
    sample = views.query_vectors(spark, d, 50).orderBy(F.xxhash64("query_id")).limit(200)  # only to choose the probes
    return index.search(rows, views.query_vectors(spark, d), 10, index.probes_for(rows, sample, 10))


_SCORES = "SELECT q.vec_id AS query_id, v.label AS collection, v.vec_id AS entity_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0"


@query("vec_ivf_all_lists", f"SELECT query_id, collection, entity_id, round(s, 6) AS score, row_number() OVER w AS rank FROM ({_SCORES}) WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, entity_id) QUALIFY row_number() OVER w <= 5")
def vec_ivf_all_lists(spark, d):
    """With every list probed and all codes refined, the index is exact: trained on one half of the rows, the other half appended."""
    rows = views.vectors(spark, d)
    index = ivf.IvfIndex.build(rows.where("entity_id % 2 = 0"))
    index.append(rows.where("entity_id % 2 = 1"))
    found = index.search(rows, views.query_vectors(spark, d), 5, ivf.MOST_LISTS, refine=40)
    return found.select("query_id", "collection", "entity_id", F.round("score", 6).alias("score"), "rank")


@query(
    "vec_clusters",
    """WITH RECURSIVE links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), low AS (SELECT a AS node, min(b) AS cluster FROM reach GROUP BY a)
SELECT node, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM low""",
)
def vec_clusters(spark, d):
    """At this low a cosine short keys in many tables are needed: a pair is missed with a probability below one in a million."""
    rows = views.vectors(spark, d).select(F.col("entity_id").alias("node"), "embedding")
    return clusters.similarity_clusters(rows, 0.45, bits=4, tables=80)


# Fitted embeddings.
def _fitted(spark, d) -> embedding.Provider:
    return fitted.fit(views.table(spark, d, "documents").select("text"))


@query("text_clusters")
def text_clusters(spark, d):
    """Documents grouped by similar texts, as error messages are: one row per cluster of two or more."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("text").alias("message"), F.col("doc_id").alias("ts"))
    found = clusters.error_clusters(embedding.embed_texts(docs, _fitted(spark, d), "message"), 0.98)
    return found.where("size > 1").select("cluster", "size", F.length("example").alias("example_chars"), "first_ts", "last_ts")


def _part_metadata(spark, d) -> DataFrame:
    pairs = [("role", "p_type"), ("goal", "p_name"), ("backstory", "p_brand")]
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.create_map(*[x for k, c in pairs for x in (F.lit(k), F.col(c))]).alias("metadata"))


@query("similar_by_metadata")
def similar_by_metadata(spark, d):
    """Of every item whose id is divisible by 100, the items with the most similar metadata text, at a similarity of 0.65 at least."""
    items = _part_metadata(spark, d)
    provider = fitted.fit(items.select(T.metadata_text(F.col("metadata")).alias("text")), dimension=16, features=1024)
    asked = items.where("entity_id % 100 = 0").select(F.col("entity_id").alias("query_id"), "metadata")
    return vector.similar_by_metadata(items, asked, provider)


@query("relation_expansions", f"WITH {_RELS} SELECT id AS relation, id AS stands_for FROM rels UNION SELECT id, inverse FROM rels WHERE inverse IS NOT NULL UNION SELECT inverse, id FROM rels WHERE inverse IS NOT NULL")
def relation_expansions(spark, d):
    return hierarchy.expand_relations(_relation_types(spark, d), extended=True)


# Thoughts: each event is one, of its user and, if its id is even, of a task; orders are tasks of customers.
_THOUGHTS = """thoughts AS (SELECT 'thought:' || event_id AS id, event_id AS step, event_type || ' ' || props || ' ' || repeat('x', CAST(event_id % 90 AS INTEGER)) AS content, 'agent:' || user_id AS agent, CASE WHEN event_id % 2 = 0 THEN 'task:' || (event_id * 3) END AS task FROM events),
agents AS (SELECT 'agent:' || c_custkey AS id, c_name AS name FROM customer), tasks AS (SELECT 'task:' || o_orderkey AS id, o_orderstatus AS name, 'agent:' || o_custkey AS agent FROM orders),
made AS (SELECT DISTINCT 'GENERATED_THOUGHT' AS type, agent AS source, id AS target FROM thoughts WHERE agent IN (SELECT id FROM agents)),
had AS (SELECT DISTINCT 'HAS_THOUGHT' AS type, task AS source, id AS target FROM thoughts WHERE task IN (SELECT id FROM tasks))"""


def _thoughts(spark, d) -> DataFrame:
    e = views.table(spark, d, "events")
    content = F.concat_ws(" ", "event_type", "props", F.repeat(F.lit("x"), (F.col("event_id") % 90).cast("int")))
    return e.select(_str("thought:", "event_id").alias("item_id"), F.col("event_id").alias("step_index"), content.alias("content"), _str("agent:", "user_id").alias("agent_id"), F.when(F.col("event_id") % 2 == 0, _str("task:", F.col("event_id") * 3)).alias("task_id"))


def _actors(spark, d) -> tuple[DataFrame, DataFrame]:
    agents = views.table(spark, d, "customer").select(_str("agent:", "c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return agents, views.table(spark, d, "orders").select(_str("task:", "o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("name"), _str("agent:", "o_custkey").alias("agent_id"))


def _thought_edges(spark, d) -> DataFrame:
    agents, tasks = _actors(spark, d)
    return store.linked_rows(_thoughts(spark, d), agents, tasks, "GENERATED_THOUGHT", "HAS_THOUGHT")[1]


@query("thought_edges", f"WITH {_THOUGHTS} SELECT type AS relation_type, source AS source_id, target AS target_id FROM (FROM made UNION ALL FROM had)")
def thought_edges(spark, d):
    return _thought_edges(spark, d)


def _picture(spark, d) -> tuple[DataFrame, DataFrame]:
    (agents, tasks), thoughts = _actors(spark, d), _thoughts(spark, d)
    belongs = tasks.select(F.lit("BELONGS_TO").alias("relation_type"), F.col("entity_id").alias("source_id"), F.col("agent_id").alias("target_id"))
    return graph.ui_graph(agents, tasks.drop("agent_id"), thoughts.withColumnRenamed("item_id", "entity_id"), belongs.unionByName(_thought_edges(spark, d)))


@query(
    "ui_nodes",
    f"""WITH {_THOUGHTS} SELECT id, 'Agent' AS kind, name AS label FROM agents UNION ALL SELECT id, 'Task', name FROM tasks WHERE agent IN (SELECT id FROM agents)
UNION ALL SELECT id, 'Thought', 'Step ' || step || ': ' || substr(content, 1, 80) FROM thoughts WHERE id IN (SELECT target FROM made UNION SELECT target FROM had)""",
)
def ui_nodes(spark, d):
    return _picture(spark, d)[0]


@query("ui_edges", f"WITH {_THOUGHTS} SELECT id AS source, agent AS target, 'BELONGS_TO' AS type FROM tasks WHERE agent IN (SELECT id FROM agents) UNION ALL SELECT source, target, type FROM made UNION ALL SELECT source, target, type FROM had")
def ui_edges(spark, d):
    return _picture(spark, d)[1]


# Texts of typed properties.
def _typed(spark, d) -> DataFrame:
    part = views.table(spark, d, "part")
    fields = F.struct(
        F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_size") > 25).alias("large"), F.array("p_brand", "p_type").alias("tags"), F.array(F.col("p_size")).alias("sizes"), F.struct("p_brand").alias("nested"), F.lit(None).cast("string").alias("gone")
    )
    return part.select("p_partkey", "p_brand", F.parse_json(F.to_json(fields, {"ignoreNullFields": "false"})).alias("properties"))


@query("entity_text_typed", "SELECT p_partkey, 'large: ' || (p_size > 25) || '. name: ' || p_name || '. size: ' || p_size AS text FROM part")
def entity_text_typed(spark, d):
    """Strings, numbers and booleans by key; arrays, objects and nulls are skipped."""
    return _typed(spark, d).select("p_partkey", T.event_text(F.col("properties")).alias("text"))


@query("searchable_arrays", "SELECT p_partkey, p_brand || ' | ' || p_name || ' | ' || p_brand || ' | ' || p_type AS text FROM part")
def searchable_arrays(spark, d):
    """Strings and arrays of strings of the metadata."""
    return _typed(spark, d).select("p_partkey", T.searchable_variant([F.col("p_brand"), F.lit(None).cast("string")], F.col("properties")).alias("text"))


# Rules of a deployment's own, and the pattern of errors that no rule uses.
@query("log_regex", r"SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'action' END AS event_type, CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS user, CASE WHEN event_id % 3 > 0 THEN event_type END AS what FROM events")
def log_regex(spark, d):
    message = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("at noon user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type")).otherwise(F.concat(F.lit("nothing of "), "event_type"))
    rows = logs.parse_logs(views.table(spark, d, "events").select("event_id", message.alias("message")), [logs.Rule("own", "regex", pattern=r"user (\d+) did (\w+)", groups=("user", "what"), event_type="action")])
    return rows.select("event_id", F.col("event_type"), F.try_element_at("properties", F.lit("user")).alias("user"), F.try_element_at("properties", F.lit("what")).alias("what"))


@query("log_errors", "SELECT event_id, 'Error' AS level, '' AS message, 'of ' || user_id || ' in line ' || event_id AS location FROM events WHERE event_type = 'error'")
def log_errors(spark, d):
    """The error pattern's first group is lazy and stays empty, so that all of the line is its last one."""
    message = F.when(F.col("event_type") == "error", F.format_string("Error of %d in line %d", "user_id", "event_id")).otherwise(F.lit("all is well"))
    return views.table(spark, d, "events").select("event_id", logs.error_parts(message).alias("e")).where("e IS NOT NULL").select("event_id", "e.*")
