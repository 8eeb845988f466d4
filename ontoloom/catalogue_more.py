"""Queries of ingestion, logs and invocation records over the driver's events, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import text as T
from ontoloom.operators import graph, store, vector
from ontoloom.plans import views
from ontoloom.sources import invocations, logs
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


def _events(spark, d):
    return views.table(spark, d, "events")


# Invocation records: one for each event. Errors have no output; every third record returns the tool that the one before it called.
def invocation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the schema of logs.INVOCATION, by way of JSON text."""
    e, n = _events(spark, sf_dir), F.col("event_id")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    result = F.when(n % 3 == 0, F.struct(F.struct(text("tool-", n - 1).alias("toolUseId"), F.array(F.struct(F.when(n % 2 == 0, "an error came").otherwise("fine").alias("text")), F.struct(text("v", user).alias("text"))).alias("content")).alias("toolResult")))
    user_parts = F.to_json(F.array_compact(F.array(F.struct(text("find ", n).alias("text")).cast("struct<text:string>"))))
    result_part = F.coalesce(F.concat(F.lit(","), F.to_json(result)), F.lit(""))
    messages = F.concat(F.lit('[{"role":"assistant","content":[{"text":"earlier"}]},{"role":"user","content":'), F.expr("substr(x, 1, length(x) - 1)"), result_part, F.lit("]}]"))
    tool = F.when(n % 3 == 2, text(',{"toolUse":{"toolUseId":"tool-', n, '","name":"', F.when(n % 2 == 0, "search").otherwise("lookup"), '","input":{"k":"', user, '"}}}')).otherwise("")
    system = F.when(kind == "click", F.concat(F.lit('"system":[{"text":"'), F.repeat(F.lit("s"), 150 + (n % 100).cast("int")), F.lit('"}],'))).otherwise("")
    config = F.when(kind == "view", '"toolConfig":{"tools":[{"toolSpec":{"name":"search"}},{"toolSpec":{"name":"lookup"}}]},').otherwise("")
    usage = F.when(kind == "purchase", "").otherwise(text(',"usage":{"inputTokens":', F.floor(F.col("value") * 10), ',"outputTokens":', n % 50, ',"totalTokens":0}'))
    output = F.when(kind == "error", "").otherwise(text(',"output":{"outputBodyJson":{"output":{"message":{"role":"assistant","content":[{"text":"answer ', n, '"}', tool, ']}},"stopReason":"end","metrics":{"latencyMs":', F.floor("value"), "}", usage, "}}"))
    error = F.when(kind == "error", F.when(n % 2 == 0, ',"errorCode":"ThrottlingException"').otherwise(',"errorCode":"ValidationException"')).otherwise("")
    body = text('{"timestamp":"', F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '","requestId":"req-', n, '","region":"r', F.col("user_id") % 3, '","modelId":"m","identity":{"arn":"a', user, '"}', error, ',"input":{"inputBodyJson":{', system, config, '"messages":', messages, "}}", output, "}")
    return e.withColumn("x", user_parts).select(F.from_json(body, logs.INVOCATION).alias("r")).select("r.*")


_LIVE = "r AS (SELECT *, 'req-' || event_id AS rid, event_type <> 'error' AS answered FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0))"


@query("invocation_tool_uses", "SELECT 'req-' || event_id AS request_id, 'tool-' || event_id AS tool_use_id, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'lookup' END AS tool_name, '{\"k\":\"' || user_id || '\"}' AS input_data FROM events WHERE event_type <> 'error' AND event_id % 3 = 2")
def invocation_tool_uses(spark, d):
    return invocations.tool_uses(invocation_records(spark, d)).drop("c")


@query("invocation_first_text", "SELECT 'req-' || event_id AS request_id, 'find ' || event_id AS text FROM events")
def invocation_first_text(spark, d):
    return invocations.first_user_text(invocation_records(spark, d))


@query("invocation_graph_edges", f"""WITH {_LIVE}, results AS (SELECT *, 'result:' || rid || ':1:1' AS id FROM r WHERE event_id % 3 = 0)
SELECT 'triggers' AS relation_type, 'query:' || rid || ':1:0' AS source_id, 'request:' || rid AS target_id FROM r
UNION ALL SELECT 'produces', 'request:' || rid, 'response:' || rid FROM r WHERE answered UNION ALL SELECT 'contains', 'response:' || rid, 'answer:' || rid || ':0' FROM r WHERE answered
UNION ALL SELECT 'invokes', 'response:' || rid, 'call:' || rid || ':1' FROM r WHERE answered AND event_id % 3 = 2 UNION ALL SELECT 'provides_context_to', id, 'request:' || rid FROM results
UNION ALL SELECT 'returns', 'call:req-' || (x.event_id - 1) || ':1', id FROM results x WHERE (x.event_id - 1) IN (SELECT event_id FROM events WHERE event_type <> 'error')
UNION ALL SELECT 'contains', id, 'error:' || id FROM results WHERE event_id % 2 = 0""")
def invocation_graph_edges(spark, d):
    return invocations.interaction_graph(invocation_records(spark, d))[1]


@query("invocation_graph_nodes", f"""WITH {_LIVE} SELECT entity_type, count(*) AS n FROM (SELECT unnest(['Request', 'UserQuery'] || CASE WHEN answered THEN ['Response', 'AssistantResponse'] ELSE [] END
|| CASE WHEN answered AND event_id % 3 = 2 THEN ['ToolCall'] ELSE [] END || CASE WHEN event_id % 3 = 0 THEN ['ToolResult'] ELSE [] END || CASE WHEN event_id % 6 = 0 THEN ['Error'] ELSE [] END) AS entity_type FROM r) GROUP BY 1""")
def invocation_graph_nodes(spark, d):
    return invocations.interaction_graph(invocation_records(spark, d))[0].groupBy("entity_type").agg(F.count("*").alias("n"))


@query("invocation_flat_logs", f"""WITH {_LIVE} SELECT 'req-' || event_id AS request_id, 'throttled' AS message_type, 'WARNING' AS level, 'Request throttled: req-' || event_id || ' in region r' || (user_id % 3) AS message FROM events WHERE event_type = 'error' AND event_id % 2 = 0
UNION ALL SELECT rid, 'user_query', 'INFO', 'User query: find ' || event_id FROM r
UNION ALL SELECT rid, 'tool_result', CASE WHEN event_id % 2 = 0 THEN 'ERROR' ELSE 'INFO' END, 'Tool result (tool-' || (event_id - 1) || '): ' || CASE WHEN event_id % 2 = 0 THEN 'an error came' ELSE 'fine' END || ' v' || user_id FROM r WHERE event_id % 3 = 0
UNION ALL SELECT rid, 'system_prompt', 'INFO', 'System prompt: ' || repeat('s', least(200, 150 + event_id % 100)) FROM r WHERE event_type = 'click'
UNION ALL SELECT rid, 'tool_config', 'INFO', 'Available tools: search, lookup' FROM r WHERE event_type = 'view'
UNION ALL SELECT rid, 'assistant_response', 'INFO', 'Assistant response: answer ' || event_id FROM r WHERE answered
UNION ALL SELECT rid, 'tool_call', 'INFO', 'Tool call: ' || CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'lookup' END || ' (tool-' || event_id || ')' FROM r WHERE answered AND event_id % 3 = 2""")
def invocation_flat_logs(spark, d):
    return invocations.flat_logs(invocation_records(spark, d))


@query("invocation_analysis", """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 2 THEN 'tool_use' ELSE 'invocation' END AS kind, event_type NOT IN ('error', 'purchase') AS counted, CAST(floor(value * 10) AS BIGINT) AS i, event_id % 50 AS o, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS ms FROM events)
SELECT 'event_type' AS figure, kind AS key, count(*) AS value FROM e GROUP BY 2 UNION ALL SELECT 'error_code', CASE WHEN event_id % 2 = 0 THEN 'ThrottlingException' ELSE 'ValidationException' END, count(*) FROM e WHERE event_type = 'error' GROUP BY 2
UNION ALL SELECT 'tool', CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'lookup' END, count(*) FROM e WHERE kind = 'tool_use' GROUP BY 2
UNION ALL SELECT 'tokens', key, CAST(value AS BIGINT) FROM (SELECT unnest(['input', 'output', 'total', 'average_input', 'average_output']) AS key, unnest([sum(i), sum(o), sum(i) + sum(o), sum(i) // count(*), sum(o) // count(*)]) AS value FROM e WHERE counted)
UNION ALL SELECT 'latency', key, CAST(value AS BIGINT) FROM (SELECT unnest(['average', 'min', 'max']) AS key, unnest([sum(ms) // count(ms), min(ms), max(ms)]) AS value FROM e)""")
def invocation_analysis(spark, d):
    return invocations.analysis(logs.invocation_events(invocation_records(spark, d)))


# Lines like those of the documented frameworks.
_LINE = """CASE event_id % 12 WHEN 0 THEN 'Running Search' || user_id || ' tool with input: rain' WHEN 1 THEN 'Finished calc tool' WHEN 2 THEN 'Entering new Llm' || user_id || ' chain with input: q' WHEN 3 THEN 'Agent Action: tool: web input: x' || event_id
WHEN 4 THEN 'query: who is ' || user_id || '?' WHEN 5 THEN 'Retrieve for query: cats nodes: ' || user_id WHEN 6 THEN '[1, 2]' WHEN 7 THEN props WHEN 8 THEN 'sess_id: s-' || user_id || ' agent_name: bot' || user_id WHEN 9 THEN 'req-id ' || event_id || ' FATAL broke' WHEN 10 THEN 'Agent Finished' ELSE 'trace_id: t' || event_id || ' session-id: s9' END"""
_RE_TOOL = r"(?i)(?:Entering new|Finished|Running) (\w+)(?: tool)?.*?(?:input[:\s]+)?(\{.*?\}|[^\n]+)"


@query("log_lines", rf"""WITH m AS (SELECT event_id, {_LINE} AS t FROM events), k AS (SELECT *, event_id % 12 AS c FROM m)
SELECT event_id, CASE WHEN c IN (0, 1, 2) THEN 'tool_call' WHEN c IN (3, 10) THEN 'agent_action' WHEN c = 4 THEN 'query' WHEN c = 5 THEN 'query' END AS event_type,
CASE WHEN c IN (0, 1, 2) THEN regexp_extract(t, '{_RE_TOOL}', 1) END AS tool_name, CASE WHEN c IN (0, 1, 2) THEN regexp_extract(t, '{_RE_TOOL}', 2) WHEN c IN (3, 10) THEN regexp_extract(t, '(?i)Agent (Action|Finished).*?(?:tool[:\s]+)?(\w+)?.*?(?:input[:\s]+)?(.*)', 3) END AS input,
CASE WHEN c IN (3, 10) THEN regexp_extract(t, 'Agent (Action|Finished)', 1) END AS action, CASE WHEN c IN (4, 5) THEN regexp_extract(t, 'query: ([^\n]+)', 1) END AS query, CASE WHEN c IN (0, 1, 2, 3, 10) THEN 'langchain' WHEN c IN (4, 5) THEN 'llamaindex' END AS framework,
CASE c WHEN 8 THEN regexp_extract(t, 'sess_id: ([\w-]+)', 1) WHEN 9 THEN CAST(event_id AS VARCHAR) WHEN 11 THEN 's9' END AS session_id, CASE c WHEN 8 THEN regexp_extract(t, 'agent_name: (\w+)', 1) END AS agent_id,
CASE WHEN c IN (6, 8, 9, 11) THEN t END AS message FROM k""")
def log_lines(spark, d):
    """Line 6 is JSON without an object; line 5 has a query, and so is one."""
    e = _events(spark, d).select("event_id", F.expr(_LINE).alias("message"))
    rules = [logs.Rule("json", "json", priority=1), logs.Rule("chain", "langchain", priority=2), logs.Rule("index", "llamaindex", priority=3)]
    rows = logs.parse_logs(e, rules)
    p = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return rows.select("event_id", "event_type", p("tool_name"), p("input"), p("action"), p("query"), p("framework"), "session_id", "agent_id", p("message"))


@query("log_retrievals", "SELECT event_id, 'retrieval' AS event_type, CASE WHEN user_id % 3 = 0 THEN '9' ELSE CAST(event_id % 10 AS VARCHAR) END AS node_count FROM events")
def log_retrievals(spark, d):
    """The pattern takes all of a line but its last digit as the query, as the documented one does."""
    digits = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("x"), F.lit("99999999999999999999"))).otherwise(F.concat(F.lit("x "), (F.col("event_id") % 10).cast("string")))
    e = _events(spark, d).select("event_id", F.concat(F.lit("Retrieved items "), digits).alias("message"))
    rows = logs.parse_logs(e, [logs.Rule("index", "llamaindex")])
    return rows.select("event_id", "event_type", F.try_element_at("properties", F.lit("node_count")).alias("node_count"))


@query("log_pull", "SELECT event_id, epoch_us(ts) // 1000 AS timestamp FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-25' AND contains(props, '1')")
def log_pull(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = _events(spark, d).select("event_id", F.col("user_id").cast("string").alias("log_stream"), ms.alias("timestamp"), F.col("props").alias("message"))
    return logs.pull(e, 1704153600000, 1706140800000, "1", "3").select("event_id", "timestamp")


@query("log_streams", "SELECT event_type AS log_group, user_id AS log_stream, max(ts) AS last_event, count(*) AS n FROM events GROUP BY 1, 2")
def log_streams(spark, d):
    return store.recent_streams(_events(spark, d).select(F.col("event_type").alias("log_group"), F.col("user_id").alias("log_stream"), F.col("ts").alias("timestamp")))


@query("hourly_errors", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def hourly_errors(spark, d):
    return _events(spark, d).groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("latency_histogram", "SELECT user_id, CAST(least(floor(value / 10), 9) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def latency_histogram(spark, d):
    return _events(spark, d).groupBy("user_id", F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(T.is_error_level(F.col("event_type"))).alias("errors"))


@query("metric_summary", "SELECT count(*) AS total_metrics, count(DISTINCT event_type) AS n_names FROM events")
def metric_summary(spark, d):
    return views.points(spark, d).agg(F.count("*").alias("total_metrics"), F.countDistinct("name").alias("n_names"))


# Ingestion. A batch: every event; a third of them has a trace id, a third a session only, a third neither.
def _batch(spark, d):
    e, k = _events(spark, d), F.col("event_id") % 3
    session = F.when(k == 1, F.concat(F.lit("s"), F.col("user_id").cast("string")))
    return e.select("event_id", F.col("event_id").alias("index"), "ts", F.col("user_id").cast("string").alias("agent_id"), session.alias("session_id"), F.when(k == 0, F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string"))).alias("trace_id"), F.parse_json("props").alias("properties"))


@query("bulk_ingest_errors", "SELECT event_id AS index, 'Failed to get/create trace: ' || CASE event_id % 3 WHEN 1 THEN 'Trace not found and auto-create disabled' ELSE 'No trace specified and auto-create disabled' END AS error FROM events WHERE event_id % 3 > 0")
def bulk_ingest_errors(spark, d):
    return store.bulk_result(store.ingest_report(_batch(spark, d), store.ingest_options(None).auto_create_traces))[2]


@query("bulk_ingest_counts", "SELECT count(*) AS ingested, 0 AS failed FROM events")
def bulk_ingest_counts(spark, d):
    report = store.ingest_report(store.assign_sessions(_batch(spark, d)), store.ingest_options({}).auto_create_traces)
    return store.bulk_result(report)[0]


@query("bulk_ingest_traces", """WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 't' || (user_id % 7) WHEN 1 THEN 'trace:' || first_value(event_id) OVER (PARTITION BY event_id % 3, user_id ORDER BY ts, event_id) ELSE 'trace:' || event_id END AS trace_id FROM events)
SELECT trace_id, min(event_id) AS first_index, row_number() OVER (ORDER BY min(event_id)) AS place FROM b GROUP BY 1""")
def bulk_ingest_traces(spark, d):
    found = store.bulk_result(store.ingest_report(store.assign_sessions(_batch(spark, d))))[1]
    return graph.numbered(found, ["first_index"], "place")


@query("event_contains_edges", "SELECT 'contains' AS relation_type, 'agent_trace:' || CASE event_id % 3 WHEN 0 THEN 't' || (user_id % 7) WHEN 1 THEN 'trace:' || first_value(event_id) OVER (PARTITION BY event_id % 3, user_id ORDER BY ts, event_id) ELSE 'trace:' || event_id END AS source_id, 'agent_event:' || event_id AS target_id FROM events")
def event_contains_edges(spark, d):
    return store.event_rows(store.assign_sessions(_batch(spark, d)))[1]


_PROPERTIES = """CASE event_type WHEN 'click' THEN '"just text"' WHEN 'view' THEN '{"b": true, "a": "x", "n": [1], "o": {"p": 1}, "k": ' || user_id || ', "z": null}' WHEN 'error' THEN '[1, 2]' WHEN 'purchase' THEN '{}' ELSE props END"""


@query("event_text", "SELECT event_id, CASE event_type WHEN 'click' THEN 'just text' WHEN 'view' THEN 'a: x. b: true. k: ' || user_id WHEN 'error' THEN '' WHEN 'purchase' THEN '' ELSE 'k: ' || json_extract_string(props, '$.k') END AS text FROM events")
def event_text(spark, d):
    return _events(spark, d).select("event_id", T.event_text(F.parse_json(F.expr(_PROPERTIES))).alias("text"))


@query("event_vectors", "SELECT 'agent_events' AS collection, CAST(event_id AS VARCHAR) AS entity_id, length('k: ' || json_extract_string(props, '$.k')) AS size FROM events WHERE event_type NOT IN ('error', 'purchase', 'view', 'click') UNION ALL SELECT 'agent_events', CAST(event_id AS VARCHAR), CASE event_type WHEN 'click' THEN 9 ELSE length('a: x. b: true. k: ' || user_id) END FROM events WHERE event_type IN ('click', 'view')")
def event_vectors(spark, d):
    """With the length of the text in place of an embedding."""
    rows = store.event_vectors(_events(spark, d), T.event_text(F.parse_json(F.expr(_PROPERTIES))), lambda x: F.array(F.length(x).cast("long")))
    return rows.select("collection", "entity_id", F.element_at("embedding", 1).alias("size"))


@query("log_write_edges", "SELECT 'GENERATED_LOG' AS relation_type, 'a' || user_id AS source_id, 'log:' || event_id AS target_id FROM events WHERE user_id % 5 > 0 UNION ALL SELECT 'HAS_LOG', 't' || (event_id % 9), 'log:' || event_id FROM events WHERE event_id % 2 = 0 AND event_id % 9 < 4")
def log_write_edges(spark, d):
    e = _events(spark, d)
    items = e.select(F.concat(F.lit("log:"), F.col("event_id").cast("string")).alias("item_id"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("agent_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), (F.col("event_id") % 9).cast("string"))).alias("task_id"))
    agents = e.where("user_id % 5 > 0").select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("entity_id")).distinct()
    return store.linked_rows(items, agents, spark.range(4).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("entity_id")), "GENERATED_LOG", "HAS_LOG")[1]


@query("entity_create", "SELECT c_custkey, c_custkey % 4 > 0 AS is_new, c_custkey % 4 > 0 AS one_clock FROM customer")
def entity_create(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    table, _ = store.create_entities(c, c.where("cast(entity_id as long) % 4 = 0"))
    return table.select(F.col("entity_id").cast("long").alias("c_custkey"), F.col("created_at").isNotNull().alias("is_new"), F.coalesce(F.col("created_at") == F.col("updated_at"), F.lit(False)).alias("one_clock"))


@query("vector_upsert", "SELECT label AS collection, vec_id AS entity_id, CASE WHEN vec_id % 3 = 0 AND label <> 1 THEN 1 ELSE len(embedding) END AS size FROM embeddings")
def vector_upsert(spark, d):
    v = views.vectors(spark, d)
    new = v.where("entity_id % 3 = 0").withColumn("embedding", F.slice("embedding", 1, 1))
    table, _ = store.upsert_vectors(v, new, v.select("collection").distinct().where("collection <> 1"))
    return table.select("collection", "entity_id", F.size("embedding").cast("long").alias("size"))


@query("insert_new", "SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'click' AND event_id < 50), min(event_id)) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND event_id < 50) GROUP BY 1 UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'click' AND event_id < 50")
def insert_new(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "event_type")
    return store.insert_new(e.drop("event_type"), e.where("event_type = 'click' AND event_id < 50").drop("event_type"), "user_id", [F.col("event_id")])


@query("edges_merge_into", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def edges_merge_into(spark, d):
    edge = lambda x: x.select(F.col("user_id").alias("source_id"), F.lit("DID").alias("relation_type"), F.col("event_type").alias("target_id"))
    e = _events(spark, d)
    return store.merge_edges(edge(e.where("event_id % 2 = 0")).distinct(), edge(e)).select(F.col("source_id").alias("user_id"), F.col("target_id").alias("event_type"))


@query("schema_latest", "SELECT event_id FROM events ORDER BY ts DESC, event_type DESC LIMIT 1")
def schema_latest(spark, d):
    return store.latest_schema(_events(spark, d).select(F.col("event_type").alias("namespace"), "event_id", F.col("ts").alias("created_at"))).select("event_id")


@query("json_without_nulls", "SELECT event_id, '{\"id\":' || event_id || CASE WHEN event_type = 'error' THEN '' ELSE ',\"type\":\"' || event_type || '\"' END || '}' AS body FROM events")
def json_without_nulls(spark, d):
    return _events(spark, d).select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("type"))).alias("body"))


@query("error_mentions", "SELECT conv_id, turn FROM conversations WHERE contains(text, 'error') OR contains(text, 'Error')")
def error_mentions(spark, d):
    return views.table(spark, d, "conversations").where(T.mentions_error(F.col("text"))).select("conv_id", "turn")


@query("log_and_thought_text", "SELECT event_id, upper(event_type) || ' | ' || props AS log, 'Step ' || (event_id % 7) || ': ' || props AS thought FROM events")
def log_and_thought_text(spark, d):
    return _events(spark, d).select("event_id", T.log_text(F.col("event_type"), F.col("props")).alias("log"), T.thought_text(F.col("event_id") % 7, F.col("props")).alias("thought"))


@query("metadata_text", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_brand) || '. ' || trim(p_name) || '. ' || p_size || '. ' || trim(p_type) || '. out. a' || p_partkey
WHEN p_partkey % 3 = 1 THEN trim(p_name) ELSE p_size || '. ' || trim(p_brand) END AS text FROM part""")
def metadata_text(spark, d):
    """Parts with all six keys in another order, with one of them among blanks, and with none."""
    m = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    name, size = F.concat(F.lit(" "), "p_name", F.lit("  ")), F.col("p_size").cast("string")
    whole = m(("agent", F.concat(F.lit("a"), F.col("p_partkey").cast("string"))), ("expected_output", F.lit("out")), ("zz", F.lit("unused")), ("backstory", size), ("goal", name), ("role", F.col("p_brand")), ("description", F.col("p_type")))
    one = m(("other", F.col("p_brand")), ("role", F.lit("  ")), ("description", name), ("goal", F.lit(None).cast("string")))
    none = m(("b", size), ("a", F.col("p_brand")), ("c", F.lit(" ")))
    kind = F.col("p_partkey") % 3
    return views.table(spark, d, "part").select("p_partkey", T.metadata_text(F.when(kind == 0, whole).when(kind == 1, one).otherwise(none)).alias("text"))


_TRACES = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'click' THEN user_id || '/' || CAST(ts AS DATE) END AS session, CASE WHEN event_type = 'error' THEN 'given:' || user_id END AS given,
row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
w(user_id, k, event_id, ms, session, trace_id, created, own_session, own, last_trace, last_ms) AS (
  SELECT user_id, k, event_id, ms, session, coalesce(given, 'trace:' || event_id), given IS NULL, session, CASE WHEN given IS NULL THEN 'trace:' || event_id END, CASE WHEN given IS NULL THEN 'trace:' || event_id END, CASE WHEN given IS NULL THEN ms END FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, ms, session, coalesce(found, 'trace:' || event_id), found IS NULL, coalesce(session, own_session), CASE WHEN session IS NULL THEN own WHEN found IS NULL THEN 'trace:' || event_id ELSE st END,
    CASE WHEN found IS NULL THEN 'trace:' || event_id ELSE last_trace END, CASE WHEN found IS NULL THEN ms ELSE last_ms END
  FROM (SELECT *, CASE WHEN given IS NOT NULL THEN given WHEN session IS NULL THEN NULL ELSE coalesce(st, CASE WHEN last_ms > ms - 3600000 THEN last_trace END) END AS found
    FROM (SELECT e.*, w.own_session, w.own, w.last_trace, w.last_ms, CASE WHEN e.session = w.own_session THEN w.own END AS st FROM e JOIN w ON e.user_id = w.user_id AND e.k = w.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS agent_id, event_id, ms AS ts_ms, session AS session_id, trace_id, created FROM w"""


@query("trace_assignment_sessions", _TRACES)
def trace_assignment_sessions(spark, d):
    """Each user an agent, with a session a day, events without session, and given traces."""
    session = F.when(F.col("event_type") != "click", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    given = F.when(F.col("event_type") == "error", F.concat(F.lit("given:"), F.col("user_id").cast("string")))
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("agent_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), session.alias("session_id"), given.alias("trace_id"))
    return traces.assign_traces(e)


# Graph and vectors.
_PAIR = "edges AS (SELECT 'near' AS t, vec_id AS a, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS b FROM embeddings UNION ALL SELECT 'refers', vec_id, (vec_id * 3 + 2) % (SELECT count(*) FROM embeddings) FROM embeddings)"


@query("relations_into_set", f"WITH {_PAIR} SELECT t AS relation_type, a AS source_id, b AS target_id FROM edges WHERE b IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def relations_into_set(spark, d):
    return graph.into_set(views.vector_edges(spark, d), views.vectors(spark, d).where("collection = 2"))


@query("one_hop_pattern", f"WITH {_PAIR} SELECT x.a AS first_id, x.b AS second_id, y.b AS third_id FROM edges x JOIN edges y ON x.b = y.a WHERE x.t = 'near' AND y.t = 'refers'")
def one_hop_pattern(spark, d):
    return graph.pattern(views.vector_edges(spark, d), "near", "refers")


@query("graph_paths", f"WITH RECURSIVE {_PAIR}, p(path, node, n) AS (SELECT [CAST(3 AS BIGINT)], CAST(3 AS BIGINT), 0 UNION ALL SELECT list_append(p.path, e.b), e.b, p.n + 1 FROM p JOIN edges e ON e.a = p.node WHERE p.n < 3 AND NOT list_contains(p.path, e.b)) SELECT path, node AS entity_id, n AS depth FROM p WHERE n > 0")
def graph_paths(spark, d):
    return graph.paths(views.vector_edges(spark, d), 3, 3)


@query("vec_filtered", "WITH s AS (SELECT label AS collection, vec_id AS entity_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id % 7 = 3) SELECT collection, entity_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, entity_id) AS rank FROM s ORDER BY s DESC, entity_id LIMIT 10")
def vec_filtered(spark, d):
    wanted = views.vector_entities(spark, d).where("entity_id % 7 = 3")
    return vector.filtered_top_k(views.vectors(spark, d), wanted, views.query_vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query("vec_duplicate_check", "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT q.vec_id AS query_id, v.vec_id AS entity_id, list_cosine_similarity(v.embedding::DOUBLE[], q.e) AS s FROM embeddings v, q WHERE v.vec_id % 100 <> 0), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entity_id) <= 5) SELECT query_id, entity_id, round(s, 6) AS score, 'item-' || entity_id AS name FROM t WHERE s >= 0.25")
def vec_duplicate_check(spark, d):
    """Before items whose id is divisible by 100 are inserted, those of the rest that are like them."""
    found = vector.similar_before_insert(views.vectors(spark, d).where("entity_id % 100 <> 0"), views.vector_entities(spark, d), views.query_vectors(spark, d), 5, 0.25)
    return found.select("query_id", "entity_id", F.round("score", 6).alias("score"), "name")


@query("thought_tree", "SELECT o_custkey, count(*) AS n, list_sort(list(DISTINCT o_orderstatus)) AS kinds, min(substr(o_orderpriority, 1, 80)) AS preview FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_custkey IS NOT NULL GROUP BY 1")
def thought_tree(spark, d):
    """Agents with the distinct kinds of their tasks and a preview of 80 characters."""
    j = views.table(spark, d, "customer").join(views.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").where("o_custkey IS NOT NULL")
    return j.groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o_orderstatus")).alias("kinds"), F.min(F.substring("o_orderpriority", 1, 80)).alias("preview"))
