"""Log lines to events: rules compiled to column expressions, and conversation records to a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The patterns of the built-in rules, tried in this order, each with its event type and the properties of its groups.
# A group with '?' may be missing, and then gives no property. (?d) lets '.' stop at line feeds only.
LANGCHAIN = (
    (r"(?id)(?:Entering new|Finished|Running) (\w+)(?: tool)?.*?(?:input[:\s]+)?(\{.*?\}|[^\n]+)", "tool_call", ("tool_name", "input")),
    (r"(?id)(?:Entering new|Finished) (\w+) chain.*?(?:with input[:\s]+)?(.*)", "chain_execution", ("chain_type", "input")),
    (r"(?id)Agent (Action|Finished).*?(?:tool[:\s]+)?(\w+)?.*?(?:input[:\s]+)?(.*)", "agent_action", ("action", "tool?", "input")),
)
LLAMAINDEX = (
    (r"(?id)query[:\s]+([^\n]+).*?(?:response[:\s]+)?(.*)", "query", ("query", "response")),
    (r"(?id)retrieve.*?(?:query[:\s]+)?([^\n]+).*?(?:nodes[:\s]+)?(\d+)", "retrieval", ("query", "node_count")),
)
GENERIC_ERROR = r"(?id)(ERROR|FATAL|EXCEPTION).*?(.*?)(?:at|in|from)?\s*(.*)"
SESSION = r"(?i)(?:session[-_]?id|sess[-_]?id)[:\s]+([a-zA-Z0-9\-]+)"
REQUEST = r"(?i)(?:request[-_]?id|req[-_]?id|trace[-_]?id)[:\s]+([a-zA-Z0-9\-]+)"
AGENT = r"(?i)(?:agent[-_]?id|agent[-_]?name)[:\s]+([a-zA-Z0-9\-]+)"

#: The largest number of nodes that is taken over.
MOST_NODES = 2**32 - 1


@dataclass(frozen=True)
class Rule:
    """kind: json, regex, langchain or llamaindex. mapping adds renamed copies of properties. Lower priorities come first."""

    name: str
    kind: str
    pattern: str = ""
    groups: tuple[str, ...] = ()
    mapping: dict[str, str] = field(default_factory=dict)
    event_type: str | None = None
    priority: int = 100


def _captured(text: Column, pattern: str, groups: tuple[str, ...], **more: str) -> Column:
    """A map of the groups' names and what they matched, with some fixed entries."""
    pairs = [F.lit(x) for pair in more.items() for x in pair]
    for k, g in enumerate(groups):
        value = F.regexp_extract(text, pattern, k + 1)
        if g.endswith("?"):
            value = F.nullif(value, F.lit(""))
        if g == "node_count":
            number = value.try_cast("decimal(20)")
            value = F.when(number <= MOST_NODES, number.cast("string"))
        pairs += [F.lit(g.rstrip("?")), value]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.map_filter(made, lambda k, v: v.isNotNull())


def _parsed(event_type: Column, properties: Column) -> Column:
    return F.struct(event_type.cast("string").alias("event_type"), properties.alias("properties"))


def _rule(rule: Rule, text: Column) -> Column:
    """A struct (event_type, properties), null where the rule doesn't match."""
    kind = F.lit(rule.event_type)
    if rule.kind == "json":
        made = F.from_json(text, "map<string,string>")
        added = [x for old, new in rule.mapping.items() for x in (F.lit(new), F.try_element_at(made, F.lit(old)))]
        full = F.map_concat(made, F.map_filter(F.create_map(*added), lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(made), k))) if added else made
        known = _parsed(F.coalesce(F.try_element_at(full, F.lit("event_type")), kind), full)
        other = _parsed(kind, F.create_map(F.lit("message"), F.trim(text)))  # an array or a single value
        return F.when(F.try_parse_json(text).isNotNull(), F.when(F.ltrim(text).startswith("{"), known).otherwise(other))
    if rule.kind == "regex":
        return F.when(text.rlike(rule.pattern), _parsed(kind, _captured(text, rule.pattern, rule.groups)))
    table = {"langchain": LANGCHAIN, "llamaindex": LLAMAINDEX}[rule.kind]
    out = F.lit(None)
    for pattern, event_type, groups in reversed(table):
        out = F.when(text.rlike(pattern), _parsed(F.lit(event_type), _captured(text, pattern, groups, framework=rule.kind))).otherwise(out)
    return out


def parse_logs(logs: DataFrame, rules: list[Rule], agent_id: str | None = None) -> DataFrame:
    """logs (message, ...) with event_type, properties, session_id, agent_id: the first rule that matches, else the message as it is."""
    text = F.col("message")
    fallback = _parsed(F.lit(None), F.create_map(F.lit("message"), text, F.lit("raw_log"), F.lit("true")))
    parsed = F.coalesce(*[_rule(r, text) for r in sorted(rules, key=lambda r: r.priority)], fallback)
    taken = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    rows = logs.withColumn("_p", parsed)
    agent = F.lit(agent_id) if agent_id else taken(AGENT)
    return rows.withColumns({"event_type": F.col("_p.event_type"), "properties": F.col("_p.properties"), "session_id": F.coalesce(taken(SESSION), taken(REQUEST)), "agent_id": agent}).drop("_p")


def error_parts(message: Column) -> Column:
    """A struct (level, message, location) by GENERIC_ERROR, null for other lines. No rule uses it."""
    part = lambda k: F.regexp_extract(message, GENERIC_ERROR, k)
    return F.when(message.rlike(GENERIC_ERROR), F.struct(part(1).alias("level"), part(2).alias("message"), part(3).alias("location")))


def pull(logs: DataFrame, start_ms: int, end_ms: int, contains: str | None = None, stream: str | None = None) -> DataFrame:
    """Log rows (log_stream, timestamp, message, ...) from start to end, both included, that hold a string, of one stream if given; oldest first.

    event_id is that of the row, or for rows of a single stream without one the stream and time. All rows in the range are returned.
    """
    rows = logs.where(F.col("timestamp").between(start_ms, end_ms))
    if contains:
        rows = rows.where(F.col("message").contains(contains))
    if stream is not None:
        rows = rows.where(F.col("log_stream") == stream)
    own = F.concat_ws("-", "log_stream", F.col("timestamp").cast("string"))
    rows = rows.withColumn("event_id", F.coalesce("event_id", own) if "event_id" in logs.columns else own)
    return rows.orderBy("timestamp", "event_id")


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Records of files that each hold a JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


#: The parts of a model-invocation record that the graph needs.
INVOCATION = """timestamp string, requestId string, region string, inferenceRegion string, operation string, modelId string, errorCode string, identity struct<arn:string>,
input struct<inputBodyJson:struct<messages:array<struct<role:string,content:array<struct<text:string,toolUse:struct<toolUseId:string,name:string,input:map<string,string>>,toolResult:struct<toolUseId:string,content:array<struct<text:string>>>>>>>,system:array<struct<text:string>>,toolConfig:struct<tools:array<struct<toolSpec:struct<name:string>>>>>,inputTokenCount:bigint>,
output struct<outputBodyJson:struct<output:struct<message:struct<role:string,content:array<struct<text:string,toolUse:struct<toolUseId:string,name:string,input:map<string,string>>>>>>,stopReason:string,metrics:struct<latencyMs:bigint>,usage:struct<inputTokens:bigint,outputTokens:bigint,totalTokens:bigint>>,outputTokenCount:bigint>"""

PATIENT = r"(?i)\b(PAT\d+|patient-\d+)\b"


def invocation_events(records: DataFrame) -> DataFrame:
    """One row per record: request, agent, event type (error > tool_use > invocation), first tool, tokens, latency."""
    out = F.col("output.outputBodyJson")
    tools = F.filter(F.coalesce(out["output"]["message"]["content"], F.array()), lambda c: c["toolUse"].isNotNull())
    tool = F.try_element_at(tools, F.lit(1))["toolUse"]["name"]
    kind = F.when(F.col("errorCode").isNotNull(), "error").when(tool.isNotNull(), "tool_use").otherwise("invocation")
    tokens_in = F.coalesce(out["usage"]["inputTokens"], F.col("input.inputTokenCount"))
    tokens_out = F.coalesce(out["usage"]["outputTokens"], F.col("output.outputTokenCount"))
    return records.select(F.col("requestId").alias("request_id"), "timestamp", F.col("identity.arn").alias("agent"), F.col("modelId").alias("model"), kind.alias("event_type"), F.col("errorCode").alias("error_code"), tool.alias("tool"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"), out["metrics"]["latencyMs"].alias("latency_ms"))


def tool_links(records: DataFrame) -> DataFrame:
    """Tool calls with their results, whichever record holds them: (tool_use_id, tool, called_in, returned_in, result)."""
    calls = records.select(F.col("requestId").alias("called_in"), F.explode("output.outputBodyJson.output.message.content").alias("c")).where("c.toolUse is not null")
    calls = calls.select("called_in", F.col("c.toolUse.toolUseId").alias("tool_use_id"), F.col("c.toolUse.name").alias("tool"))
    messages = records.select(F.col("requestId").alias("returned_in"), F.explode("input.inputBodyJson.messages").alias("m")).select("returned_in", F.explode("m.content").alias("c")).where("c.toolResult is not null")
    results = messages.select("returned_in", F.col("c.toolResult.toolUseId").alias("tool_use_id"), F.array_join("c.toolResult.content.text", "\n").alias("result")).dropDuplicates(["tool_use_id", "returned_in"])
    return calls.dropDuplicates(["tool_use_id"]).join(results, "tool_use_id", "left")


def patients(records: DataFrame) -> DataFrame:
    """(request_id, patient_id): ids in message texts and in tool inputs, each once for a request."""
    texts = F.flatten(F.transform(F.coalesce("input.inputBodyJson.messages", F.array()), lambda m: F.transform(m["content"], lambda c: F.coalesce(c["text"], F.lit("")))))
    inputs = F.transform(F.coalesce("output.outputBodyJson.output.message.content", F.array()), lambda c: F.try_element_at(c["toolUse"]["input"], F.lit("patient_id")))
    named = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(PATIENT), 1)))
    ids = F.array_distinct(F.filter(F.concat(named, inputs), lambda x: x.isNotNull()))
    return records.select(F.col("requestId").alias("request_id"), F.explode(ids).alias("patient_id"))


def invocation_graph(records: DataFrame, skip_throttled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): requests, agents, patients and tool uses; MADE_BY, REFERENCES_PATIENT, INVOKED_TOOL and FOLLOWED_BY."""
    if skip_throttled:
        records = records.where(~F.col("errorCode").eqNullSafe("ThrottlingException"))
    events, links, sick = invocation_events(records), tool_links(records), patients(records)
    node = lambda df, kind, c: df.where(F.col(c).isNotNull()).select(F.concat(F.lit(f"{kind}:"), F.col(c)).alias("entity_id"), F.lit(kind).alias("entity_type")).distinct()
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("relation_type"), F.concat(F.lit(a[0] + ":"), F.col(a[1])).alias("source_id"), F.concat(F.lit(b[0] + ":"), F.col(b[1])).alias("target_id")).where("source_id is not null and target_id is not null").distinct()
    nodes = node(events, "request", "request_id").unionByName(node(events, "agent", "agent")).unionByName(node(sick, "patient", "patient_id")).unionByName(node(links, "tool_use", "tool_use_id"))
    chain = followed_by(events.select(F.col("agent").alias("chain"), F.col("request_id").alias("item_id"), "timestamp"))
    edges = edge(events, "MADE_BY", ("request", "request_id"), ("agent", "agent")).unionByName(edge(sick, "REFERENCES_PATIENT", ("request", "request_id"), ("patient", "patient_id")))
    edges = edges.unionByName(edge(links, "INVOKED_TOOL", ("request", "called_in"), ("tool_use", "tool_use_id"))).unionByName(edge(chain, "FOLLOWED_BY", ("request", "item_id"), ("request", "next_id")))
    return nodes, edges


def followed_by(items: DataFrame) -> DataFrame:
    """(chain, item_id, next_id, time_delta_ms): neighbours by the timestamp's text within a chain; 0 for times that can't be read."""
    w = Window.partitionBy("chain").orderBy("timestamp", "item_id")
    ms = lambda c: F.unix_millis(F.try_to_timestamp(c))
    rows = items.withColumn("next_id", F.lead("item_id").over(w)).withColumn("next_time", F.lead("timestamp").over(w)).where(F.col("next_id").isNotNull())
    return rows.select("chain", "item_id", "next_id", F.coalesce(ms(F.col("next_time")) - ms(F.col("timestamp")), F.lit(0)).alias("time_delta_ms"))
