"""Model-invocation records (logs.INVOCATION) as an interaction graph, as flat log rows, and as figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import mentions_error

#: Characters of a system prompt that its log row shows.
PREVIEW = 200


def _with_parts(records: DataFrame, *more: str | Column) -> DataFrame:
    """(request_id, timestamp, answered, asked, answers, ...): one row per record, with the parts of users' messages (m, c, content) and of the output (c, role, content).

    All rows that a record gives are made from this one row, so a record is read and parsed once.
    """
    said = F.col("output.outputBodyJson.output.message")
    asked = F.flatten(F.transform(F.coalesce("input.inputBodyJson.messages", F.array()), lambda m, i: F.transform(F.when(m["role"] == "user", F.coalesce(m["content"], F.array())).otherwise(F.array()), lambda c, j: F.struct(i.alias("m"), j.alias("c"), c.alias("content")))))
    answers = F.transform(F.coalesce(said["content"], F.array()), lambda c, j: F.struct(j.alias("c"), said["role"].alias("role"), c.alias("content")))
    return records.select(F.col("requestId").alias("request_id"), "timestamp", F.col("output").isNotNull().alias("answered"), asked.alias("asked"), answers.alias("answers"), *more)


def _answers(records: DataFrame) -> DataFrame:
    """(request_id, timestamp, role, c, content): the parts of output messages."""
    message = "output.outputBodyJson.output.message"
    return records.select(F.col("requestId").alias("request_id"), "timestamp", F.col(f"{message}.role").alias("role"), F.posexplode(f"{message}.content").alias("c", "content"))


def _text_of(content: Column) -> Column:
    """The joined texts of a part's tool result."""
    return F.array_join(content["toolResult"]["content"]["text"], " ")


def tool_uses(records: DataFrame) -> DataFrame:
    """(request_id, c, tool_use_id, tool_name, input_data): the tools of outputs, the input as JSON text. A missing name is 'unknown', a missing id empty."""
    use = _answers(records).where("content.toolUse is not null")
    given = F.coalesce(F.to_json("content.toolUse.input"), F.lit("{}"))
    return use.select("request_id", "c", F.coalesce("content.toolUse.toolUseId", F.lit("")).alias("tool_use_id"), F.coalesce("content.toolUse.name", F.lit("unknown")).alias("tool_name"), given.alias("input_data"))


def first_user_text(records: DataFrame) -> DataFrame:
    """(request_id, text): the first text of a user's message, null if there is none."""
    users = F.filter("input.inputBodyJson.messages", lambda m: m["role"] == "user")
    texts = F.flatten(F.transform(users, lambda m: F.filter(m["content"], lambda c: c["text"].isNotNull())))
    return records.select(F.col("requestId").alias("request_id"), F.try_element_at(texts, F.lit(1))["text"].alias("text"))


def interaction_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of records that weren't throttled; request ids differ.

    UserQuery -triggers-> Request -produces-> Response -contains-> AssistantResponse, Response -invokes-> ToolCall -returns-> ToolResult
    -provides_context_to-> Request, ToolResult -contains-> Error for results that mention an error. A result is returned by the last call
    (by time, request and place) with its tool_use_id, wherever it stands.
    """
    throttled = F.col("errorCode").eqNullSafe("ThrottlingException")
    records = _with_parts(records, throttled.alias("throttled"))
    # Not a filter: that would be pushed below the parse, and parse each record once more for its error code.
    kept = lambda rows: F.explode(F.when(F.col("throttled"), F.array()).otherwise(rows)).alias("x")
    name = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])
    own = F.col("request_id")
    request, response = name("request", own), name("response", own)
    query, result = (lambda p, kind=kind: name(kind, own, p["m"], p["c"]) for kind in ("query", "result"))
    answer, call = (lambda p, kind=kind: name(kind, own, p["c"]) for kind in ("answer", "call"))
    error = lambda p: F.concat(F.lit("error:"), result(p))
    has = lambda parts, what: F.filter(F.col(parts), lambda p: p["content"][what].isNotNull())
    queries, results, texts, calls = has("asked", "text"), has("asked", "toolResult"), has("answers", "text"), has("answers", "toolUse")
    failed = F.filter(results, lambda p: mentions_error(_text_of(p["content"])))
    if_answered = lambda *rows: F.when(F.col("answered"), F.array(*rows)).otherwise(F.array())
    node = lambda kind, c: F.struct(c.alias("entity_id"), F.lit(kind).alias("entity_type"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("relation_type"), a.alias("source_id"), b.alias("target_id"))
    nodes = [
        F.array(node("Request", request)), if_answered(node("Response", response)), F.transform(queries, lambda p: node("UserQuery", query(p))), F.transform(results, lambda p: node("ToolResult", result(p))),
        F.transform(texts, lambda p: node("AssistantResponse", answer(p))), F.transform(calls, lambda p: node("ToolCall", call(p))), F.transform(failed, lambda p: node("Error", error(p))),
    ]
    edges = [
        F.transform(queries, lambda p: edge("triggers", query(p), request)), if_answered(edge("produces", request, response)), F.transform(texts, lambda p: edge("contains", response, answer(p))),
        F.transform(calls, lambda p: edge("invokes", response, call(p))), F.transform(results, lambda p: edge("provides_context_to", result(p), request)), F.transform(failed, lambda p: edge("contains", result(p), error(p))),
    ]
    one = lambda rows: records.select(kept(rows)).select("x.*")
    of = records.select("timestamp", "request_id", kept(F.transform(calls, lambda p: F.struct(p["c"].alias("c"), call(p).alias("id"), p["content"]["toolUse"]["toolUseId"].alias("tool_use_id"))))).select("timestamp", "request_id", "x.*")
    last = of.groupBy("tool_use_id").agg(F.max_by("id", F.struct("timestamp", "request_id", "c")).alias("call"))
    given = one(F.transform(results, lambda p: F.struct(result(p).alias("id"), p["content"]["toolResult"]["toolUseId"].alias("tool_use_id"))))
    returned = given.join(last, "tool_use_id").select(F.lit("returns").alias("relation_type"), F.col("call").alias("source_id"), F.col("id").alias("target_id"))
    return one(F.concat(*nodes)), one(F.concat(*edges)).unionByName(returned)


def flat_logs(records: DataFrame) -> DataFrame:
    """(request_id, message_type, level, message): a row for each throttled request, user's text, tool result, system prompt, list of tools, answer and tool call.

    A throttled request gives its warning only. Results that mention an error have level ERROR, all else INFO. System prompts are cut to PREVIEW characters.
    """
    throttled = F.col("errorCode").eqNullSafe("ThrottlingException")
    rows = _with_parts(records.select("*", throttled.alias("throttled")), "region", "throttled", F.col("input.inputBodyJson.system").alias("system"), F.col("input.inputBodyJson.toolConfig").alias("toolConfig"))
    row = lambda kind, message, level=F.lit("INFO"): F.struct(F.lit(kind).alias("message_type"), level.alias("level"), message.alias("message"))
    each = lambda parts, what, made: F.transform(F.filter(parts, lambda p: p["content"][what].isNotNull()), lambda p: made(p["content"]))
    users, answers = F.col("asked"), F.filter("answers", lambda p: p["role"] == "assistant")
    names = F.transform("toolConfig.tools", lambda t: t["toolSpec"]["name"])
    stopped = row("throttled", F.concat(F.lit("Request throttled: "), "request_id", F.lit(" in region "), "region"), F.lit("WARNING"))
    parts = [
        each(users, "text", lambda c: row("user_query", F.concat(F.lit("User query: "), c["text"]))),
        each(users, "toolResult", lambda c: row("tool_result", F.concat(F.lit("Tool result ("), c["toolResult"]["toolUseId"], F.lit("): "), _text_of(c)), F.when(mentions_error(_text_of(c)), "ERROR").otherwise("INFO"))),
        F.transform(F.coalesce("system", F.array()), lambda s: row("system_prompt", F.concat(F.lit("System prompt: "), F.substring(s["text"], 1, PREVIEW)))),
        F.when(F.col("toolConfig").isNotNull(), F.array(row("tool_config", F.concat(F.lit("Available tools: "), F.array_join(names, ", "))))).otherwise(F.array()),
        each(answers, "text", lambda c: row("assistant_response", F.concat(F.lit("Assistant response: "), c["text"]))),
        each(answers, "toolUse", lambda c: row("tool_call", F.concat(F.lit("Tool call: "), c["toolUse"]["name"], F.lit(" ("), c["toolUse"]["toolUseId"], F.lit(")")))),
    ]
    return rows.select("request_id", F.explode(F.when(F.col("throttled"), F.array(stopped)).otherwise(F.concat(*parts))).alias("x")).select("request_id", "x.*")


def analysis(events: DataFrame) -> DataFrame:
    """(figure, key, value) of events (event_type, error_code, tool, input_tokens, output_tokens, latency_ms).

    Counts by type, error code and tool; token totals and whole averages over the rows that have both counts; whole average, least and
    largest latency. Figures without any row are left out.
    """
    counted, whole = ["event_type", "error_code", "tool"], "numbers"
    both, own = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull(), F.col("figure") == whole
    total = lambda c: F.sum(F.when(own & both, F.col(c)))
    pairs, latency = F.count_if(own & both), F.when(own, F.col("latency_ms"))
    average = lambda amount, n: F.call_function("div", amount, F.nullif(n, F.lit(0)))
    figures = {
        "tokens": {"input": total("input_tokens"), "output": total("output_tokens"), "total": total("input_tokens") + total("output_tokens"), "average_input": average(total("input_tokens"), pairs), "average_output": average(total("output_tokens"), pairs)},
        "latency": {"average": average(F.sum(latency), F.count(latency)), "min": F.min(latency), "max": F.max(latency)},
    }
    # An event gives a row for each key and one for its numbers, so events, which may be costly to make, are made once.
    numbers = ["input_tokens", "output_tokens", "latency_ms"]
    rows = events.select(*counted, *numbers, F.lit("").alias(whole)).unpivot(numbers, [*counted, whole], "figure", "key").where("key is not null")
    grouped = rows.groupBy("figure", "key").agg(F.count("*").alias("value"), *[x.cast("long").alias(f"{f}/{k}") for f, each in figures.items() for k, x in each.items()])
    named = F.array(*[F.struct(F.lit(f).alias("figure"), F.lit(k).alias("key"), F.col(f"`{f}/{k}`").alias("value")) for f, each in figures.items() for k in each])
    return grouped.select(F.explode(F.when(own, named).otherwise(F.array(F.struct("figure", "key", "value")))).alias("x")).select("x.*").where("value is not null")
