"""Chat formatting: link tool calls to their results, order them topologically, check arguments, write canonical JSON.

Messages are rows (conv_id, turn, role, text).  Two kinds of text have a structure; every other text is plain content.

* An assistant's ``{"content": ..., "tool_calls": [{"id", "name", "arguments": {...}, "after": [ids]}]}``: calls; ``after`` names calls
  of the conversation whose results a call needs.
* A tool's ``{"tool_call_id": ..., "content": ...}``: the result of a call.

The output has a row for each message, call and result, so that a conversation of any length is never gathered in one task: the order
is a pair of columns (order_turn, level) that sorts every row after all that it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CALLS = "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: variant, after: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"
CALL_ID = ["conv_id", "call_id"]

#: What a schema's type names accept, as patterns over schema_of_variant's answer.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}

#: Schemas of the registered query: tool, then argument, then (type, required).
TOOLS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "calculate": {"expression": ("string", True)}, "fetch": {"url": ("string", True), "headers": ("object", False)}}


def argument_errors(tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """array<string> of the faults of ``arguments`` (a variant) for the tool in ``name``, in the order of the schema."""
    checks = []
    unknown = F.when(F.col("name").isNull() | ~F.col("name").isin(*tools), F.lit("unknown tool"))
    for tool, schema in sorted(tools.items()):
        here = F.col("name") == tool
        checks.append(F.when(here & ~F.coalesce(F.schema_of_variant("arguments").rlike("^(OBJECT<.*)$"), F.lit(False)), F.lit("arguments are not an object")))
        for name, (kind, required) in schema.items():
            value = F.try_variant_get("arguments", f"$.{name}", "variant")
            fits = F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$")
            missing = F.lit(f"{name}: missing") if required else F.lit(None).cast("string")
            checks.append(F.when(here, F.when(value.isNull(), missing).when(~fits, F.lit(f"{name}: not of type {kind}"))))
    return F.array_compact(F.array(unknown, *checks))


def format_chats(conversations: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS) -> DataFrame:
    """conv_id, turn, kind, role, call_id, status, errors, order_turn, level, json: a row for each message, call and result.

    status: ok; unanswered (a call without result); orphan (a result without call); duplicate (a second call or result of an id, by
    turn); cyclic (calls that wait for one another: level is null).  ``after`` ids that the conversation lacks are ignored.  A null role
    or text stays null in the JSON; repeated plain rows are kept; a null conv_id or id links to nothing.  An empty table gives none.
    """
    scratch = Scratch(conversations.sparkSession, "chats")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = _parsed(rows)
    is_call, is_result = F.coalesce(F.size("called.tool_calls") > 0, F.lit(False)), F.col("result.tool_call_id").isNotNull()

    body = F.when(is_call, F.col("called.content")).otherwise(F.col("text"))
    plain = rows.filter(~is_result & (~is_call | F.col("called.content").isNotNull())).select(
        "conv_id", "turn", F.lit("message").alias("kind"), "role", F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("level"), _json(content=body, role=F.col("role")).alias("json"),
    )
    tool_rows = rows.filter(is_call | is_result)
    if tool_rows.isEmpty():
        return plain

    # Written with a number each, so that of two equal rows one is the first.
    tool_rows = _parsed(scratch.write(tool_rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("uid")), "tools"))
    calls = tool_rows.filter(is_call).select("conv_id", "turn", "uid", F.posexplode("called.tool_calls").alias("pos", "call"))
    calls = calls.select("conv_id", "turn", "pos", "uid", F.col("call.id").alias("call_id"), "call.name", "call.arguments", F.array_distinct(F.coalesce("call.after", F.array().cast("array<string>"))).alias("after"))
    calls = _first(calls.withColumn("errors", argument_errors(tools)).withColumn("arguments", F.to_json("arguments")), F.struct("turn", "pos", "uid"))
    results = _first(tool_rows.filter(is_result).select("conv_id", "turn", "role", "uid", F.col("result.tool_call_id").alias("call_id"), "result.content"), F.struct("turn", "content", "uid"))
    calls, results = scratch.write(calls, "calls"), scratch.write(results, "results")

    placed = _levels(scratch, calls.filter("first"), results.filter("first"))
    answered = results.filter("first").select(*CALL_ID, F.lit(True).alias("answered"))
    calls = calls.join(answered, CALL_ID, "left").join(placed, CALL_ID, "left")
    status = F.when(~F.col("first"), "duplicate").when(F.col("level").isNull() & F.col("call_id").isNotNull(), "cyclic").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    out_calls = calls.select(
        "conv_id", "turn", F.lit("call").alias("kind"), F.lit("assistant").alias("role"), "call_id", status.alias("status"), "errors", F.when(F.col("first"), F.col("order_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(F.col("first"), F.col("level")).alias("level"),
        F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(","), F.substring(_json(id=F.col("call_id"), name=F.col("name"), role=F.lit("assistant")), 2, 2**31 - 1)).alias("json"),
    )
    results = results.join(placed, CALL_ID, "left")
    known = F.col("order_turn").isNotNull()
    out_results = results.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "role", "call_id", F.when(~F.col("first"), "duplicate").when(~known, "orphan").otherwise("ok").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.greatest("turn", "order_turn").alias("order_turn"), F.when(known, F.col("level") + 1).otherwise(F.lit(0)).cast("long").alias("level"), _json(content=F.col("content"), role=F.col("role"), tool_call_id=F.col("call_id")).alias("json"),
    )
    return plain.unionByName(out_calls).unionByName(out_results)


def _parsed(rows: DataFrame) -> DataFrame:
    """rows with ``called`` and ``result``: what an assistant's or a tool's text says, if it is a JSON object (blanks may come first)."""
    shaped = F.ltrim("text").startswith("{") & F.try_parse_json("text").isNotNull()
    rows = rows.withColumn("called", F.when((F.col("role") == "assistant") & shaped, F.from_json("text", CALLS)))
    return rows.withColumn("result", F.when((F.col("role") == "tool") & shaped, F.from_json("text", RESULT)))


def with_calls(conversations: DataFrame) -> DataFrame:
    """Conversations in which every assistant's turn is a call, "c" and its turn, that needs the one two turns before, and every later user's
    turn is the result of the call one turn before: plain tables hold no calls, so this is what linking is checked on at size."""
    turn = F.col("turn").cast("long")
    call = F.to_json(F.struct(F.struct(F.concat(F.lit("c"), turn).alias("id"), F.lit("search").alias("name"), F.struct(F.col("text").alias("query"), turn.alias("limit")).alias("arguments"), F.array(F.concat(F.lit("c"), turn - 2)).alias("after")).alias("call")))
    calls = F.concat(F.lit(' {"tool_calls":['), F.get_json_object(call, "$.call"), F.lit("]}"))
    result = F.to_json(F.struct(F.concat(F.lit("c"), turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    is_result = (F.col("role") == "user") & (turn > 0)
    text = F.when(F.col("role") == "assistant", calls).when(is_result, result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", F.when(is_result, F.lit("tool")).otherwise(F.col("role")).alias("role"), text.alias("text"))


def _json(**fields: Column) -> Column:
    """Canonical JSON: keys in order of their names, no blanks, nulls written."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in sorted(fields.items())]), {"ignoreNullFields": "false"})


def _first(rows: DataFrame, order: Column) -> DataFrame:
    """``first``: whether the row is the first of its id; found by an aggregate that combines before the shuffle, not a window."""
    ids = rows.filter("conv_id is not null and call_id is not null").groupBy(*CALL_ID).agg(F.min(order).alias("least"))
    out = rows.join(ids, CALL_ID, "left").withColumn("first", F.col("least").isNull() | order.eqNullSafe(F.col("least")))
    return out.drop("least")


def _levels(scratch: Scratch, calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, level) of calls, by rounds that place each call whose needs are all placed (Kahn's order).

    A need is met by the call's result where it has one: so it counts one level more, and the later turn of the two.
    """
    ends = results.select(*CALL_ID, F.col("turn").alias("end_turn")).dropDuplicates(CALL_ID)
    nodes = calls.filter("conv_id is not null and call_id is not null").select(*CALL_ID, "turn", "after").dropDuplicates(CALL_ID).join(ends, CALL_ID, "left")
    needs = nodes.select("conv_id", "call_id", F.explode("after").alias("need"))
    needs = needs.join(nodes.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    counted = nodes.drop("after").join(needs.groupBy(*CALL_ID).agg(F.count(F.lit(1)).alias("n_needs")), CALL_ID, "left")
    needs, waiting = scratch.write(needs, "needs"), scratch.write(counted.fillna(0, ["n_needs"]), "nodes")
    ready = waiting.filter("n_needs = 0").select(*CALL_ID, F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("level"), "end_turn")
    rounds = [scratch.write(ready, "placed")]
    while True:
        done = reduce(DataFrame.unionByName, rounds)
        met = needs.join(done.withColumnRenamed("call_id", "need"), ["conv_id", "need"]).groupBy(*CALL_ID)
        met = met.agg(F.count(F.lit(1)).alias("met"), F.max(F.greatest("order_turn", "end_turn")).alias("needs_turn"), F.max(F.col("level") + 2).alias("level"))
        fresh = waiting.join(met, CALL_ID).filter("met = n_needs").join(done.select(*CALL_ID), CALL_ID, "left_anti")
        fresh = scratch.write(fresh.select(*CALL_ID, F.greatest("turn", "needs_turn").alias("order_turn"), "level", "end_turn"), "placed")
        if fresh.isEmpty():
            return done.select(*CALL_ID, "order_turn", "level")
        rounds.append(fresh)


#: The tables hold plain messages only, and over those the result is one row a message; linking is tested on a fixture.
ORACLE = """
SELECT conv_id, turn, 'message' AS kind, role, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status, CAST([] AS VARCHAR[]) AS errors,
       turn AS order_turn, CAST(0 AS BIGINT) AS level, CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS json
FROM conversations
"""

#: Over with_calls(): turns alternate, so a call's level is its distance from the conversation's first.
LINKED_ORACLE = """
WITH c AS (SELECT *, min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS t0, lag(role) OVER w AS before, lead(role) OVER w AS after
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'message' END AS kind FROM c)
SELECT conv_id, turn, kind, CASE kind WHEN 'result' THEN 'tool' ELSE role END AS role, CASE kind WHEN 'call' THEN 'c' || turn WHEN 'result' THEN 'c' || (turn - 1) END AS call_id,
       CASE WHEN kind = 'call' AND after IS DISTINCT FROM 'user' THEN 'unanswered' WHEN kind = 'result' AND before IS DISTINCT FROM 'assistant' THEN 'orphan' ELSE 'ok' END AS status,
       CAST([] AS VARCHAR[]) AS errors, turn AS order_turn,
       CASE WHEN kind = 'call' OR (kind = 'result' AND before = 'assistant') THEN turn - t0 ELSE 0 END AS level,
       CAST(CASE kind WHEN 'call' THEN to_json({'arguments': {'limit': turn, 'query': text}, 'id': 'c' || turn, 'name': 'search', 'role': role})
                      WHEN 'result' THEN to_json({'content': text, 'role': 'tool', 'tool_call_id': 'c' || (turn - 1)}) ELSE to_json({'content': text, 'role': role}) END AS VARCHAR) AS json
FROM k
"""
