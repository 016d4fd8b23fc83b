"""Chat formatting with linked tool calls (native).

Calls and results of a conversation are hash-joined by (conversation, call id),
put in topological order, their arguments checked against the tools' schemas,
and every message is written as canonical JSON (sorted keys, no white space,
characters unescaped).

A message is a node with at most one parent: a result's parent is its call, a
call's parent the message that it answers. A node's place in topological order
is its depth, found by pointer doubling: every round joins each node to its
ancestor's ancestor, so a conversation of n messages needs log2(n) rounds, and
what is joined is keyed by message, never gathered by conversation. So neither
a conversation that holds a third of all rows nor a very long one meets in one
task, and the order is a column (``depth``, then ``turn``) instead of a list.

Defined cases: a result without a call is ``orphan``, a call without a result
``open``; of calls with equal ids the one with the smallest turn, then text,
counts and the others are ``duplicate``; a result whose call is a duplicate id
is linked to the one that counts; nodes on a cycle have depth null; arguments
that are no JSON object fail validation; null texts count as empty; null roles
make plain messages; a message without a conversation or call id (a null turn gives none)
is linked with nothing, so its call is ``open``, its result an ``orphan``, its depth 0; an empty table gives an empty table; further columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, load, stage, text_of

#: tools by name: argument -> (JSON type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
#: JSON types by the start of what ``schema_of_variant`` calls them (fixed values)
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)",
          "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
#: the tool that a plain user turn calls: the assistant's next turn is its result
REPLY: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's JSON arguments: a sorted array of messages."""
    parsed = F.try_parse_json(arguments)
    given = F.map_keys(F.from_json(arguments, "map<string,string>"))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    per_tool = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field}']", "variant"))
            there = F.coalesce(F.array_contains(given, field), F.lit(False))
            right = F.coalesce(F.regexp_like(got, F.lit(f"^{_TYPES[kind]}")), F.lit(False))
            checks.append(F.when(there & ~right, F.lit(f"{field}: not {kind}"))
                          .when(~there & F.lit(required), F.lit(f"{field}: missing")))
        extra = F.transform(F.array_except(given, F.array(*[F.lit(f) for f in fields]).cast("array<string>")),
                            lambda k: F.concat(k, F.lit(": unknown")))
        found = F.concat(F.filter(F.array(*checks).cast("array<string>"), lambda x: x.isNotNull()), extra)
        per_tool = F.when(name == tool, found).otherwise(per_tool)
    known = F.coalesce(name.isin(list(schemas)), F.lit(False))
    return (F.when(~known, F.array(F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit("")))))
            .when(~is_object, F.array(F.lit("arguments: not an object")))
            .otherwise(F.array_sort(per_tool)))


def depths(nodes: DataFrame) -> DataFrame:
    """(node, parent) rows with unique nodes to (node, depth); depth null on cycles.

    A parent that is no node counts as none.
    """
    state = nodes.select("node", F.col("parent").alias("up"))
    real = state.select(F.col("node").alias("up"))
    state = state.join(real.withColumn("there", F.lit(True)), "up", "left")
    state = stage(state.select(
        "node", F.when(F.col("there"), F.col("up")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")), "chat-depth")
    left = state.where("up IS NOT NULL").count()
    while left:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"),
                             F.col("depth").alias("more"))
        climbing = state.where("up IS NOT NULL").join(above, "up")
        state = stage(state.where("up IS NULL").unionByName(climbing.select(
            "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))),
            "chat-depth")
        now = state.where("up IS NOT NULL").count()
        if now == left:  # every round settles someone until only cycles are left
            break
        left = now
    return state.select("node", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def read_turns(messages: DataFrame) -> DataFrame:
    """Messages to one row per message: conv_id, turn, role, kind, text, call_id, name, arguments, after.

    A user turn calls ``reply``; the assistant's turn right after is its result;
    a text that is a JSON object with ``tool_call`` (id, name, arguments) is that
    call, one with ``tool_result`` (id, content) that result. ``after`` is the
    turn that a call answers.
    """
    text = text_of(messages)
    m = messages.select(col(messages, "conv_id").cast("string").alias("conv_id"),
                        col(messages, "turn").cast("long").alias("turn"),
                        col(messages, "role").cast("string").alias("role"), text.alias("text"))
    m = m.withColumn("said", F.when(
        F.col("text").startswith("{"),
        F.from_json("text", "tool_call struct<id:string,name:string,arguments:string>,"
                            "tool_result struct<id:string,content:string>")))
    call, result = F.col("said.tool_call"), F.col("said.tool_result")
    kind = (F.when(call.isNotNull(), "call").when(result.isNotNull(), "result")
            .when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result")
            .otherwise("plain"))
    turn = F.col("turn").cast("string")
    own = (F.when(call.isNotNull(), call["id"]).when(result.isNotNull(), result["id"])
           .when(F.col("role") == "user", turn)
           .when(F.col("role") == "assistant", (F.col("turn") - 1).cast("string")))
    asked = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    return m.select(
        "conv_id", "turn", "role", kind.alias("kind"), own.alias("call_id"),
        F.when(kind == "call", F.coalesce(call["name"], F.lit("reply"))).alias("name"),
        F.when(kind == "call", F.when(call.isNotNull(), call["arguments"]).otherwise(asked)).alias("arguments"),
        F.when(kind == "result", F.coalesce(result["content"], F.col("text")))
        .otherwise(F.col("text")).alias("text"),
        (F.col("turn") - 1).alias("after"))


def link(turns: DataFrame, schemas: Schemas) -> DataFrame:
    """Rows of ``read_turns`` with status, errors, depth and json."""
    rows = stage(turns.withColumn("node", F.monotonically_increasing_id()), "chat-turns")
    key = ["conv_id", "call_id"]
    # The call that counts of each id, and the message that stands for each turn: both unique.
    calls = rows.where("kind = 'call'").groupBy(*key).agg(
        F.min(F.struct("turn", "text", "node")).alias("first"))
    calls = calls.select("conv_id", "call_id", F.col("first.node").alias("call_node"))
    answered = rows.where("kind = 'result'").select(*key).distinct().withColumn("answered", F.lit(True))
    by_turn = rows.groupBy("conv_id", "turn").agg(F.min("node").alias("after_node")).select(
        "conv_id", F.col("turn").alias("after"), "after_node")
    linked = (rows.join(calls.hint("shuffle_hash"), key, "left")
              .join(answered.hint("shuffle_hash"), key, "left")
              .join(by_turn.hint("shuffle_hash"), ["conv_id", "after"], "left"))
    first = F.col("call_node") == F.col("node")
    status = (F.when(F.col("kind") == "plain", "plain")
              .when(F.col("kind") == "result", F.when(F.col("call_node").isNull(), "orphan").otherwise("linked"))
              .when(F.col("call_node").isNull(), "open")
              .when(~first, "duplicate")
              .when(F.col("answered"), "linked").otherwise("open"))
    parent = F.when(F.col("kind") == "result", F.col("call_node")).otherwise(F.col("after_node"))
    linked = stage(linked.withColumn("status", status).withColumn("parent", parent), "chat-linked")
    placed = linked.join(depths(linked.select("node", "parent")), "node")
    errors = F.when(F.col("kind") == "call", argument_errors(F.col("name"), F.col("arguments"), schemas))
    # Keys in alphabetical order; absent values are left out, and a variant sorts its own keys.
    body = F.to_json(F.struct(
        F.when(F.col("kind") == "call", F.try_parse_json("arguments")).alias("arguments"),
        F.when(F.col("kind") != "plain", F.col("call_id")).alias("call_id"),
        F.when(F.col("kind") != "call", F.col("text")).alias("content"),
        F.col("kind").alias("kind"), F.col("name").alias("name"), F.col("role").alias("role"),
        F.col("status").alias("status")))
    return placed.select("conv_id", "turn", "role", "kind", "call_id", "status", "depth",
                         F.array_join(errors, "; ").alias("errors"), body.alias("json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every message of ``conversations``, linked, placed, checked and serialised."""
    return link(read_turns(load(spark, sf_dir, "conversations")), REPLY)
