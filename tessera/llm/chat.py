"""Chat formatting: link tool calls with their results, order, validate and serialise them.

Everything is DataFrame work: hash joins by (conversation, call id), so a conversation of any length is
spread over tasks and never gathered. In a transcript every call comes after what it depends on, so
the turn orders it; only conversations where some dependency has no earlier turn are ordered by
rounds, each taking the calls all of whose dependencies are placed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, stored

#: The name and argument types of the call that a turn of `conversations` makes, see conversation_events().
REPLY_SCHEMA = [("reply", "text", "STRING", True), ("reply", "turn", "BIGINT", True)]

#: What so many rounds of levels gave is put into one table, so that the plan stays short.
ROUNDS = 64


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; null for what isn't JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _distinct_calls(calls: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id): of several, the one with the least turn, then arguments."""
    columns = [c for c in ("turn", "name", "arguments", "after")]
    return calls.groupBy("conv_id", "call_id").agg(F.min(F.struct(*columns)).alias("one"), F.count("*").alias("copies")).select(
        "conv_id", "call_id", "one.*", "copies"
    )


def order_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls sorted by (level, turn, call_id) come after all they depend on.

    Dependencies on unknown ids don't count. Level is 0 throughout a conversation whose dependencies all
    have earlier turns; null for calls on a cycle or behind one, however deep the others lie: rounds go on
    until nothing is ready.
    """
    edges = calls.select("conv_id", "call_id", "turn", F.explode("after").alias("needs"))
    known = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn"))
    edges = edges.join(known, ["conv_id", "needs"])
    late = edges.where(F.coalesce(F.col("needs_turn") >= F.col("turn"), F.lit(True))).select("conv_id").distinct()
    late = stored(late, "late")
    plain = calls.join(late, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    if late.limit(1).count() == 0:
        return plain
    scratch = Scratch(calls.sparkSession)
    edges = scratch.stored(edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "needs").distinct(), "edges")
    open_calls = scratch.stored(calls.join(late, "conv_id", "left_semi").select("conv_id", "call_id"), "open")
    parts, level = [], 0
    while True:
        ready = open_calls.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level))
        ready = scratch.stored(ready, "ready")
        if ready.limit(1).count() == 0:
            break
        parts.append(ready)
        level += 1
        open_calls = scratch.replaced(open_calls, open_calls.join(ready, ["conv_id", "call_id"], "left_anti"), "open")
        edges = scratch.replaced(edges, edges.join(ready.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti"), "edges")
        if len(parts) == ROUNDS:
            parts = [scratch.stored(reduce(DataFrame.unionByName, parts), "placed")]
    return reduce(DataFrame.unionByName, [plain, *parts, open_calls.withColumn("level", F.lit(None).cast("int"))])


def _errors(arguments: Column, fields: Column) -> Column:
    """What is wrong with a call's arguments: not an object, a required field missing or null, a wrong type, an unknown field."""
    values = F.from_json(arguments, "map<string,variant>")

    def kind(field: Column) -> Column:
        found = F.schema_of_variant(F.try_element_at(values, field))
        return F.regexp_replace(found, r"[<(].*$", "")

    wrong = F.transform(
        fields,
        lambda f: F.when(
            F.coalesce(kind(f["field"]), F.lit("VOID")) == "VOID",
            F.when(f["required"], F.concat(F.lit("missing:"), f["field"])),
        ).when(
            ~((kind(f["field"]) == f["type"]) | ((f["type"] == "DOUBLE") & kind(f["field"]).isin("BIGINT", "DECIMAL"))),
            F.concat(F.lit("type:"), f["field"]),
        ),
    )
    names = F.transform(fields, lambda f: f["field"])
    unknown = F.transform(F.array_except(F.map_keys(values), names), lambda k: F.concat(F.lit("unknown:"), k))
    wrong = F.filter(F.concat(wrong, unknown), lambda e: e.isNotNull())
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))
    return F.when(fields.isNull(), F.array(F.lit("no_schema"))).when(~is_object, F.array(F.lit("not_an_object"))).otherwise(F.array_sort(wrong))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result whose call isn't known.

    calls: conv_id, call_id, turn, name, arguments (JSON), after (ids it depends on; may be null).
    results: conv_id, call_id, turn, content. schemas: name, field, type (as schema_of_variant names it,
    without parameters), required. Out: conv_id, call_id, call_turn, result_turn, status ("linked",
    "unanswered", "orphan_result"), level (see order_levels), valid, errors and message, canonical JSON.

    Of calls of one id that with the least turn counts, and so it is with results. Rows without
    conv_id or call_id take no part. DOUBLE fields take whole numbers and decimals as well.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = _distinct_calls(calls.where(named).withColumn("after", F.coalesce("after", F.array().cast("array<string>"))))
    results = (
        results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r")).select("conv_id", "call_id", "r")
    )
    fields = schemas.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    levels = order_levels(calls)
    joined = calls.join(levels, ["conv_id", "call_id"]).join(fields, "name", "left").join(results, ["conv_id", "call_id"], "full_outer")
    is_call = F.col("copies").isNotNull()
    joined = joined.withColumns(
        {
            "errors": F.when(is_call, _errors(F.col("arguments"), F.col("fields"))),
            "canonical": canonical(F.col("arguments")),
            "status": F.when(~is_call, "orphan_result").when(F.col("r").isNull(), "unanswered").otherwise("linked"),
        }
    )
    # pieces in the order of their keys, so the whole has sorted keys too
    text = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    call = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit("}")
    )
    result = F.concat(F.lit('{"content":'), text(F.col("r.content")), F.lit(',"id":'), text(F.col("call_id")), F.lit("}"))
    message = F.concat(
        F.lit('{"call":'), F.when(is_call, call).otherwise("null"), F.lit(',"result":'), F.when(F.col("r").isNotNull(), result).otherwise("null"), F.lit("}")
    )
    return joined.select(
        "conv_id",
        "call_id",
        F.col("turn").alias("call_turn"),
        F.col("r.turn").alias("result_turn"),
        "status",
        "level",
        F.coalesce(F.size("errors") == 0, F.lit(False)).alias("valid"),
        "errors",
        message.alias("message"),
    )


def conversation_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read conversations (conv_id, turn, role, text) as calls and results.

    A user's turn calls "reply" with its text and turn, under the id call-TURN, after the call two
    turns before; an assistant's turn is the result of the call one turn before. System turns are
    neither. Null roles count as system's.
    """
    call_id = lambda back: F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))
    users = conversations.where(F.col("role") == "user")
    calls = users.select(
        "conv_id",
        call_id(0).alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.array(call_id(2)).alias("after"),
    )
    results = conversations.where(F.col("role") == "assistant").select("conv_id", call_id(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def format_conversations(conversations: DataFrame) -> DataFrame:
    """link_calls() over conversation_events()."""
    spark = conversations.sparkSession
    calls, results = conversation_events(conversations)
    rows = " union all ".join(f"select '{n}' name, '{f}' field, '{t}' type, {str(r).lower()} required" for n, f, t, r in REPLY_SCHEMA)
    return link_calls(calls, results, spark.sql(rows))
