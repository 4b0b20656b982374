"""Linking of tool calls and results in conversations, in Spark's own functions.

Calls and results are hash-joined by (conversation, identifier). A call may name
the call it comes after; its depth in that order comes from pointer doubling,
which takes a logarithm of the longest chain in rounds and never gathers a
conversation. Sorting by (depth, turn) is a topological order; calls on a cycle,
or behind one, have no depth. Arguments are checked against the tool's
parameters and each link is written as canonical JSON: sorted keys, no blanks.

Calls or results without conversation or identifier are left out. Of several
calls (or results) with one identifier the first by turn, then by content,
counts; ``call_copies`` and ``result_copies`` tell how many there were. A call to
an unknown tool, arguments that are no JSON object, and a result without a call
are reported, not dropped. Empty tables give no rows; other columns are not read.

``whole_conversations`` adds to the links of plain conversations a row for every
turn that ``link`` leaves out, so that all their text comes back: turns of other
roles (``other``), turns without conversation or number (``unlinked``), and texts
that stand on a turn's number beside the one that counts (``copy``, a row per
text, whose copies are its own only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, staged

ID = ["conv_id", "call_id"]
JSON_KINDS = {
    "string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE)",
    "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID",
}


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls with one row per identifier and a column ``after``."""
    known = calls.select("conv_id", F.col("call_id").alias("next"), F.lit(True).alias("there"))
    nodes = staged(
        calls.select(*ID, F.col("after").alias("next"))
        .join(known, ["conv_id", "next"], "left")
        .select(*ID, F.when(F.col("there"), F.col("next")).alias("next"), F.col("there").isNotNull().cast("long").alias("depth")),
        "call-chains",
    )
    left, most = nodes.filter("next IS NOT NULL").count(), nodes.count()
    reach = 1
    while left and reach <= most:
        step = nodes.select(
            "conv_id", F.col("call_id").alias("next"), F.col("next").alias("far"), F.col("depth").alias("more")
        )
        nodes = staged(
            nodes.join(step, ["conv_id", "next"], "left").select(
                *ID, F.col("far").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ),
            "call-chains",
        )
        left, reach = nodes.filter("next IS NOT NULL").count(), reach * 2
    # who still points on after that many steps is on a cycle or behind one
    return nodes.select(*ID, F.when(F.col("next").isNull(), F.col("depth")).alias("depth"))


def kind_fits(value: Column, kind: Column) -> Column:
    shape = F.schema_of_variant(value)
    fits = F.lit(False)
    for name, pattern in JSON_KINDS.items():
        fits = fits | ((kind == name) & shape.rlike(pattern))
    return fits


def argument_errors(arguments: Column, parameters: Column) -> Column:
    """Sorted faults of a map of arguments against parameters (parameter, type, required)."""
    names = F.transform(parameters, lambda p: p["parameter"])
    missing = F.transform(
        F.filter(parameters, lambda p: p["required"] & ~F.map_contains_key(arguments, p["parameter"])),
        lambda p: F.concat(F.lit("missing "), p["parameter"]),
    )
    unknown = F.transform(
        F.array_except(F.map_keys(arguments), names), lambda k: F.concat(F.lit("unknown "), k)
    )
    wrong = F.transform(
        F.filter(
            parameters,
            lambda p: F.map_contains_key(arguments, p["parameter"])
            & ~kind_fits(F.element_at(arguments, p["parameter"]), p["type"]),
        ),
        lambda p: F.concat(F.lit("type "), p["parameter"]),
    )
    return F.array_sort(F.concat(missing, unknown, wrong))


def linked_message(arguments: Column, call_id: Column, name: Column, result: Column) -> Column:
    """Canonical JSON of a link."""
    fields = [arguments.alias("arguments"), call_id.alias("id"), name.alias("name"), result.alias("result")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def link(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row per identifier that a call or a result carries.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (a call_id);
    results: conv_id, call_id, turn, content; parameters: name, parameter, type, required.
    """
    sound = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first_call = calls.filter(sound).groupBy(*ID).agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("call"), F.count("*").alias("call_copies")
    )
    first_call = staged(first_call.select(*ID, "call.*", "call_copies"), "calls")
    first_result = results.filter(sound).groupBy(*ID).agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("result_copies")
    )
    tools = staged(
        parameters.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("parameter", "type", "required"))).alias("parameters")),
        "tools",
    )  # a row per tool, a tool's parameters
    tools_side = tools if tools.count() > 10_000 else F.broadcast(tools)
    checked = (
        first_call.join(depths(first_call), ID)
        .join(tools_side, "name", "left")
        .withColumn("value", F.try_parse_json("arguments"))
        .withColumn("shape", F.schema_of_variant("value"))
        .withColumn(
            "fields",
            F.when(F.col("shape").startswith("OBJECT"), F.from_json("arguments", "map<string,variant>")),
        )
        .withColumn(
            "errors",
            F.when(F.col("parameters").isNull(), F.array(F.lit("unknown tool")))
            .when(F.col("fields").isNull(), F.array(F.lit("no JSON object")))
            .otherwise(argument_errors(F.col("fields"), F.col("parameters"))),
        )
        .select(*ID, F.col("turn").alias("call_turn"), "name", "value", "arguments", "depth", "errors", "call_copies")
    )
    answers = first_result.select(
        *ID, F.col("result.turn").alias("result_turn"), F.col("result.content").alias("content"), "result_copies"
    )
    both = checked.join(answers, ID, "full")
    status = (
        F.when(F.col("call_copies").isNull(), "orphan")
        .when(F.col("result_copies").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("call_turn"), "early")
        .otherwise("answered")
    )
    message = linked_message(F.col("value"), F.col("call_id"), F.col("name"), F.col("content"))
    return both.select(
        *ID, "call_turn", "result_turn", "name", "depth", status.alias("status"),
        F.array_join("errors", ";").alias("errors"),
        F.coalesce("call_copies", F.lit(0)).alias("call_copies"),
        F.coalesce("result_copies", F.lit(0)).alias("result_copies"),
        message.alias("message"),
    )


PARAMETERS = [  # name, parameter, type, required
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("search", "exact", "boolean", False),
    ("lookup", "topic", "string", True),
    ("lookup", "weight", "number", True),
    ("note", "text", "string", True),
]


def calls_of(conversations: DataFrame) -> DataFrame:
    """Calls that the user turns of plain conversations stand for.

    A turn's length picks the tool; every tool carries the whole text, and some
    lengths leave out or mistype another argument. A call comes after the one two
    turns before, if there is one.
    """
    n = F.length("text")
    text, exact = F.col("text"), (n > 50).alias("exact")
    arguments = (
        F.when(n % 4 == 0, F.to_json(F.struct(n.alias("limit"), text.alias("query"))))
        .when(n % 4 == 1, F.to_json(F.struct((n * 0.5).alias("weight"), text.alias("topic"))))
        .when(n % 4 == 2, F.to_json(F.struct(text, (n > 100).alias("urgent"))))
        .when(n % 8 == 3, F.to_json(F.struct(n.cast("string").alias("limit"), exact, text.alias("query"))))
        .otherwise(F.to_json(F.struct(exact, text.alias("query"))))
    )
    name = F.when(n % 4 == 1, "lookup").when(n % 4 == 2, "note").otherwise("search")
    return conversations.filter("role = 'user'").select(
        "conv_id",
        F.concat("conv_id", F.lit("-"), "turn").alias("call_id"),
        "turn",
        F.coalesce(name, F.lit("search")).alias("name"),
        arguments.alias("arguments"),
        F.concat("conv_id", F.lit("-"), F.col("turn") - 2).alias("after"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """Assistant turns as results of the call one turn before."""
    return conversations.filter("role = 'assistant'").select(
        "conv_id",
        F.concat("conv_id", F.lit("-"), F.col("turn") - 1).alias("call_id"),
        "turn",
        F.col("text").alias("content"),
    )


def link_conversations(conversations: DataFrame) -> DataFrame:
    """Calls and results of plain conversations, linked."""
    parameters = conversations.sparkSession.createDataFrame(
        PARAMETERS, "name string, parameter string, type string, required boolean"
    )
    return link(calls_of(conversations), results_of(conversations), parameters)


def later_copies(rows: DataFrame, content: list[str]) -> DataFrame:
    """The contents that an identifier carries beside the one that counts, and how often."""
    sound = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    kinds = rows.filter(sound).groupBy(*ID, F.struct("turn", *content).alias("kind")).agg(F.count("*").alias("copies"))
    several = kinds.groupBy(*ID).agg(F.min("kind").alias("first"), F.count("*").alias("kinds")).filter("kinds > 1")
    return kinds.join(several, ID).filter(F.col("kind") > F.col("first")).select(*ID, "kind.*", "copies")


def whole_conversations(conversations: DataFrame) -> DataFrame:
    """The links of plain conversations, and a row for every turn or text that is in none of them."""
    links = link_conversations(conversations)
    role, none = F.coalesce("role", F.lit("")), F.lit(None)
    spoken = role.isin("user", "assistant")
    turn = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"})
    others = conversations.filter(~spoken | F.col("conv_id").isNull() | F.col("turn").isNull()).select(
        "conv_id", F.col("turn").alias("call_turn"), F.when(spoken, "unlinked").otherwise("other").alias("status"),
        turn.alias("message"),
    )
    calls = later_copies(calls_of(conversations), ["name", "arguments", "after"]).select(
        *ID, F.col("turn").alias("call_turn"), "name", F.lit("copy").alias("status"), F.col("copies").alias("call_copies"),
        linked_message(F.try_parse_json("arguments"), F.col("call_id"), F.col("name"), none.cast("string")).alias("message"),
    )
    results = later_copies(results_of(conversations), ["content"]).select(
        *ID, F.col("turn").alias("result_turn"), F.lit("copy").alias("status"), F.col("copies").alias("result_copies"),
        linked_message(none.cast("variant"), F.col("call_id"), none.cast("string"), F.col("content")).alias("message"),
    )
    for rows in (others, calls, results):
        counts = {c: F.col(c) if c in rows.columns else F.lit(0).cast("long") for c in ("call_copies", "result_copies")}
        links = links.unionByName(rows.withColumns(counts), allowMissingColumns=True)
    return links
