"""Tool-call linking for chats, in DataFrame functions only.

Calls and results meet by a hash join on the call's identifier. A call may name the call whose result it builds on; pointer jumping over these
references gives each call's depth (its place in a topological order) in as many rounds as the logarithm of the longest chain, and shows cycles.
Arguments are checked against the tools' schemas, and linked calls are written as canonical JSON: keys in order, no spaces, nulls written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogia.llm import common

#: Tools, their arguments by name: type, required, and bounds of an integer or of a string's length.
Schema = dict[str, dict[str, tuple[str, bool, int | None, int | None]]]
CHAT_TOOLS: Schema = {
    "respond": {"prompt": ("string", True, 1, None), "turn": ("int", True, 0, None)},
    "configure": {"prompt": ("string", True, 1, 2_000), "turn": ("int", True, 0, 0)},
}
MAX_ROUNDS = 64


def argument_errors(name: Column, arguments: Column, tools: Schema) -> Column:
    """What is wrong with a call, in order: unknown_tool, not_an_object, then missing:, type: or range: with the argument's name, then unexpected arguments."""
    v = F.try_parse_json(arguments)
    whole = F.schema_of_variant(v)
    keys = F.json_object_keys(F.when(whole.startswith("OBJECT"), arguments))
    checks = F.array().cast("array<string>")
    for tool, fields in sorted(tools.items()):
        found = []
        for field, (kind, required, low, high) in sorted(fields.items()):
            part = F.try_variant_get(v, f"$.{field}", "variant")
            absent = part.isNull() | F.is_variant_null(part)
            told = F.schema_of_variant(part)
            right = told == "STRING" if kind == "string" else told == "BIGINT"
            value = F.length(F.try_variant_get(v, f"$.{field}", "string")) if kind == "string" else F.try_variant_get(v, f"$.{field}", "bigint")
            outside = F.lit(False)
            if low is not None:
                outside = outside | (value < low)
            if high is not None:
                outside = outside | (value > high)
            found.append(F.when(absent, F.lit(f"missing:{field}") if required else F.lit(None)).when(~F.coalesce(right, F.lit(False)), F.lit(f"type:{field}")).when(F.coalesce(outside, F.lit(False)), F.lit(f"range:{field}")))
        own = F.array_compact(F.array(*found).cast("array<string>"))
        more = F.transform(F.array_sort(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, sorted(fields))))), lambda k: F.concat(F.lit("unexpected:"), k))
        checks = F.when(name == tool, F.concat(own, more)).otherwise(checks)
    return (
        F.when(name.isNull() | ~name.isin(*tools), F.array(F.lit("unknown_tool")))
        .when(v.isNull() | ~F.coalesce(whole.startswith("OBJECT"), F.lit(False)), F.array(F.lit("not_an_object")))
        .otherwise(checks)
    )


def depths(calls: DataFrame) -> DataFrame:
    """calls: call_id (unique), parent_id. Returns call_id, depth: calls before it in its chain; null for a call in a cycle or behind one.

    A parent that isn't there counts as none.
    """
    known = calls.select(F.col("call_id").alias("up"))
    state = calls.select("call_id", "parent_id").join(known, F.col("parent_id") == F.col("up"), "left").select("call_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = common.saved(state, "chat-depth")
    left, before = state.filter("up is not null").count(), None
    rounds = 0
    while left and rounds < MAX_ROUNDS:
        # Every open call's pointer leads `depth` calls up; roots' depths are final, so a pointer to a finished call finishes.
        target = state.select(F.col("call_id").alias("t"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = common.saved(state.join(target, F.col("up") == F.col("t"), "left").select("call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chat-depth")
        now = state.filter("up is not null").count()
        rounds += 1
        if now == left == before:  # two rounds without a finished call: only cycles are left
            break
        before, left = left, now
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, tools: Schema) -> DataFrame:
    """calls: call_id, conv_id, name, arguments (JSON text), parent_id. results: call_id, result_id, content.

    A row for each different call_id and for each result without a call:
    kind (call or orphan_result), conv_id, call_id, depth, name, n_calls and n_results (repeats of the identifier; the smallest content counts), result_id,
    status (linked, unanswered, cycle, orphan), valid, errors (comma-separated), message (canonical JSON).
    Null identifiers link nothing: each such call is an unanswered row of its own, each such result an orphan row of its own.
    """
    calls = calls.select("call_id", "conv_id", "name", "arguments", "parent_id")
    nameless, calls = calls.filter("call_id is null"), calls.filter("call_id is not null")
    lone, results = results.filter("call_id is null"), results.filter("call_id is not null")
    one = calls.groupBy("call_id").agg(F.min(F.struct("conv_id", "name", "arguments", "parent_id")).alias("c"), F.count("*").alias("n_calls"))
    one = common.saved(one.select("call_id", "c.*", "n_calls"), "chat-calls")
    answers = results.groupBy(F.col("call_id").alias("rid")).agg(F.min(F.struct("content", "result_id")).alias("r"), F.count("*").alias("n_results"))
    place = depths(one.select("call_id", "parent_id"))
    both = one.join(answers, F.col("call_id") == F.col("rid"), "full_outer").join(place.withColumnRenamed("call_id", "pid"), F.col("call_id") == F.col("pid"), "left")
    behind = F.when(F.col("pid").isNull(), 0).otherwise(F.col("depth") + 1).cast("long")
    nameless = nameless.join(place.withColumnRenamed("call_id", "pid"), F.col("parent_id") == F.col("pid"), "left").withColumn("depth", behind).withColumn("n_calls", F.lit(1).cast("long"))
    lone = lone.select(F.struct("content", "result_id").alias("r"), F.lit(1).cast("long").alias("n_results"))
    both = both.unionByName(nameless, allowMissingColumns=True).unionByName(lone, allowMissingColumns=True)
    is_call = F.col("n_calls").isNotNull()
    errors = argument_errors(F.col("name"), F.col("arguments"), tools)
    status = F.when(~is_call, "orphan").when(F.col("depth").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    boxed = lambda c: F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})  # noqa: E731  {"x":...}
    quoted = lambda c: boxed(c).substr(F.lit(6), F.length(boxed(c)) - 6)
    canonical = F.to_json(F.try_parse_json("arguments"))  # a variant's keys are in order
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical, F.lit("null")),
        F.lit(',"id":'), quoted(F.coalesce("call_id", "rid")),
        F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), quoted(F.col("r.content")), F.lit("}"),
    )
    return both.select(
        F.when(is_call, "call").otherwise("orphan_result").alias("kind"),
        "conv_id",
        F.coalesce("call_id", "rid").alias("call_id"),
        F.col("depth"),
        "name",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.col("r.result_id").alias("result_id"),
        status.alias("status"),
        F.when(is_call, F.size(errors) == 0).alias("valid"),
        F.when(is_call, F.array_join(errors, ",")).alias("errors"),
        message.alias("message"),
    )


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each turn that isn't an assistant's is a call (configure for a system turn, else respond) with its text and number as arguments; each assistant turn answers the turn before it.

    Null ids, turns and texts stay null; repeated turns share an identifier (see link_calls). Empty tables give empty tables; other columns don't matter.
    Identifiers are conversation:turn. A call builds on the call two turns before it, whose answer lies between; turn 1 builds on turn 0.
    """
    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    at = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    is_call = F.coalesce(F.col("role") != "assistant", F.lit(True))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    calls = src.filter(is_call).select(
        F.when(known, at(0)).alias("call_id"), "conv_id", F.when(F.col("role") == "system", "configure").otherwise("respond").alias("name"), arguments.alias("arguments"), F.when(known & (F.col("turn") == 1), at(1)).when(known & (F.col("turn") > 1), at(2)).alias("parent_id")
    )
    results = src.filter(~is_call).select(F.when(known, at(1)).alias("call_id"), at(0).alias("result_id"), F.col("text").alias("content"))
    return calls, results


def linked_conversations(conversations: DataFrame) -> DataFrame:
    calls, results = turns_as_calls(conversations)
    return link_calls(calls, results, CHAT_TOOLS)
