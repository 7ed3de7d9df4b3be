"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results are hash-joined by call id. A call depends on the calls whose ids
its arguments name as {"$result": id}. A call's level is 0 without known dependencies,
else one more than the deepest of them, so that ordering by level, turn and id is a
topological order. Chains of calls with one dependency are shortened by doubling, the rest
follows in rounds; no conversation is ever gathered. Arguments are
parsed as variants and checked against the tool's schema; lengths are those of the strings
themselves, not of their escaped form. Each call is written as
canonical JSON: no white space, keys in order at every depth.

Statuses: `cyclic` (no level exists), `invalid` (arguments or tool do not fit),
`unanswered`, `ok`; and `orphan` for results without a call.

Defined cases: of calls or results that repeat an id, the first by turn (then by
content) stands and `copies` counts them; arguments that are null or no JSON object
are invalid and written as null; an id null in a call or result counts as ''; unknown
dependencies are ignored; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stage

#: Rows up to which the schemas are broadcast; beyond it they are joined by shuffle.
BROADCAST_SCHEMAS = 10_000

CALLS = "conv_id string, turn long, call_id string, tool string, arguments string"
RESULTS = "conv_id string, turn long, call_id string, content string"
SCHEMAS = "tool string, param string, type string, required boolean, min_length int"


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) in the usual JSON forms.

    assistant: {"tool_calls": [{"id", "name", "arguments": {...}}]}; tool: {"tool_call_id", "content"}.
    """
    conv = F.col("conv_id").cast("string").alias("conv_id")
    turn = F.col("turn").cast("long").alias("turn")
    body = F.try_parse_json("text")
    calls = messages.where(F.col("role") == "assistant").select(conv, turn, F.explode(F.try_variant_get(body, "$.tool_calls", "array<variant>")).alias("c"))
    calls = calls.select("conv_id", "turn", F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("tool"), F.to_json(F.try_variant_get("c", "$.arguments", "variant")).alias("arguments"))
    results = messages.where(F.col("role") == "tool").select(conv, turn, F.try_variant_get(body, "$.tool_call_id", "string").alias("call_id"), F.try_variant_get(body, "$.content", "string").alias("content"))
    return calls, results.where(F.col("call_id").isNotNull())


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain conversations.

    A user turn calls `respond`, a system turn `configure`; an assistant turn is the
    result of the call at the turn before it. A call to respond from turn 2 on takes what
    that turn's predecessor answered as its context: the result of the call two turns before.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")

    def ident(t: Column) -> Column:
        return F.concat(conv, F.lit(":"), F.coalesce(t.cast("string"), F.lit("")))

    user = F.col("role") == "user"
    whole = {"ignoreNullFields": "false"}
    prompt = [F.col("text").alias("prompt"), turn.alias("turn")]
    context = F.create_map(F.lit("$result"), ident(turn - 2)).alias("context")
    asked = F.when(turn >= 2, F.to_json(F.struct(context, *prompt), whole)).otherwise(F.to_json(F.struct(*prompt), whole))
    arguments = F.when(user, asked).otherwise(F.to_json(F.struct(F.col("text").alias("policy")), whole))
    calls = conversations.where(F.col("role").isin("user", "system")).select(conv.alias("conv_id"), turn.alias("turn"), ident(turn).alias("call_id"), F.when(user, "respond").otherwise("configure").alias("tool"), arguments.alias("arguments"))
    results = conversations.where(F.col("role") == "assistant").select(conv.alias("conv_id"), turn.alias("turn"), ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = conversations.sparkSession.createDataFrame([("respond", "prompt", "string", True, 1), ("respond", "turn", "integer", True, 0), ("respond", "context", "object", False, 0), ("configure", "policy", "string", True, 1)], SCHEMAS)
    return calls, results, schemas


def _kind(value: Column) -> Column:
    """JSON type of a variant; null for an absent one."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
    )


def _validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with errors: what does not fit, in the order of the parameters."""
    specs = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required", "min_length"))).alias("spec"))
    if schemas.limit(BROADCAST_SCHEMAS + 1).count() <= BROADCAST_SCHEMAS:
        specs = F.broadcast(specs)
    parsed = calls.withColumn("args", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("args", F.when(_kind(F.col("args")) == "object", F.col("args")))
    # each value's JSON text and type by name
    values = F.expr("try_variant_get(args, '$', 'map<string,variant>')")
    held = parsed.join(specs, "tool", "left").withColumn("given", values)

    def check(p: Column) -> Column:
        value = F.try_element_at(F.col("given"), p["param"])
        kind = _kind(value)
        fits = (kind == p["type"]) | ((kind == "integer") & (p["type"] == "number"))
        short = (kind == "string") & (F.length(F.try_variant_get(value, "$", "string")) < p["min_length"])
        return F.when(value.isNull(), F.when(p["required"], F.concat(F.lit("missing "), p["param"]))).when(~fits, F.concat(F.lit("type of "), p["param"])).when(short, F.concat(F.lit("too short "), p["param"]))

    unknown = F.transform(F.filter(F.map_keys("given"), lambda k: ~F.exists(F.col("spec"), lambda p: p["param"] == k)), lambda k: F.concat(F.lit("unknown "), k))
    errors = F.when(F.col("spec").isNull(), F.array(F.lit("unknown tool"))).when(F.col("args").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_compact(F.concat(F.transform("spec", check), F.array_sort(unknown))))
    return held.withColumn("errors", errors).drop("spec", "given")


def _links(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, needs: the ids that a call's arguments name, at any depth.

    Canonical JSON holds such an object in one form, and a quote inside a string is escaped
    there, so no text can look like one; the id is read as the JSON string it is.
    """
    named = F.regexp_extract_all("arguments", F.lit(r'\{"\$result":("(?:[^"\\]|\\.)*+")\}'), F.lit(1))
    ids = F.array_distinct(F.transform(named, lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string")))
    return calls.where(F.col("arguments").contains('"$result"')).select("conv_id", "call_id", F.explode(ids).alias("needs"))


def _levels(calls: DataFrame, stage: Stage) -> DataFrame:
    """conv_id, call_id, level; calls on cycles, or after them, are missing.

    Calls that need just one other are hung by doubling steps on the next call up their
    chain that needs none or several, so a chain of any length takes rounds by its
    logarithm. Calls with several needs then follow in rounds of which each takes up the
    calls it made ready (the frontier) and forgets the links it has used.
    """
    keys = ["conv_id", "call_id"]
    ids = calls.select("conv_id", F.col("call_id").alias("needs"))
    links = stage.write(_links(calls).join(ids, ["conv_id", "needs"], "left_semi"))
    if links.isEmpty():
        return calls.select(*keys).withColumn("level", F.lit(0))
    counts = stage.write(links.groupBy(*keys).agg(F.count("*").alias("n"), F.max("needs").alias("one")))
    roots = calls.select(*keys).join(counts, keys, "left_anti").select(*keys, F.lit(0).alias("level"))

    # chains: up is the call that stands `steps` needs above
    chained = stage.write(counts.where("n = 1").select(*keys, F.col("one").alias("up"), F.lit(1).alias("steps"), F.lit(False).alias("ends")))
    ended, open_ = [], chained
    while True:
        above = open_.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        hung = stage.write(open_.join(above, ["conv_id", "up"], "left"))
        done = hung.where("next IS NULL").select(*keys, "up", "steps")
        # a chain that stands on one already hung ends where that one does
        if ended:
            known = ended[0]
            for part in ended[1:]:
                known = known.unionByName(part)
            held = hung.where("next IS NULL").join(known.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("top"), F.col("steps").alias("rest")), ["conv_id", "up"], "left")
            done = held.select(*keys, F.coalesce("top", "up").alias("up"), (F.col("steps") + F.coalesce("rest", F.lit(0))).alias("steps"))
        done = stage.write(done)
        if done.isEmpty():
            break  # what is left goes in circles
        ended.append(done)
        open_ = stage.write(hung.where("next IS NOT NULL").select(*keys, F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps")))
        if open_.isEmpty():
            break
    chains = ended[0] if ended else None
    for part in ended[1:]:
        chains = chains.unionByName(part)

    def hanging(tops: DataFrame) -> DataFrame:
        """Levels of the calls whose chains end at the calls of `tops`."""
        on = tops.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"))
        return chains.join(on, ["conv_id", "up"]).select(*keys, (F.col("base") + F.col("steps")).alias("level"))

    several = counts.where("n > 1")
    level = roots if chains is None else roots.unionByName(hanging(roots))
    out, frontier = [stage.write(level)], None
    if several.isEmpty():
        return out[0]
    frontier = out[0]
    waiting = stage.write(links.join(several.select(*keys), keys, "left_semi"))
    state = stage.write(several.select(*keys, F.col("n").alias("left"), F.lit(-1).alias("deepest")))
    while True:
        told = stage.write(waiting.join(frontier.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"]))
        if told.isEmpty():
            break
        news = told.groupBy(*keys).agg(F.count("*").alias("met"), F.max("level").alias("top"))
        state = stage.write(state.join(news, keys, "left").select(*keys, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"), F.greatest("deepest", F.coalesce("top", F.lit(-1))).alias("deepest")))
        ready = state.where(F.col("left") == 0).select(*keys, (F.col("deepest") + 1).cast("int").alias("level"))
        frontier = stage.write(ready if chains is None else ready.unionByName(hanging(ready)))
        out.append(frontier)
        state = state.where("left > 0")
        waiting = stage.write(waiting.join(told.select(*keys, "needs"), [*keys, "needs"], "left_anti"))
    levels = out[0]
    for part in out[1:]:
        levels = levels.unionByName(part)
    return levels


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, tool, status, level, copies, errors, message; one row a call id and orphaned result."""
    stage = Stage(calls.sparkSession, "tools")
    key = [F.coalesce("conv_id", F.lit("")).alias("conv_id"), F.coalesce("call_id", F.lit("")).alias("call_id")]
    keys = ["conv_id", "call_id"]
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments")).alias("arguments")
    first = calls.select(*key, F.struct("turn", "tool", canonical).alias("c")).groupBy(*keys).agg(F.min("c").alias("c"), F.count("*").alias("copies"))
    one = stage.write(first.select(*keys, "c.turn", "c.tool", "c.arguments", "copies"))
    answer = results.select(*key, F.struct(F.col("turn").alias("result_turn"), "content").alias("r")).groupBy(*keys).agg(F.min("r").alias("r"), F.count("*").alias("answers"))
    checked = _validated(one.join(_levels(one, stage), keys, "left"), schemas)
    both = checked.join(answer, keys, "full_outer")
    called = F.col("copies").isNotNull()
    status = (
        F.when(~called, "orphan")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("answers").isNull(), "unanswered")
        .otherwise("ok")
    )
    shaped = F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "level", F.col("tool").alias("name"), F.col("r.content").alias("result"))
    return both.select(
        "conv_id",
        F.coalesce("turn", "r.result_turn").alias("turn"),
        "call_id",
        "tool",
        status.alias("status"),
        "level",
        F.coalesce("copies", "answers").alias("copies"),
        F.array_join(F.coalesce("errors", F.array().cast("array<string>")), "; ").alias("errors"),
        F.to_json(shaped, {"ignoreNullFields": "false"}).alias("message"),
    )
