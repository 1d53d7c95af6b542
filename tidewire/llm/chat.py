"""Chat formatting: links tool calls with their results, orders them, checks arguments, and writes canonical JSON.

DataFrame operations only. Calls are (conv_id, call_id, turn, tool, arguments, depends_on), results (conv_id, call_id, turn,
content); arguments is JSON text. Rows are one for each (conv_id, call_id) that either side has:

* status: linked, unanswered (no result), orphan (no call). Of several calls, or results, with one id the first by turn,
  then by content counts, and n_calls and n_results tell how many there were.
* position: place, the latest turn of a call and of all calls that it depends on, directly or not; level, how many calls the
  longest chain of dependencies before it has. In order of place and level every call comes after those it depends on.
  Calls that wait for themselves, or for such a call, keep their own turn and have the level -1.
* errors: of the arguments against the tool's parameters, and dependencies that are missing, in a fixed order.
* message: canonical JSON, keys sorted, no blanks, null fields left out.

Null ids link with nothing and are left out. Nothing is gathered by conversation, so a conversation may be of any length. An
empty table on either side gives the other side's rows alone; other columns are ignored; a very long text stays in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import appended, materialize

#: Parameter kinds, and the SQL names of the types that values of theirs have.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
MOST_PARAMETERS = 2000

Tools = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(tool: Column, parsed: Column, tools: Tools) -> Column:
    """Array of errors of parsed arguments (a variant, null if they are no JSON) against {tool: {parameter: (kind, required)}}."""
    if sum(map(len, tools.values())) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    fields = parsed.try_cast("map<string, variant>")
    none = F.array().cast("array<string>")
    checked = none
    for name, parameters in sorted(tools.items()):
        errors = [
            F.when(
                F.element_at(fields, p).isNull() | (F.schema_of_variant(F.element_at(fields, p)) == "VOID"),
                F.lit(f"{p}: missing") if required else F.lit(None).cast("string"),
            ).when(~F.schema_of_variant(F.element_at(fields, p)).rlike(f"^({KINDS[kind]})"), F.lit(f"{p}: not {kind}"))
            for p, (kind, required) in sorted(parameters.items())
        ]
        known = F.array(*(F.lit(p) for p in sorted(parameters))).cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(F.map_keys(fields), known)), lambda k: F.concat(k, F.lit(": unknown")))
        checked = F.when(tool == name, F.concat(F.array_compact(F.array(*errors).cast("array<string>")), extra)).otherwise(checked)
    named = F.when(tool.isin(*tools), checked).otherwise(F.array(F.lit("tool: unknown")))
    return F.when(parsed.isNull(), F.array(F.lit("arguments: no JSON"))).when(fields.isNull(), F.array(F.lit("arguments: no object"))).otherwise(named)


def order(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, level) for calls (conv_id, call_id, turn) and depends (conv_id, call_id, on).

    A waiting call has routes to others: (end, steps, top: latest turn on the way, least: level that it has in any case).
    Each round ends the calls all of whose ends are done. Those that wait for one end alone are followed by pointer doubling,
    so a run of them takes rounds by the logarithm of its length; then the other calls' routes are led on through them, and
    of several routes to one end the longest counts, which often leaves a call with one. What no round ends is in a cycle.
    """
    keys = ["conv_id", "call_id"]
    known = depends.join(calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn")), ["conv_id", "on"]).join(calls.select(*keys, "turn"), keys)
    zero = F.lit(0).cast("long")
    route = [*keys, "end", "steps", "top", "least"]
    routes = materialize(known.select(*keys, F.col("on").alias("end"), (zero + 1).alias("steps"), F.greatest("on_turn", "turn").alias("top"), zero.alias("least")))
    if not routes.limit(1).count():
        return calls.select(*keys, F.col("turn").alias("place"), zero.alias("level"))
    longest = calls.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    done, path = appended(calls.join(routes.select(*keys).distinct(), keys, "left_anti").select(*keys, zero.alias("level"), F.col("turn").alias("place")))
    while True:
        ends = done.select("conv_id", F.col("call_id").alias("end"), "level", F.col("place").alias("end_place"))
        met = routes.join(ends, ["conv_id", "end"], "left")
        state = materialize(met.groupBy(*keys).agg(F.max(F.greatest("least", F.col("level") + F.col("steps"))).alias("floor"), F.max(F.greatest("top", "end_place")).alias("place"), F.count_if(F.col("level").isNull()).alias("open")))
        ready = state.filter("open = 0").select(*keys, F.col("floor").alias("level"), "place")
        if not ready.limit(1).count():
            break
        rest = materialize(met.filter("level is null").select(*keys, "end", "steps").join(state, keys).select(*keys, "end", "steps", F.col("place").alias("top"), F.col("floor").alias("least"), "open"))
        done, path = appended(ready, path)
        if not rest.limit(1).count():
            break
        runs = _followed(rest.filter("open = 1").select(*route), longest)
        through = runs.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("to"), F.col("steps").alias("more"), F.col("top").alias("end_top"), F.col("least").alias("end_least"))
        led = rest.filter("open > 1").join(through, ["conv_id", "end"], "left")
        led = led.select(*keys, F.coalesce("to", "end").alias("end"), (F.col("steps") + F.coalesce("more", zero)).alias("steps"), F.greatest("top", "end_top").alias("top"), F.greatest("least", F.col("end_least") + F.col("steps")).alias("least"))
        routes = materialize(runs.unionByName(led.groupBy(*keys, "end").agg(*(F.max(c).alias(c) for c in ("steps", "top", "least")))))
    return calls.select(*keys, "turn").join(done, keys, "left").select(*keys, F.coalesce("place", "turn").alias("place"), F.coalesce("level", zero - 1).alias("level"))


def _followed(single: DataFrame, longest: int) -> DataFrame:
    """Routes of calls with one route each, led on to the first end that is not such a call itself. Those that go round in a cycle are left out: they have taken more steps than a conversation has calls."""
    keys = ["conv_id", "call_id"]
    at = single.withColumn("moved", F.lit(True))
    at = materialize(at)
    for _ in range(longest.bit_length() + 1):
        on = at.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("top").alias("next_top"), F.col("steps").alias("more"), F.col("least").alias("next_least"))
        at = at.join(on, ["conv_id", "end"], "left").select(
            *keys, F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.greatest("top", "next_top").alias("top"),
            F.greatest("least", F.col("next_least") + F.col("steps")).alias("least"), F.col("next").isNotNull().alias("moved"),
        )
        at = materialize(at)
        if not at.filter("moved").limit(1).count():
            break
    return at.filter("not moved").drop("moved")


def link(calls: DataFrame, results: DataFrame, tools: Tools) -> DataFrame:
    keys = ["conv_id", "call_id"]
    has = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    first = F.min(F.struct("turn", "tool", "arguments", "depends_on"))
    asked = calls.filter(has).groupBy(*keys).agg(first.alias("call"), F.count("*").alias("n_calls"))
    given = results.filter(has).groupBy(*keys).agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("result"), F.count("*").alias("n_results"))
    asked = materialize(asked.select(*keys, "call.*", "n_calls"))
    depends = asked.select(*keys, F.explode("depends_on").alias("on")).filter("on is not null").distinct()
    placed = order(asked.select(*keys, "turn"), depends)
    names = asked.select("conv_id", F.col("call_id").alias("on"))
    missing = depends.join(names, ["conv_id", "on"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("on")).alias("missing"))
    parsed = asked.join(placed, keys).join(missing, keys, "left").withColumn("parsed", F.try_parse_json("arguments"))
    lost = F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda x: F.concat(F.lit("depends_on: no "), x))
    checked = parsed.withColumn("errors", F.concat(argument_errors(F.col("tool"), F.col("parsed"), tools), lost))
    both = checked.join(given.select(*keys, "result.*", "n_results").hint("shuffle_hash"), keys, "full")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    text = lambda c: F.when(F.col(c).isNotNull(), quoted(c))
    arguments = F.when(F.col("n_calls").isNotNull(), F.coalesce(F.to_json("parsed"), text("arguments")))
    message = F.concat(F.lit("{"), F.concat_ws(",", field("arguments", arguments), field("call_id", text("call_id")), field("result", text("content")), field("tool", text("tool"))), F.lit("}"))
    return both.select(
        *keys,
        "turn",
        F.coalesce("place", "result_turn").alias("place"),
        F.coalesce("level", F.lit(0).cast("long")).alias("level"),
        status.alias("status"),
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.array_join(F.coalesce("errors", F.array().cast("array<string>")), "; ").alias("errors"),
        message.alias("message"),
    )


#: The tool that answers a user's turn.
REPLY: Tools = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls the tool reply, the assistant's next turn is its result, and a call depends on the one before."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    asks = conversations.filter("role = 'user' and conv_id is not null and turn is not null")
    before = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = asks.select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("tool"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"),
        before.alias("depends_on"),
    )
    answers = conversations.filter("role = 'assistant' and conv_id is not null and turn is not null")
    return calls, answers.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))


#: Tools of tool_turns.
TOOLS: Tools = {
    "reply": REPLY["reply"],
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "rate": {"value": ("number", True), "tags": ("array", False)},
}


def tool_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations seen as a mix of tools, one of which is not known, with arguments some of which are wrong.

    A user's turn is a call, the assistant's next turn its result. By conv_id modulo 6, calls depend on the call before (0 to
    2), on the call after (3), on the two before at every third call (4), or the first two on each other (5).
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turn, conv = F.col("turn"), F.col("conv_id")
    asks = conversations.filter("role = 'user' and conv_id is not null and turn is not null")
    kind, pick = F.pmod(conv, F.lit(6)), F.pmod(conv + F.floor(turn / 2), F.lit(4))
    tool = F.element_at(F.array(*(F.lit(x) for x in ("reply", "search", "rate", "translate"))), (pick + 1).cast("int"))
    none = F.array().cast("array<string>")
    before = F.when(turn >= 2, F.array(name(turn - 2))).otherwise(none)
    first = F.when(turn == 0, F.array(name(turn + 2))).otherwise(before)
    depends = F.when(kind == 3, F.array(name(turn + 2))).when((kind == 4) & (turn % 6 == 4), F.array(name(turn - 2), name(turn - 4))).when(kind == 5, first).otherwise(before)
    text = lambda c: F.col("text").alias(c)
    as_text = lambda c: turn.cast("string").alias(c)
    tags = F.array(F.lit("a"), F.lit("b")).alias("tags")
    value = F.when(turn % 8 == 6, F.to_json(F.struct(as_text("value"), tags))).when(conv % 3 == 0, F.to_json(F.struct(turn.alias("value"), F.lit("x").alias("mood"), tags))).otherwise(F.to_json(F.struct(turn.alias("value"), tags)))
    arguments = (
        F.when(pick == 0, F.to_json(F.struct("turn", text("prompt"))))
        .when(pick == 1, F.when(conv % 5 == 0, F.to_json(F.struct(text("query"), as_text("limit")))).otherwise(F.to_json(F.struct(text("query"), turn.alias("limit")))))
        .when(pick == 2, value)
        .otherwise(F.when(conv % 2 == 0, F.to_json(F.struct(text("text")))).otherwise(F.lit("as above")))
    )
    calls = asks.select("conv_id", name(turn).alias("call_id"), "turn", tool.alias("tool"), arguments.alias("arguments"), depends.alias("depends_on"))
    return calls, turns(conversations)[1]
