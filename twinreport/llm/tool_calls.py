"""Chat formatting: tool calls and results linked, ordered, validated and serialised. DataFrame functions only.

Calls and results meet in a hash join on conversation and identifier. A call's level is 0 if it depends on no other call,
else one more than the highest level among those it depends on. Levels come by pointer doubling: a call that waits for one
other call passes its own wait on to that one's, so a chain of n calls takes about log2(n) rounds, whatever its width
between narrow places; each round is a join and no conversation is gathered in one task. Calls that wait for each other in
a circle, or for a call that is not there, directly or not, get no level. A call's place in its conversation follows level,
then position, then identifier; it is counted in two steps, within and over buckets of positions, as one conversation may
hold a third of all calls.

Arguments are JSON objects. They are valid if they parse, hold every required key of the tool's schema with the type it
names, and no key that the schema does not know. Types are string, integer (up to 38 digits, however spelled), number,
boolean, object, array and null. Canonical JSON has its keys sorted, no white space, and one spelling of each string and
number: numbers of up to 28 digits before and 10 after the point are written out in full without trailing zeros, others
that are equal as doubles as that double. Numbers beyond a double's range and repeated keys do not parse.

Defined results: a call id that occurs several times in a conversation is one call, the least by position, name and
arguments, and n_copies counts them; likewise results. Null conversation or call ids take no part. A result without a call
gives a row without level, place and line, with status orphan_result; a call without result has status no_result, one
without a level has status blocked. Null arguments are invalid, and are serialised as null. Null or repeated dependencies
are ignored. Empty tables give no rows; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import spread_join
from .common import checkpointed

#: A tool's arguments: name: (required keys, all keys and their types).
Schemas = dict[str, tuple[tuple[str, ...], dict[str, str]]]
#: Types of arguments as patterns of the names that Spark gives to canonical values.
TYPES = {
    "string": "STRING",
    "integer": r"BIGINT|DECIMAL\([0-9]+,0\)",
    "number": r"BIGINT|DECIMAL\(.*\)|DOUBLE",
    "boolean": "BOOLEAN",
    "object": "OBJECT<.*>",
    "array": "ARRAY<.*>",
    "null": "VOID",
}
#: Positions in a bucket of the places, and levels in a block of them.
BUCKET = 1024
#: Dependencies of a call through which others are seen to be implied, at most; more only means more rounds.
NARROW = 4
#: A wait that is never over; sums of two fit a long.
FAR = 1 << 60
KEYS = ["conv_id", "call_id"]


def _number(t: Column) -> Column:
    """One spelling of a JSON number."""
    exact, near = t.try_cast("decimal(38,10)"), t.try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(exact.cast("string"), "0+$", ""), r"\.$", "")
    whole = F.when(t == "-0", "0").otherwise(t)
    # A number beyond a double's range makes the whole text unreadable.
    real = F.when(near.isNull() | (F.abs(near) == float("inf")), "beyond").when(exact == 0, "0").when(exact.cast("double") == near, digits).otherwise(near.cast("string"))
    return F.when(t.rlike("^-?[0-9]{1,38}$"), whole).otherwise(real)


def canonical(json: Column) -> Column:
    """Canonical JSON of a JSON text; null if it doesn't parse."""
    # With escapes put aside, every other piece between quotes is outside of strings. Raw control characters, as stand for
    # the escapes meanwhile, are not JSON.
    masked = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    token = lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)
    outside = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit("-?[0-9][0-9.eE+-]*|[^0-9-]+|-"), F.lit(0)), token), "")
    pieces = F.transform(F.split(masked, '"'), lambda x, i: F.when((i % 2 == 0) & x.rlike("[0-9]"), outside(x)).otherwise(x))
    spelled = F.replace(F.replace(F.array_join(pieces, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(~json.rlike("[\x01\x02]"), F.to_json(F.try_parse_json(spelled)))


def valid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether arguments (canonical JSON) fit the schema of the tool `name`."""
    v = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, (required, types) in schemas.items():
        ok = F.schema_of_variant(v).startswith("OBJECT")
        for key, kind in types.items():
            found = F.schema_of_variant(F.try_variant_get(v, f"$['{key}']", "variant"))
            ok = ok & F.coalesce(found.rlike(f"^(?:{TYPES[kind]})$"), F.lit(key not in required))
        known = F.size(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, types)))) == 0
        out = F.when(name == tool, ok & known).otherwise(out)
    return F.coalesce(out, F.lit(False))


def quoted(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    listed = F.to_json(F.to_variant_object(F.array(text)))
    return F.coalesce(listed.substr(F.lit(2), F.length(listed) - 2), F.lit("null"))


def _once(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row for each identifier: the least in the given order, and how many there were."""
    first = F.min(F.struct(*order, *[c for c in columns if c not in order]))
    rows = df.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    return rows.groupBy(*KEYS).agg(first.alias("r"), F.count(F.lit(1)).alias("n")).select(*KEYS, *[F.col(f"r.{c}").alias(c) for c in columns], "n")


def _needs(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, needs: the dependencies of calls, but for those that another one of the same call is seen to imply."""
    wanted = checkpointed(calls.select(*KEYS, F.explode(F.array_distinct(F.filter("depends_on", lambda d: d.isNotNull()))).alias("needs")))
    narrow = calls.filter(F.size(F.array_distinct("depends_on")) <= NARROW).select("conv_id", F.col("call_id").alias("needs"), F.explode(F.array_distinct("depends_on")).alias("further"))
    within = narrow.filter("further IS NOT NULL AND further != needs").groupBy("conv_id", "needs").agg(F.collect_set("further").alias("further"))
    implied = checkpointed(spread_join(wanted, within, ["conv_id", "needs"]).select(*KEYS, F.col("needs").alias("by"), F.explode("further").alias("needs")).filter("needs != call_id"))
    # Only by one that is not implied itself: in a circle all imply each other, and all stay.
    sure = implied.join(implied.select(*KEYS, F.col("needs").alias("by")).distinct(), [*KEYS, "by"], "left_anti")
    return wanted.join(sure.select(*KEYS, "needs").distinct(), [*KEYS, "needs"], "left_anti")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of every call that has one.

    An open call holds k and links (to, d): its level is the greatest of k and of each linked call's level + d.
    """
    waits = checkpointed(_needs(calls).select(*KEYS, F.lit(0).cast("long").alias("k"), F.col("needs").alias("to"), F.lit(1).cast("long").alias("d")))
    placed = checkpointed(calls.select(*KEYS).join(waits.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("level", F.lit(0).cast("long")))
    done = [placed]
    while True:
        # What the last round placed becomes a number; a call without links left is placed.
        met = spread_join(waits, placed.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left")
        least = F.max(F.greatest("k", F.coalesce(F.col("level") + F.col("d"), F.lit(0)))).alias("k")
        rest = F.collect_list(F.when(F.col("level").isNull(), F.struct("to", "d"))).alias("links")
        open_calls = checkpointed(met.groupBy(*KEYS).agg(least, rest))
        placed = open_calls.filter(F.size("links") == 0).select(*KEYS, F.col("k").alias("level"))
        if placed.isEmpty():  # the others wait for ever
            break
        placed = checkpointed(placed)
        done.append(placed)
        if len(done) == 16:
            done = [checkpointed(_all(done))]
        # A link to a call with one link goes on to where that one leads.
        waits = checkpointed(open_calls.filter(F.size("links") > 0).select(*KEYS, "k", F.explode("links").alias("l")).select(*KEYS, "k", "l.to", "l.d"))
        single = open_calls.filter(F.size("links") == 1).select("conv_id", F.col("call_id").alias("to"), F.col("links")[0].alias("next"), F.col("k").alias("k2"))
        led = spread_join(waits, single, ["conv_id", "to"], "left")
        led = led.select(*KEYS, F.greatest("k", F.coalesce(F.col("k2") + F.col("d"), F.lit(0))).alias("k"), F.coalesce("next.to", "to").alias("to"), F.least(F.col("d") + F.coalesce("next.d", F.lit(0)), F.lit(FAR)).alias("d"))
        waits = checkpointed(led.groupBy(*KEYS, "to").agg(F.max("k").alias("k"), F.max("d").alias("d")).select(*KEYS, "k", "to", "d"))
    return _all(done)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls: conv_id, call_id, position, name, arguments (JSON), depends_on (array of call ids); results: conv_id, call_id,
    position, content. One row for each call and each result without a call: status, level, place (from 0), valid, line."""
    one = checkpointed(_once(calls, ["position", "name", "arguments"], ["position", "name", "arguments", "depends_on"]))
    answers = _once(results, ["position", "content"], ["position", "content"])
    answers = answers.select(*KEYS, F.col("position").alias("result_position"), "content", F.col("n").alias("n_results"))
    ranked = one.join(levels(one), KEYS, "left").withColumn("__bucket", F.floor(F.coalesce("position", F.lit(0)) / BUCKET))
    parts = ranked.filter(F.col("level").isNotNull()).groupBy("conv_id", "level", "__bucket").agg(F.count(F.lit(1)).alias("__m"))
    # A conversation may be one chain of calls, with a level each, so sums run within blocks of levels and over the blocks.
    parts = checkpointed(parts.withColumn("__block", F.floor(F.col("level") / BUCKET)))
    over = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("conv_id", "__block").agg(F.sum("__m").alias("__sum")).select("conv_id", "__block", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    within = Window.partitionBy("conv_id", "__block").orderBy("level", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__ahead", F.coalesce(F.sum("__m").over(within), F.lit(0))).join(blocks, ["conv_id", "__block"])
    parts = parts.select("conv_id", "level", "__bucket", (F.col("__ahead") + F.col("__before")).alias("__ahead"))
    inside = Window.partitionBy("conv_id", "level", "__bucket").orderBy("position", "call_id")
    placed = ranked.withColumn("__inside", F.row_number().over(inside) - 1).join(parts, ["conv_id", "level", "__bucket"], "left")
    df = placed.withColumn("place", F.when(F.col("level").isNotNull(), F.col("__ahead") + F.col("__inside")))
    df = df.withColumn("called", F.lit(True)).join(answers, KEYS, "full_outer")
    called = F.coalesce("called", F.lit(False))
    status = F.when(~called, "orphan_result").when(F.col("n_results").isNull(), "no_result").when(F.col("level").isNull(), "blocked").otherwise("linked")
    df = df.withColumn("__arguments", canonical(F.col("arguments")))
    needs = F.array_sort(F.array_distinct(F.filter("depends_on", lambda d: d.isNotNull())))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce("__arguments", F.lit("null")),
        F.lit(',"depends_on":'), F.coalesce(F.to_json(needs), F.lit("[]")),
        F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), quoted(F.col("content")),
        F.lit("}"),
    )
    return df.select(
        *KEYS,
        status.alias("status"),
        F.col("level").cast("long").alias("level"),
        F.col("place").cast("long").alias("place"),
        F.when(called, valid(F.col("name"), F.col("__arguments"), schemas)).alias("valid"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce(F.col("n_results"), F.lit(0)).cast("long").alias("n_results"),
        F.when(called, line).alias("line"),
    )


#: Tools of the calls that `calls_of` reads out of plain conversations.
CHAT_TOOLS: Schemas = {
    "answer": (("prompt", "turn"), {"prompt": "string", "turn": "integer"}),
    "configure": (("rules",), {"rules": "string"}),
}
#: One call in so many lacks a key, has a wrong type or an unknown key, needs a call that is not there or itself, spells a
#: number otherwise, or is not JSON: the numbers 0 to 6 of 7 * conv_id + turn by this.
VARIETY = 20


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results.

    A user's or system's turn whose text is a JSON object with name and arguments is that call. Each other user turn calls
    `answer`, each system turn `configure`; as such calls would all be sound, a rule (VARIETY) makes some of them unsound in
    each way that validation and ordering know. A call depends on the user's or system's turns one and two before it. The
    assistant's turn after a call is its result; at the least turn that a long can hold it is none's. Turns of other roles are neither; null conversations or turns take no part.
    """
    id_of = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    text, turn = F.col("text"), F.col("turn")
    user = F.col("role") == "user"
    asks = conversations.filter(F.col("role").isin("user", "system") & turn.isNotNull() & F.col("conv_id").isNotNull())
    kind, number = F.pmod(F.pmod("conv_id", F.lit(VARIETY)) * 7 + F.pmod(turn, F.lit(VARIETY)), F.lit(VARIETY)), turn.cast("string")
    member = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    said, mood = quoted(text), F.lit('"mood":true')
    answer = (
        F.when(kind == 0, member("prompt", said))
        .when(kind == 1, F.concat_ws(",", member("turn", quoted(number)), member("prompt", said)))
        .when(kind == 2, F.concat_ws(",", member("turn", number), member("prompt", said), mood))
        .when(kind == 5, F.concat_ws(",", member("turn", F.concat(number, F.lit(".0"))), member("prompt", said)))
        .otherwise(F.concat_ws(",", member("turn", number), member("prompt", said)))
    )
    configure = F.when(kind == 0, "").when(kind == 1, member("rules", number)).when(kind == 2, F.concat_ws(",", member("rules", said), mood)).otherwise(member("rules", said))
    made = F.when(kind == 6, F.concat(F.lit("not JSON: "), F.coalesce(text, F.lit("")))).otherwise(F.concat(F.lit("{"), F.when(user, answer).otherwise(configure), F.lit("}")))
    told = F.try_parse_json(text)
    name, arguments = F.try_variant_get(told, "$.name", "string"), F.to_json(F.try_variant_get(told, "$.arguments", "variant"))
    rows = asks.select("conv_id", id_of(turn).alias("call_id"), turn.alias("position"), kind.alias("kind"), user.alias("user"), made.alias("made"), name.alias("told"), arguments.alias("told_arguments"))
    is_told = F.col("told").isNotNull() & F.col("told_arguments").isNotNull()
    rows = rows.select(
        "conv_id", "call_id", "position", "kind", is_told.alias("is_told"),
        F.when(is_told, F.col("told")).otherwise(F.when(F.col("user"), "answer").otherwise("configure")).alias("name"),
        F.when(is_told, F.col("told_arguments")).otherwise(F.col("made")).alias("arguments"),
    )
    # Which of the two turns are calls is known from the table alone: a join with the distinct turns of calls.
    turns = asks.select("conv_id", turn.alias("__turn")).distinct()
    before = rows.select("conv_id", "call_id", "position").distinct().select("*", F.explode(F.array(F.try_subtract("position", F.lit(1)), F.try_subtract("position", F.lit(2)))).alias("__turn"))
    needs = before.join(turns, ["conv_id", "__turn"]).groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(id_of(F.col("__turn")))).alias("depends_on"))
    more = F.when(F.col("is_told"), F.array().cast("array<string>")).when(F.col("kind") == 3, F.array(F.lit("call_missing"))).when(F.col("kind") == 4, F.array("call_id")).otherwise(F.array().cast("array<string>"))
    calls = rows.join(needs, ["conv_id", "call_id"], "left").withColumn("depends_on", F.concat(F.coalesce("depends_on", F.array().cast("array<string>")), more))
    results = conversations.filter((F.col("role") == "assistant") & turn.isNotNull()).select("conv_id", id_of(F.try_subtract(turn, F.lit(1))).alias("call_id"), turn.alias("position"), text.alias("content"))
    return calls, results


def chat_calls(conversations: DataFrame) -> DataFrame:
    """The linked calls of `calls_of`; turns of other roles (or none) are rows of status not_a_call, so that no turn is lost."""
    linked = link_tool_calls(*calls_of(conversations), CHAT_TOOLS)
    others = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND coalesce(role NOT IN ('user', 'system', 'assistant'), true)")
    others = others.groupBy("conv_id", F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("call_id")).agg(F.count(F.lit(1)).alias("n_copies"))
    others = others.withColumn("status", F.lit("not_a_call")).withColumn("n_results", F.lit(0).cast("long"))
    return linked.unionByName(others, allowMissingColumns=True)
