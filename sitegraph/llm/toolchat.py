"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import saved, table

#: the columns ``link_tools`` reads
CALLS = "conv_id BIGINT, turn BIGINT, call_id STRING, name STRING, arguments STRING, after ARRAY<STRING>"
RESULTS = "conv_id BIGINT, turn BIGINT, call_id STRING, content STRING"

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def faults(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks the schema: type, enum, bounds, properties, required, items."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the choices")
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: shorter than {schema['minLength']}")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += faults(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                out += faults(value[k], known[k], f"{at}.{k}")
    return out


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None) -> tuple[Any, str | None]:
    """The value of a JSON text, or why it has none; numbers JSON does not know and repeated keys are refused."""
    def once(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("a key twice")
        return out

    def refuse(name: str) -> None:
        raise ValueError(name)

    if text is None:
        return None, "$: no arguments"
    try:
        value = json.loads(text, object_pairs_hook=once, parse_constant=refuse)
        canonical(value).encode()
        return value, None
    except (ValueError, RecursionError):
        return None, "$: not JSON"


def order_calls(calls: DataFrame) -> DataFrame:
    """Adds ``level``: calls that wait for none are 0, others one above the highest they wait for.

    Calls that wait for one other are chains: every round doubles how far each
    looks back, so a chain takes as many rounds as the logarithm of its length.
    What is left are calls that wait for several; a round settles those whose
    awaited ones are settled. Calls on a circle, and those that wait for them, get
    null. Ids that are no call of the conversation are not waited for.
    """
    key = ["conv_id", "call_id"]
    waits = calls.select(*key, F.explode(F.array_distinct("after")).alias("on"))
    waits = waits.join(calls.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi")
    waits = saved(waits.join(waits.groupBy(*key).agg(F.count("*").alias("n")), key), "waits")
    back = saved(waits.filter("n = 1").select(*key, "on", F.lit(1).cast("bigint").alias("far")), "back")
    size, seen = back.count(), 1
    while True:
        above = back.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("next"), F.col("far").alias("more"))
        met = back.join(above, ["conv_id", "on"], "left")
        open_ = met.filter("next IS NOT NULL").count()
        if not open_ or seen > size:
            break
        back = saved(met.select(*key, F.coalesce("next", "on").alias("on"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "back")
        seen *= 2
    if open_:
        # looking back further than there are calls: a circle
        back = met.filter("next IS NULL").select(*key, "on", "far")
    # level of a call: that of where its chain begins, and the way from there
    every = saved(calls.select(*key).join(waits.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("bigint")), "level")

    def behind(heads: DataFrame) -> DataFrame:
        return back.join(heads.select("conv_id", F.col("call_id").alias("on"), "level"), ["conv_id", "on"]).select(
            *key, (F.col("level") + F.col("far")).alias("level"))

    every = saved(every.unionByName(behind(every)), "level")
    several = waits.filter("n > 1").select(*key, "on")
    while several.head() is not None:
        met = several.join(every.select("conv_id", F.col("call_id").alias("on"), F.col("level").alias("l")), ["conv_id", "on"], "left")
        ready = met.groupBy(*key).agg((F.max("l") + 1).alias("level"), F.count_if(F.col("l").isNull()).alias("open")).filter("open = 0")
        fresh = saved(ready.select(*key, "level"), "level")
        if fresh.head() is None:
            break
        several = saved(several.join(fresh.select(*key), key, "left_anti"), "several")
        every = saved(every.unionByName(fresh).unionByName(behind(fresh)), "level")
    return calls.join(every.withColumn("level", F.col("level").cast("int")), key, "left")


def link_tools(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every call with its result, and every result without one, as a line of canonical JSON.

    ``calls(conv_id, turn, call_id, name, arguments, after)``: ``arguments`` is JSON
    text, ``after`` names calls to wait for. ``results(conv_id, turn, call_id,
    content)``. Returns ``conv_id, level, turn, call_id, state, errors, json``; a
    conversation's lines in the order of level, turn and call_id are a
    topological order.

    Calls and results meet in a hash join on conversation and id. Of several
    calls of an id the first by turn counts (then by name and arguments), of
    several results the first by turn (then by content); the others are
    ``repeated`` and keep their line. A call without result is ``open``, a result
    without call ``orphan``, a call on a circle ``circular`` and without level; the
    rest are ``linked``. ``errors`` lists what is wrong with the arguments: not JSON,
    an unknown tool, or breaches of the tool's schema.

    Rows without conversation or id link with nothing: ``open`` or ``orphan``. Null
    arguments are an error, null content is null in the JSON, null turns come
    first. Equal rows are repeats of each other. Empty tables give no rows. Other
    columns are not looked at.
    """
    key = ["conv_id", "call_id"]
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("after", F.array()).alias("after"))
    r = results.select("conv_id", "turn", "call_id", "content")
    named = lambda df: df.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    nameless = lambda df: df.filter("conv_id IS NULL OR call_id IS NULL")

    def first(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
        """One row per id, the first, and the others: a map-side aggregate, then copies."""
        packed = named(df).groupBy(*key, *order).agg(F.count("*").alias("n"))
        own = packed.groupBy(*key).agg(F.min(F.struct(*order)).alias("x"))
        rest = packed.join(own, key).withColumn("left", F.col("n") - F.when(F.struct(*order).eqNullSafe(F.col("x")), 1).otherwise(0))
        rest = rest.filter("left > 0").withColumn("copy", F.explode(F.expr("sequence(1L, left)")))
        return own.select(*key, "x.*"), rest.select(*key, *order)

    one, more = first(c, "turn", "name", "arguments", "after")
    answer, late = first(r, "turn", "content")
    one = saved(order_calls(saved(one, "calls")), "ordered")
    both = one.join(answer.select(*key, F.col("turn").alias("answered"), "content", F.lit(True).alias("met")), key, "full")
    state = (F.when(F.col("name").isNull() & F.col("level").isNull() & F.col("after").isNull(), "orphan")
             .when(F.col("level").isNull(), "circular").when(F.col("met").isNull(), "open").otherwise("linked"))
    lines = both.withColumn("state", state)

    def plain(df: DataFrame, label: str) -> DataFrame:
        call = "name" in df.columns
        return df.select(
            "conv_id", "call_id", F.col("turn") if call else F.lit(None).cast("bigint").alias("turn"),
            *([F.col(x) for x in ("name", "arguments", "after")] if call else
              [F.lit(None).cast(t).alias(x) for x, t in (("name", "string"), ("arguments", "string"), ("after", "array<string>"))]),
            F.lit(None).cast("int").alias("level"),
            F.lit(None).cast("bigint").alias("answered") if call else F.col("turn").alias("answered"),
            F.lit(None).cast("string").alias("content") if call else F.col("content"), F.lit(label).alias("state"))

    lines = lines.drop("met").unionByName(plain(more, "repeated")).unionByName(plain(late, "repeated"))
    lines = lines.unionByName(plain(nameless(c), "open")).unionByName(plain(nameless(r), "orphan"))

    @F.pandas_udf("errors ARRAY<STRING>, json STRING")
    def written(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, call_id, turn, name, arguments, after, level, answered, content, state in rows.itertuples(index=False, name=None):
            whole = lambda x: None if pd.isna(x) else int(x)
            line: dict[str, Any] = {"conversation": whole(conv), "id": call_id, "state": state}
            wrong: list[str] = []
            if after is not None:
                value, fault = parsed(arguments)
                wrong = [fault] if fault else ["$: unknown tool"] if name not in schemas else faults(value, schemas[name])
                line["call"] = {"name": name, "arguments": arguments if fault else value, "turn": whole(turn),
                                "level": whole(level), "after": sorted(set(x for x in after if x is not None))}
                line["errors"] = wrong
            if answered is not None and not pd.isna(answered) or content is not None:
                line["result"] = {"content": content, "turn": whole(answered)}
            out.append((wrong, canonical(line)))
        return pd.DataFrame(out, columns=["errors", "json"])

    fields = ["conv_id", "call_id", "turn", "name", "arguments", "after", "level", "answered", "content", "state"]
    lines = lines.withColumn("w", written(F.struct(*fields)))
    return lines.select("conv_id", "level", F.coalesce("turn", "answered").alias("turn"), "call_id", "state", "w.errors", "w.json")


#: the tools that ``as_tools`` reads conversations as
SCHEMAS = {
    "ask": {"type": "object", "required": ["question", "words"], "additionalProperties": False, "properties": {
        "question": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 60},
        "after": {"type": "array", "items": {"type": "string"}}}},
    "search": {"type": "object", "required": ["query"], "properties": {
        "query": {"type": "string"}, "lang": {"enum": ["en", "de", "fr", "es"]}, "after": {"type": "array", "items": {"type": "string"}}}},
}


def as_tools(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations read as tool use: a user turn is a call, the assistant's next turn its result.

    The tool and its arguments follow from the text; every turn waits for the user
    turn before it. ``messages(conv_id, turn, role, text)``.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    ask = F.coalesce(F.length("text") % 3 > 0, F.lit(True))
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    after = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    arguments = F.when(ask, F.to_json(F.struct(F.col("text").alias("question"), words.alias("words"), after.alias("after")))).otherwise(
        F.to_json(F.struct(F.col("text").alias("query"), F.substring(F.lower("text"), 1, 2).alias("lang"), after.alias("after"))))
    calls = m.filter("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(ask, "ask").otherwise("search").alias("name"),
        arguments.alias("arguments"), after.alias("after"))
    results = m.filter("role = 'assistant'").select(
        "conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def message_lines(messages: DataFrame) -> DataFrame:
    """The turns that are neither call nor result (other roles, or none) as lines of ``link_tools``:
    state ``message``, without level and call, in canonical JSON (keys in order, no blanks)."""
    others = messages.filter("role IS NULL OR role NOT IN ('user', 'assistant')")
    line = F.to_json(F.struct(F.col("conv_id").alias("conversation"), F.struct("role", "text", "turn").alias("message"), F.lit("message").alias("state")), {"ignoreNullFields": "false"})
    return others.select("conv_id", F.lit(None).cast("int").alias("level"), "turn", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("state"),
                         F.array().cast("array<string>").alias("errors"), line.alias("json"))


def op9_tool_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, read as tool use; turns of other roles as messages."""
    messages = table(spark, sf, "conversations")
    return link_tools(*as_tools(messages), SCHEMAS).unionByName(message_lines(messages))
