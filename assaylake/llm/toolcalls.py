"""Tool-call linking: calls and results joined by identifier, put in topological order, validated and written as canonical JSON.

Calls: (conv_id, call_id, turn, name, arguments, after): arguments as JSON text, after the identifiers of calls whose results
a call needs. Results: (conv_id, call_id, turn, content). All joins are hash joins on (conv_id, identifier); no conversation is
gathered in one place, so one of any length will do.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Decimal
from itertools import count
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.shared import cut, written

#: Turns of a conversation that are numbered together.
SPAN = 256
#: Rounds of levels() between looks at what is open, and the needs that the driver settles.
EARLY, FEW = 3, 100_000
_KINDS = {"string": str, "integer": (int, float), "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: The words of JSON Schema that are checked, and those that say nothing about a value.
_CHECKED = {"type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "items", "minItems", "maxItems", "uniqueItems", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "anyOf", "oneOf", "allOf", "not"}
_SILENT = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$comment", "$schema", "$id"}


def understood(schema: Any) -> None:
    """Raises ValueError where a schema has a word that valid() does not check, or a type or pattern that is none."""
    if isinstance(schema, bool):
        return
    if unknown := set(schema) - _CHECKED - _SILENT:
        raise ValueError(f"words of a schema that are not checked: {sorted(unknown)}")
    kinds = schema.get("type", [])
    if wrong := set(kinds if isinstance(kinds, list) else [kinds]) - set(_KINDS):
        raise ValueError(f"no types of JSON: {sorted(wrong)}")
    re.compile(schema.get("pattern", ""))
    below = [*schema.get("properties", {}).values(), *schema.get("anyOf", ()), *schema.get("oneOf", ()), *schema.get("allOf", ())]
    for part in [*below, *(schema[word] for word in ("items", "additionalProperties", "not") if word in schema)]:
        understood(part)


def _is(value: Any, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    return isinstance(value, _KINDS[kind]) and not (kind == "integer" and isinstance(value, float) and not value.is_integer())


def same(a: Any, b: Any) -> bool:
    """Equality of JSON values: numbers by value, true and 1 differ, objects whatever the order of their keys."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def _number(value: float, schema: dict) -> bool:
    low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
    step = schema.get("multipleOf")
    return (
        schema.get("minimum", value) <= value <= schema.get("maximum", value)
        and (low is None or value > low)
        and (high is None or value < high)
        and (step is None or Decimal(str(value)) % Decimal(str(step)) == 0)
    )


def valid(value: Any, schema: dict | bool) -> bool:
    """True if value fits the schema, which holds words of JSON Schema that understood() lets pass. 1.0 is an integer; true is no number."""
    if isinstance(schema, bool):
        return schema
    kind = schema.get("type")
    if kind is not None and not any(_is(value, k) for k in (kind if isinstance(kind, list) else [kind])):
        return False
    if "enum" in schema and not any(same(value, v) for v in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        return False
    if "anyOf" in schema and not any(valid(value, s) for s in schema["anyOf"]) or "oneOf" in schema and sum(valid(value, s) for s in schema["oneOf"]) != 1:
        return False
    if not all(valid(value, s) for s in schema.get("allOf", ())) or "not" in schema and valid(value, schema["not"]):
        return False
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) and re.search(schema.get("pattern", ""), value) is not None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value, schema)
    if isinstance(value, list):
        if schema.get("uniqueItems") and any(same(v, w) for i, v in enumerate(value) for w in value[:i]):
            return False
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(valid(v, schema.get("items", True)) for v in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return False
        return all(valid(v, known.get(k, schema.get("additionalProperties", True))) for k, v in value.items())
    return True


def _plain(value: Any) -> Any:
    """value with whole numbers written as such (1.0 as 1, up to 2^53)."""
    if isinstance(value, float) and value.is_integer() and abs(value) <= 1 << 53:
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def canonical(value: Any) -> str:
    """JSON without white space, keys in order of code points, whole numbers without a fraction, other characters than quotes, backslashes and controls as they are."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None) -> tuple[Any, bool]:
    """(value, True) of a JSON text, (None, False) where it is none: bad syntax, no finite number, half a surrogate pair, or nested or long beyond Python's limits."""
    try:
        value = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        canonical(value).encode()
        return value, True
    except (TypeError, ValueError, RecursionError, OverflowError):
        return None, False


def _settled(needs: list) -> list[tuple]:
    """(conv_id, call_id, level) of the calls in needs (conv_id, call_id, need, level of the need where it is settled), without cycles."""
    missing, level, waits = Counter(), {}, defaultdict(list)
    for conv, call, need, below in needs:
        if below is None:
            missing[conv, call] += 1
            waits[conv, need].append((conv, call))
        level[conv, call] = max(level.get((conv, call), 0), 2 + (below or 0))
    ready, out = [c for c in level if not missing[c]], []
    while ready:
        call = ready.pop()
        out.append((*call, level[call]))
        for above in waits[call]:
            level[above] = max(level[above], level[call] + 2)
            missing[above] -= 1
            if not missing[above]:
                ready.append(above)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for a call that needs none, else 2 + the highest level of those it needs; null on a cycle.

    A result's level is its call's plus 1, so that level order is a topological order. Identifiers that no call has do not count. Each round takes
    the needs of calls just settled away, which settles those calls that have none left, all at the round's level. What is open after
    EARLY rounds is settled in one go once it is small; without new calls in a round, what is open is on a cycle or behind one.
    """
    key = ["conv_id", "call_id"]
    known = calls.where("conv_id is not null and call_id is not null").select(*key).distinct()
    needs = calls.select(*key, F.explode("after").alias("need")).where("need is not null").distinct()
    open_ = cut(needs.join(known.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi"))
    new = cut(known.join(open_.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0)))
    settled = new
    for turn in count(1):
        just = new.withColumnsRenamed({"call_id": "need", "level": "below"})
        if turn % EARLY == 0:
            settled = cut(settled)
            if open_.limit(FEW + 1).count() <= FEW:
                left = open_.join(just, ["conv_id", "need"], "left").select(*key, "need", "below").collect()  # FEW rows at most
                settled = settled.unionByName(settled.sparkSession.createDataFrame(_settled(left), settled.schema))
                break
        rest = cut(open_.join(just, ["conv_id", "need"], "left_anti"))
        new = cut(open_.select(*key).distinct().join(rest.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(2 * turn)))
        if new.limit(1).count() == 0:
            break
        settled, open_ = settled.unionByName(new), rest
    return known.join(settled, key, "left")


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, name, status, valid, level, position, json) for each call, and each result without a call.

    status: linked, open (no result) or orphan (a result alone; its name, valid and level are null). An identifier that
    comes several times in a conversation links its n-th call with its n-th result, by turn; a null conv_id or identifier links with
    nothing. valid: the arguments are JSON and fit the schema of the tool (a tool without a schema: false). level: see levels();
    null on a cycle. position: from 1 within the conversation, by level, then turn, cycles and orphans last. json: the canonical JSON of
    arguments, call_id, content, name, status and valid; arguments that are no JSON (see parsed()) are null. Other columns are not read. Repeated
    rows are calls, or results, of their own; empty tables give an empty one. A schema with words that are not checked is an error.
    """
    for schema in schemas.values():
        understood(schema)
    nth = Window.partitionBy("conv_id", "call_id").orderBy("turn", "__text")
    calls = calls.select("conv_id", "call_id", "turn", "name", F.col("arguments").alias("__text"), "after")
    placed = levels(calls)
    calls = calls.withColumn("nth", F.row_number().over(nth)).withColumnRenamed("__text", "arguments").drop("after")
    results = results.select("conv_id", "call_id", "turn", F.col("content").alias("__text")).withColumn("nth", F.row_number().over(nth)).withColumnRenamed("__text", "content")
    results = results.withColumn("there", F.lit(True)).withColumnRenamed("turn", "result_turn")
    both = calls.withColumn("asked", F.lit(True)).join(results, ["conv_id", "call_id", "nth"], "full_outer").join(placed, ["conv_id", "call_id"], "left")
    status = F.when(F.col("asked").isNull(), "orphan").when(F.col("there").isNull(), "open").otherwise("linked")
    level = F.when(F.col("asked").isNotNull(), F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), F.lit(0)).otherwise(F.col("level")))
    both = both.withColumn("status", status).withColumn("level", level).withColumn("turn", F.coalesce("turn", "result_turn"))
    told = json.dumps(schemas)

    def serialised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = json.loads(told)
        for batch in batches:
            good, text = [], []
            for call_id, name, arguments, content, status in zip(batch["call_id"], batch["name"], batch["arguments"], batch["content"], batch["status"], strict=True):
                value, fine = parsed(arguments)
                fine = None if status == "orphan" else bool(fine and name in rules and valid(value, rules[name]))
                good.append(fine)
                text.append(canonical({"arguments": value, "call_id": call_id, "content": content, "name": name, "status": status, "valid": fine}))
            yield batch[["conv_id", "call_id", "turn", "name", "status", "level"]].assign(valid=pd.array(good, "boolean"), json=text)

    told_rows = both.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", "content", "status", F.col("level").cast("double").alias("level"))
    rows = written(told_rows.mapInPandas(serialised, "conv_id long, call_id string, turn long, name string, status string, level double, valid boolean, json string"), "tool-calls")
    # Position: a running count over spans of turns, then within a span, so that no conversation is one task.
    span = rows.withColumn("level", F.col("level").cast("int")).withColumns({"__last": F.coalesce("level", F.lit(1 << 30)), "__span": F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-1))})
    spans = span.groupBy("conv_id", "__last", "__span").agg(F.count("*").alias("n"))
    before = spans.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("__last", "__span")) - F.col("n")).drop("n").withColumnsRenamed({"conv_id": "c", "__last": "l", "__span": "s"})
    inside = F.row_number().over(Window.partitionBy("conv_id", "__last", "__span").orderBy("turn", "status", "json"))
    joined = span.withColumn("inside", inside).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("__last") == F.col("l")) & (F.col("__span") == F.col("s")))
    return joined.select("conv_id", "call_id", "name", "status", "valid", "level", (F.col("before") + F.col("inside")).alias("position"), "json")


#: The tools that turns of a plain conversation stand for, with the schemas of their arguments.
TURN_SCHEMAS = {
    "configure": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}}},
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}}},
}
#: Turns in a row in which a call may need the one before it.
STRETCH = 64


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain conversation (conv_id, turn, role, text).

    A system turn calls configure and a user turn calls ask, with its text and turn as arguments. A call needs those of turn 0 and of two turns
    before, the latter within a stretch of STRETCH turns. As logs of real calls hold faults, some are made here by number: where conv_id mod 16 is 5 the call of turn 2
    needs that of turn 6 too (a cycle, if both are there); where conv_id + turn mod 11 is 4 the arguments lack their end, where it is 7 the turn is a number too
    large for JSON readers, and where it is 9 it is negative. An assistant turn is the result of the turn before it. Other roles, and null ones, are neither.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turn, fault = F.col("turn"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11))
    named = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    asked = rows.where(F.col("role").isin("system", "user"))
    name = F.when(F.col("role") == "system", "configure").otherwise("ask")
    whole = F.to_json(F.struct("text", F.when(fault == 9, -1 - turn).otherwise(turn).alias("turn")), {"ignoreNullFields": "false"})
    arguments = F.when(fault == 4, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(fault == 7, F.regexp_replace(whole, r"-?\d+\}$", "1e999}")).otherwise(whole)
    needs = [F.when(turn > 0, named(F.lit(0))), F.when(F.pmod(turn, F.lit(STRETCH)) >= 2, named(turn - 2)), F.when((turn == 2) & (F.pmod(F.col("conv_id"), F.lit(16)) == 5), named(turn + 4))]
    calls = asked.select("conv_id", named(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(*needs)).alias("after"))
    results = rows.where(F.col("role") == "assistant").select("conv_id", named(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def linked_turns(conversations: DataFrame) -> DataFrame:
    """linked() over the turns of plain conversations, with the faults that turns_as_calls() makes. An empty table gives an empty result; repeated rows are calls of their own."""
    calls, results = turns_as_calls(conversations)
    return linked(calls, results, TURN_SCHEMAS)
