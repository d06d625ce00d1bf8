"""Tool-call linking: schemas, odd JSON, and levels against a walk in plain Python."""

import json
from functools import cache

import pytest
from pyspark.sql import functions as F

pytest.importorskip("assaylake.llm.queries")
from assaylake.llm import toolcalls
from assaylake.llm.toolcalls import canonical, parsed, understood, valid


@pytest.mark.parametrize(
    ("value", "schema", "fits"),
    [
        (1.0, {"type": "integer"}, True), (1.5, {"type": "integer"}, False), (True, {"type": "integer"}, False), (True, {"enum": [1]}, False), (1, {"enum": [1.0]}, True), ([True], {"const": [1]}, False),
        ({"a": 1, "b": [2]}, {"const": {"b": [2.0], "a": 1}}, True), ("abc", {"pattern": "^a.c$"}, True), ("xabc", {"pattern": "^a"}, False), (3, {"oneOf": [{"minimum": 2}, {"maximum": 4}]}, False),
        (5, {"oneOf": [{"minimum": 2}, {"maximum": 4}]}, True), ("x", {"anyOf": [{"type": "null"}, {"maxLength": 1}]}, True), (4, {"allOf": [{"minimum": 4}, {"exclusiveMaximum": 4}]}, False), (4, {"not": {"type": "string"}}, True),
        (0.3, {"multipleOf": 0.1}, True), (0.35, {"multipleOf": 0.1}, False), ([1, 1.0], {"uniqueItems": True}, False), ([1, True], {"uniqueItems": True}, True), ([1, "a"], {"items": {"type": "integer"}}, False),
        ({"a": 1}, {"additionalProperties": {"type": "string"}}, False), ({"a": "x"}, {"additionalProperties": {"type": "string"}}, True), ({"a": 1}, {"properties": {"a": {}}, "additionalProperties": False}, True), ({"b": 1}, {"properties": {"a": {}}, "additionalProperties": False}, False),
        ({}, {"required": ["a"]}, False), ({}, {"minProperties": 1}, False), (None, {"type": ["null", "string"]}, True), (10**30, {"maximum": 1e29}, False), (1, False, False),
    ],
)
def test_schemas(value, schema, fits):
    understood(schema)
    assert valid(value, schema) is fits


@pytest.mark.parametrize("schema", [{"format": "date"}, {"type": "float"}, {"properties": {"a": {"if": {}}}}, {"items": {"$ref": "#"}}])
def test_words_that_are_not_checked_are_refused(schema):
    with pytest.raises(ValueError):
        understood(schema)


@pytest.mark.parametrize("text", [None, "", "{", '{"a":1e999}', '{"a":-1e999}', '{"a":"\\ud800"}', '{"\\udfff":1}', "NaN", "Infinity", "[" * 100_000, "1" * 100_000, '{"a":1}x', "﻿1"])
def test_texts_that_are_no_json(text):
    assert parsed(text) == (None, False)


def test_canonical_json():
    assert canonical(json.loads('{"b":1.0,"a":[1e2,-0.5,"\\u00e9\\n",{"z":null,"y":true}]}')) == '{"a":[100,-0.5,"é\\n",{"y":true,"z":null}],"b":1}'
    assert parsed('{"a":"\\ud83d\\ude00"}') == ({"a": "😀"}, True)


def test_turns_against_a_walk(spark):
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else "user" if t % 2 == 0 else "assistant", f"text {c} {t} long enough") for c in range(24) for t in range(9) if (c * 7 + t) % 10]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(200)] + [(1, 2, "user", "again"), (1, 2, "user", "again"), (None, 3, "user", "t"), (4, None, "user", "t"), (5, 1, None, "t"), (6, 40, "user", None), (7, 41, "user", ""), (8, 43, "user", "y " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit("clash")).withColumn("level", F.lit(1))
    got = toolcalls.linked_turns(df).collect()
    calls = {(c, t) for c, t, role, _ in rows if role in ("system", "user") and c is not None and t is not None}

    def needs(c, t):
        wanted = ({0} if t > 0 else set()) | ({t - 2} if t % 64 >= 2 else set()) | ({6} if t == 2 and c % 16 == 5 else set())
        return [u for u in wanted if (c, u) in calls]

    @cache
    def level(c, t, seen=()):
        if t in seen:
            return None
        below = [level(c, u, (*seen, t)) for u in needs(c, t)]
        return None if None in below else max((b + 2 for b in below), default=0)

    assert len(got) == len([r for r in rows if r[2] in ("system", "user")]) + sum(1 for r in got if r["status"] == "orphan")
    for r in got:
        if r["call_id"] and r["conv_id"] is not None and r["status"] != "orphan":
            t = int(r["call_id"].rsplit("_", 1)[1])
            assert r["level"] == level(r["conv_id"], t)
            fault = (r["conv_id"] + t) % 11
            told = json.loads(r["json"])
            assert (told["arguments"] is None) == (fault in (4, 7)) and (r["valid"] or fault in (4, 7, 9) or r["conv_id"] in (1, 6, 7, 8, 99))
            assert r["json"] == canonical(told)
    assert any(r["level"] is None for r in got if r["status"] != "orphan") and max(r["level"] or 0 for r in got) == 64
    for conv in {r["conv_id"] for r in got}:
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))
        places = {r["call_id"]: n for n, r in enumerate(mine) if r["status"] != "orphan"}
        for r in mine:
            if r["status"] != "orphan" and r["level"] and conv is not None:
                assert all(places[f"call_{conv}_{u}"] < places[r["call_id"]] for u in needs(conv, int(r["call_id"].rsplit("_", 1)[1])))
    assert toolcalls.linked_turns(df.limit(0)).count() == 0
