"""Compiled schemas against a plain validator, on generated payloads."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import documents

SCHEMA = {
    "$defs": {"text": {"type": "string", "minLength": 1, "maxLength": 4}, "link": {"type": "object", "required": ["url"], "properties": {"url": {"$ref": "#/$defs/text"}, "rank": {"type": ["integer", "null"], "minimum": 0}}, "additionalProperties": False}},
    "type": "object", "required": ["name", "kind"],
    "properties": {
        "name": {"$ref": "#/$defs/text"}, "kind": {"enum": ["a", 1, None, True, [1, 2]]}, "score": {"type": "number", "exclusiveMinimum": 0, "maximum": 10}, "fixed": {"const": 3},
        "links": {"type": "array", "items": {"$ref": "#/$defs/link"}, "minItems": 1, "maxItems": 3}, "code": {"type": "string", "pattern": "^[a-c]+$"}, "either": {"anyOf": [{"type": "string"}, {"type": "number", "minimum": 5}]},
        "one": {"oneOf": [{"type": "number", "multipleOf": 2}, {"type": "number", "multipleOf": 3}]}, "never": {"not": {"type": "boolean"}}, "all": {"allOf": [{"type": "array"}, {"maxItems": 1}]},
    },
    "patternProperties": {"^x_": {"type": "integer"}}, "additionalProperties": {"type": "boolean"},
}


def is_of(value, kind):
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}[kind])


def same(a, b):
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def plain(value, schema, at="$"):
    kinds = schema.get("type")
    if kinds is not None and not any(is_of(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    out = []
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: not {schema['const']!r}")
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not one of {schema['enum']}")
    if is_of(value, "number"):
        wrong = {"minimum": lambda x: value < x, "maximum": lambda x: value > x, "exclusiveMinimum": lambda x: value <= x, "exclusiveMaximum": lambda x: value >= x, "multipleOf": lambda x: value % x != 0}
        out += [f"{at}: {w} {schema[w]}" for w, f in wrong.items() if w in schema and f(schema[w])]
    if isinstance(value, str):
        out += [f"{at}: length"] * (not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 10**9))
        out += [f"{at}: pattern"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if isinstance(value, list):
        out += [f"{at}: number of items"] * (not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", 10**9))
        for i, x in enumerate(value):
            out += plain(x, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        out += [f"{at}: {k} is missing" for k in schema.get("required", ()) if k not in value]
        for k, x in value.items():
            subs = [schema["properties"][k]] if k in schema.get("properties", {}) else []
            subs += [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            rest = schema.get("additionalProperties", True)
            if not subs and rest is False:
                out.append(f"{at}: {k} is not known")
            for s in subs or ([rest] if isinstance(rest, dict) else []):
                out += plain(x, s, f"{at}.{k}")
    for s in schema.get("allOf", ()):
        out += plain(value, s, at)
    holds = lambda word: sum(not plain(value, s, at) for s in schema[word])
    out += [f"{at}: holds for none of anyOf"] * ("anyOf" in schema and not holds("anyOf"))
    out += [f"{at}: does not hold for one of oneOf"] * ("oneOf" in schema and holds("oneOf") != 1)
    out += [f"{at}: holds for what it must not"] * ("not" in schema and not plain(value, schema["not"], at))
    return out


def value(rng, depth=0):
    simple = [None, True, False, 0, 1, 2, 3, 6, 12, -1, 2.5, 3.0, "", "a", "abc", "abcd", "abcde", "é日"]
    if depth < 2 and rng.random() < 0.25:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if depth < 2 and rng.random() < 0.2:
        return {rng.choice(["url", "rank", "b", "x_1"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return rng.choice(simple)


def payload(rng):
    names = [*SCHEMA["properties"], "x_a", "x_b", "more"]
    out = {k: value(rng) for k in rng.sample(names, rng.randrange(len(names)))}
    if rng.random() < 0.6:
        out |= {"name": "ab", "kind": rng.choice(["a", 1, True, [1, 2], None])}
    if rng.random() < 0.4:
        out["links"] = [{"url": "u", "rank": rng.choice([1, None, -1, 2.0, "x"])} for _ in range(rng.randrange(5))]
    return out if rng.random() < 0.95 else value(rng)


def test_equals_a_plain_validator(spark):
    rng = random.Random(8)
    texts = [json.dumps(payload(rng), ensure_ascii=False) for _ in range(600)]
    whole = documents.inline(SCHEMA)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(600, "{broken"), (601, None), (602, "")], "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", documents.payload_errors(F.col("t"), SCHEMA).alias("e")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sorted(plain(json.loads(t), whole)), t
    assert got[600] == ["$: not JSON"] and got[601] is None and got[602] == ["$: not JSON"]
    assert sum(not e for e in list(got.values())[:600]) > 3


def test_no_python_worker(spark):
    plan = spark.createDataFrame([("{}",)], "t string").select(documents.payload_errors(F.col("t"), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("schema,text,want", [(True, "1", []), ({}, "{}", []), ({"properties": {"a": False}}, '{"a": 1}', ["$.a: nothing is allowed"]), ({"type": "integer"}, "12345678901234567890", []), ({"type": "object"}, "[]", ["$: not of type object"])])
def test_small_schemas(spark, schema, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(documents.payload_errors(F.col("t"), schema).alias("e")).first()["e"] == want
