"""Payload contracts: JSON Schema as expressions, citations of memos, verdicts; and a deterministic embedding."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def inline(schema, root=None):
    """A schema with its local ``$ref`` replaced by what they point to."""
    root = schema if root is None else root
    if isinstance(schema, list):
        return [inline(x, root) for x in schema]
    if not isinstance(schema, dict):
        return schema
    if "$ref" in schema:
        at = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        return inline({**at, **{k: v for k, v in schema.items() if k != "$ref"}}, root)
    return {k: inline(v, root) for k, v in schema.items() if k not in ("$defs", "definitions")}


#: What ``schema_of_variant`` says of values of each JSON Schema type.
_KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")}


def _none() -> Column:
    return F.array().cast("array<string>")


def _starts(kind: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | kind.startswith(n)
    return out


def _has_type(v: Column, kind: Column, name: str) -> Column:
    if name == "integer":
        x = F.try_variant_get(v, "$", "double")
        return _starts(kind, _KINDS["number"]) & (x % 1 == 0)
    return _starts(kind, _KINDS[name])


def _equals(v: Column, kind: Column, value) -> Column:
    """Whether a variant is a JSON value: numbers by value, a boolean is no number."""
    if value is None:
        return _starts(kind, _KINDS["null"])
    if isinstance(value, bool):
        return _starts(kind, _KINDS["boolean"]) & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return _starts(kind, _KINDS["number"]) & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return _starts(kind, _KINDS["string"]) & (F.try_variant_get(v, "$", "string") == value)
    return F.to_json(v) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _said(at: Column, wrong: Column, what: str) -> Column:
    """An array with the message where ``wrong`` holds."""
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(at, F.lit(f": {what}")))).otherwise(_none())


def compiled(schema: dict | bool, v: Column, at: Column) -> Column:
    """The errors of a variant against a schema without references, as one array expression."""
    if schema is True or schema == {}:
        return _none()
    if schema is False:
        return _said(at, F.lit(True), "nothing is allowed")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    found: list[Column] = []
    if "const" in schema:
        found.append(_said(at, ~_equals(v, kind, schema["const"]), f"not {schema['const']!r}"))
    if "enum" in schema:
        listed = F.lit(False)
        for x in schema["enum"]:
            listed = listed | _equals(v, kind, x)
        found.append(_said(at, ~listed, f"not one of {schema['enum']}"))
    number = F.when(_starts(kind, _KINDS["number"]), F.try_variant_get(v, "$", "double"))
    for word, bad in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x), ("multipleOf", lambda x: number % x != 0)):
        if word in schema:
            found.append(_said(at, bad(float(schema[word])), f"{word} {schema[word]}"))
    string = F.when(_starts(kind, _KINDS["string"]), F.try_variant_get(v, "$", "string"))
    if "minLength" in schema or "maxLength" in schema:
        found.append(_said(at, (F.length(string) < schema.get("minLength", 0)) | (F.length(string) > schema.get("maxLength", 2**31 - 1)), "length"))
    if "pattern" in schema:
        found.append(_said(at, ~string.rlike(schema["pattern"]), "pattern"))
    items = F.when(_starts(kind, _KINDS["array"]), F.try_variant_get(v, "$", "array<variant>"))
    if "minItems" in schema or "maxItems" in schema:
        found.append(_said(at, (F.size(items) < schema.get("minItems", 0)) | (F.size(items) > schema.get("maxItems", 2**31 - 1)), "number of items"))
    if "items" in schema:
        found.append(F.coalesce(F.flatten(F.transform(items, lambda x, i: compiled(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))), _none()))
    if any(w in schema for w in ("required", "properties", "patternProperties", "additionalProperties")):
        known, by_pattern, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        fields = F.when(_starts(kind, _KINDS["object"]), F.try_variant_get(v, "$", "map<string,variant>"))
        for k in schema.get("required", ()):
            found.append(_said(at, ~F.map_contains_key(fields, k), f"{k} is missing"))
        for k, sub in known.items():
            found.append(F.when(F.coalesce(F.map_contains_key(fields, k), F.lit(False)), compiled(sub, F.element_at(fields, k), F.concat(at, F.lit(f".{k}")))).otherwise(_none()))
        entries = F.map_entries(fields)
        below = lambda e: F.concat(at, F.lit("."), e["key"])
        for pattern, sub in by_pattern.items():
            found.append(F.coalesce(F.flatten(F.transform(F.filter(entries, lambda e: e["key"].rlike(pattern)), lambda e: compiled(sub, e["value"], below(e)))), _none()))  # noqa: B023

        def further(e: Column) -> Column:
            out = ~e["key"].isin(*known) if known else F.lit(True)
            for pattern in by_pattern:
                out = out & ~e["key"].rlike(pattern)
            return out

        if rest is False:
            found.append(F.coalesce(F.transform(F.filter(entries, further), lambda e: F.concat(at, F.lit(": "), e["key"], F.lit(" is not known"))), _none()))
        elif isinstance(rest, dict) and rest:
            found.append(F.coalesce(F.flatten(F.transform(F.filter(entries, further), lambda e: compiled(rest, e["value"], below(e)))), _none()))
    for sub in schema.get("allOf", ()):
        found.append(compiled(sub, v, at))
    holds = lambda subs: sum((F.when(F.size(compiled(s, v, at)) == 0, 1).otherwise(0) for s in subs), F.lit(0))
    if "anyOf" in schema:
        found.append(_said(at, holds(schema["anyOf"]) == 0, "holds for none of anyOf"))
    if "oneOf" in schema:
        found.append(_said(at, holds(schema["oneOf"]) != 1, "does not hold for one of oneOf"))
    if "not" in schema:
        found.append(_said(at, F.size(compiled(schema["not"], v, at)) == 0, "holds for what it must not"))
    out = F.concat(*found) if found else _none()
    kinds = schema.get("type")
    if kinds is None:
        return out
    right = F.lit(False)
    for k in [kinds] if isinstance(kinds, str) else kinds:
        right = right | _has_type(v, kind, k)
    return F.when(F.coalesce(right, F.lit(False)), out).otherwise(_said(at, F.lit(True), f"not of type {kinds}"))


def payload_errors(payload: Column, schema: dict) -> Column:
    """Errors of a JSON text against a schema, as a sorted array; empty when it holds, null for null. The schema is compiled to
    one expression over a variant: types, constants, enums, bounds, lengths, patterns, items, required, known, pattern
    and further properties, all, any, one and none of several schemas, local references."""
    v = F.try_parse_json(payload)
    found = F.array_sort(compiled(inline(schema), v, F.lit("$")))
    return F.when(payload.isNotNull(), F.when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(found))


def uncited(memo: Column) -> Column:
    """Bullets of a memo (a variant with sections of bullets) that neither cite a source nor name the gap they stand for."""
    bullets = F.try_variant_get(memo, "$.sections", "array<struct<title:string,bullets:array<struct<text:string,citations:array<string>,gap:string>>>>")
    flat = F.flatten(F.transform(bullets, lambda s: F.coalesce(s["bullets"], F.array().cast("array<struct<text:string,citations:array<string>,gap:string>>"))))
    bad = F.filter(flat, lambda b: (F.size(F.coalesce(b["citations"], F.array().cast("array<string>"))) == 0) & (F.coalesce(b["gap"], F.lit("")) == ""))
    return F.transform(bad, lambda b: b["text"])


def verdict(answer: Column, fallback: float = 0.6) -> Column:
    """(score, rationale, confidence, evidence) of an answer in JSON; evidence needs a claim and a source; a missing
    confidence is the fallback, or 0.3 without a score."""
    kind = "struct<score:double,rationale:string,confidence:double,evidence:array<struct<claim:string,source_url:string>>>"
    v = F.from_json(answer, kind)
    kept = F.filter(F.coalesce(v["evidence"], F.array().cast("array<struct<claim:string,source_url:string>>")), lambda e: e["claim"].isNotNull() & e["source_url"].isNotNull())
    sure = F.coalesce(v["confidence"], F.when(v["score"].isNotNull(), fallback).otherwise(0.3))
    return F.struct(v["score"].alias("score"), v["rationale"].alias("rationale"), sure.alias("confidence"), kept.alias("evidence"))


def hashed_vector(text: str, size: int) -> list[float]:
    """Unit vector of a text: the sum of a vector for each token, made of its digests."""
    total = np.zeros(size)
    for token in text.lower().split():
        raw = b"".join(hashlib.sha256(f"{token}:{i}".encode()).digest() for i in range(-(-size // 32)))
        total += np.frombuffer(raw[:size], np.uint8) / 127.5 - 1
    n = np.linalg.norm(total)
    return (total / n if n else total).tolist()


def hashed_embedding(c: Column, size: int = 1024) -> Column:
    """A stand-in for a model: the same text gives the same unit vector everywhere."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashed_vector(t, size))

    return embed(c)
