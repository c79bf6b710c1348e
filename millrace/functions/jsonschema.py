"""JSON Schema compiled to boolean columns over VARIANT, so that validation stays inside Catalyst.

Supported: type (also lists), enum, const; the bounds of texts, numbers, arrays and objects; pattern, multipleOf, uniqueItems; properties,
patternProperties, additionalProperties, propertyNames, required, dependentRequired; items, prefixItems, contains; allOf, anyOf, oneOf, not,
if/then/else; $ref to places within the schema ($defs or definitions), unrolled DEPTH times where they refer to themselves. Keywords that
JSON Schema doesn't know say nothing, as it wants; a schema that breaks its rules is a BadSchema, and everything fails it. Type tests look at
the variant's own type: casts would take "5" for 5 and true for 1.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"string", "integer", "number", "boolean", "object", "array", "null"}
#: How often a reference is followed within itself; deeper values are not looked into.
DEPTH = 6
# What each keyword must hold, for those whose values are checked.
_COUNT = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")
_NUMBER = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
_SCHEMA = ("not", "if", "then", "else", "propertyNames", "contains", "additionalProperties", "items")
_SCHEMAS = ("allOf", "anyOf", "oneOf", "prefixItems")
_BY_NAME = ("properties", "patternProperties", "$defs", "definitions")


class BadSchema(ValueError):
    """A schema that breaks the rules of JSON Schema."""


def check_schema(schema: Any, at: str = "#") -> None:
    """Raises BadSchema where a keyword holds what it may not."""

    def want(good: bool, word: str) -> None:
        if not good:
            raise BadSchema(f"{at}/{word}")

    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise BadSchema(at)
    is_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    for word, x in schema.items():
        if word == "type":
            names = [x] if isinstance(x, str) else x
            want(isinstance(names, list) and bool(names) and all(n in TYPES for n in names), word)
        elif word in _COUNT:
            want(is_number(x) and x >= 0 and x == int(x), word)
        elif word in _NUMBER:
            want(is_number(x) and (word != "multipleOf" or x > 0), word)
        elif word == "pattern":
            want(isinstance(x, str), word)
        elif word == "enum":
            want(isinstance(x, list), word)
        elif word == "uniqueItems":
            want(isinstance(x, bool), word)
        elif word == "required":
            want(isinstance(x, list) and all(isinstance(k, str) for k in x), word)
        elif word == "dependentRequired":
            want(isinstance(x, dict) and all(isinstance(v, list) for v in x.values()), word)
        elif word == "$ref":
            want(isinstance(x, str), word)
        elif word in _SCHEMA:
            check_schema(x, f"{at}/{word}")
        elif word in _SCHEMAS:
            want(isinstance(x, list) and (bool(x) or word == "prefixItems"), word)
            for k, sub in enumerate(x):
                check_schema(sub, f"{at}/{word}/{k}")
        elif word in _BY_NAME:
            want(isinstance(x, dict), word)
            for k, sub in x.items():
                check_schema(sub, f"{at}/{word}/{k}")


def referred(root: Any, ref: str) -> Any:
    """The part of a schema that a reference within it names."""
    if not ref.startswith("#"):
        raise BadSchema(f"{ref}: only places within the schema")
    found = root
    for step in ref[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        try:
            found = found[int(step)] if isinstance(found, list) else found[step]
        except (KeyError, IndexError, ValueError, TypeError):
            raise BadSchema(ref) from None
    return found


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_type(v: Column, name: str) -> Column:
    k = kind(v)
    numeric = k.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    if name == "integer":
        d = F.try_variant_get(v, "$", "double")
        return numeric & (d == F.floor(d))
    tests = {"string": k == "STRING", "number": numeric, "boolean": k == "BOOLEAN", "object": k.startswith("OBJECT<"), "array": k.startswith("ARRAY<"), "null": k == "VOID"}
    return tests[name]


def equals(v: Column, value: Any) -> Column:
    """Same type and value: 1 and 1.0 are equal, 1 and true are not."""
    if isinstance(value, bool):
        return is_type(v, "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if value is None:
        return is_type(v, "null")
    if isinstance(value, (int, float)):
        return is_type(v, "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    if isinstance(value, str):
        return is_type(v, "string") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def all_of(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def key_path(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def violations(v: Column, schema: Any, path: tuple[str, ...] = (), root: Any = None, refs: tuple[str, ...] = ()) -> list[tuple[str, str, Column]]:
    """(path, keyword, column that is true where the value breaks it), in the order in which errors are reported."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [(".".join(path) or "root", "false", F.lit(True))]
    root = schema if root is None else root
    good_for = lambda x, sub: all_of([~bad for _, _, bad in violations(x, sub, path, root, refs)])
    at = ".".join(path) or "root"
    out: list[tuple[str, str, Column]] = []
    add = lambda word, bad: out.append((at, word, F.coalesce(bad, F.lit(False))))
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        good = F.lit(False)
        for n in names:
            good = good | is_type(v, n)
        add("type", ~good)
    if "enum" in schema:
        good = F.lit(False)
        for x in schema["enum"]:
            good = good | equals(v, x)
        add("enum", ~good)
    if "const" in schema:
        add("const", ~equals(v, schema["const"]))
    text, number, array, obj = (is_type(v, t) for t in ("string", "number", "array", "object"))
    s, d = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    items, entries = F.try_variant_get(v, "$", "array<variant>"), F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    for word, bad in (
        ("minLength", lambda x: text & (F.length(s) < x)),
        ("maxLength", lambda x: text & (F.length(s) > x)),
        ("pattern", lambda x: text & ~s.rlike(x)),
        ("minimum", lambda x: number & (d < x)),
        ("maximum", lambda x: number & (d > x)),
        ("exclusiveMinimum", lambda x: number & (d <= x)),
        ("exclusiveMaximum", lambda x: number & (d >= x)),
        ("minItems", lambda x: array & (F.size(items) < x)),
        ("maxItems", lambda x: array & (F.size(items) > x)),
        ("minProperties", lambda x: obj & (F.size(entries) < x)),
        ("maxProperties", lambda x: obj & (F.size(entries) > x)),
        ("multipleOf", lambda x: number & (F.abs(d / x - F.round(d / x)) > 1e-9)),
    ):
        if word in schema:
            add(word, bad(schema[word]))
    for key in schema.get("required", []):
        add("required", obj & F.try_variant_get(v, key_path(key), "variant").isNull())
    for key, others in schema.get("dependentRequired", {}).items():
        lacks = F.lit(False)
        for other in others:
            lacks = lacks | F.try_variant_get(v, key_path(other), "variant").isNull()
        add("dependentRequired", obj & F.try_variant_get(v, key_path(key), "variant").isNotNull() & lacks)
    known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
    if schema.get("additionalProperties", True) not in (True, {}):

        def extra(e: Column) -> Column:
            free = ~e["key"].isin(*known) if known else F.lit(True)
            for p in patterns:
                free = free & ~e["key"].rlike(p)
            return free & ~good_for(e["value"], schema["additionalProperties"])

        add("additionalProperties", obj & F.exists(entries, extra))
    for key, sub in known.items():
        child = F.try_variant_get(v, key_path(key), "variant")
        out += [(p, w, child.isNotNull() & bad) for p, w, bad in violations(child, sub, (*path, key), root, refs)]
    for p, sub in patterns.items():
        add("patternProperties", obj & F.exists(entries, lambda e: e["key"].rlike(p) & ~good_for(e["value"], sub)))  # noqa: B023  (called at once)
    if "propertyNames" in schema:
        add("propertyNames", obj & F.exists(entries, lambda e: ~good_for(F.try_parse_json(F.to_json(F.array(e["key"]))), {"items": schema["propertyNames"]})))
    first = schema.get("prefixItems", [])
    for k, sub in enumerate(first):
        child = F.get(items, F.lit(k))
        out += [(p, w, array & child.isNotNull() & bad) for p, w, bad in violations(child, sub, (*path, str(k)), root, refs)]
    if schema.get("items", True) not in (True, {}):
        rest = F.slice(items, len(first) + 1, F.greatest(F.size(items) - len(first), F.lit(0))) if first else items
        add("items", array & F.exists(rest, lambda x: ~good_for(x, schema["items"])))
    if "contains" in schema:
        n = F.size(F.filter(items, lambda x: good_for(x, schema["contains"])))
        add("contains", array & ((n < schema.get("minContains", 1)) | (n > schema.get("maxContains", 1 << 30))))
    if schema.get("uniqueItems"):
        add("uniqueItems", array & (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items)))
    number_of = lambda subs: sum((good_for(v, sub).cast("int") for sub in subs), F.lit(0))
    for sub in schema.get("allOf", []):
        out += violations(v, sub, path, root, refs)
    if "anyOf" in schema:
        add("anyOf", number_of(schema["anyOf"]) == 0)
    if "oneOf" in schema:
        add("oneOf", number_of(schema["oneOf"]) != 1)
    if "not" in schema:
        add("not", good_for(v, schema["not"]))
    if "if" in schema:
        holds = good_for(v, schema["if"])
        for word, when in (("then", holds), ("else", ~holds)):
            if word in schema:
                add(word, when & ~good_for(v, schema[word]))
    if "$ref" in schema and refs.count(schema["$ref"]) < DEPTH:
        out += violations(v, referred(root, schema["$ref"]), path, root, (*refs, schema["$ref"]))
    return out


def matches(v: Column, schema: Any) -> Column:
    """Whether a variant satisfies the schema."""
    return all_of([~bad for _, _, bad in violations(v, schema)])


def first_error(v: Column, schema: Any) -> Column:
    """struct(path, keyword) of the first broken rule, null where all hold."""
    found = violations(v, schema)
    if not found:
        return F.lit(None).cast("struct<path:string,keyword:string>")
    return F.coalesce(*[F.when(bad, F.struct(F.lit(p).alias("path"), F.lit(w).alias("keyword"))) for p, w, bad in found])


def validate(content: Column, schema: dict | None) -> tuple[Column, Column]:
    """(passed, error) of JSON texts. Without a schema everything passes; text that isn't JSON fails, and so does everything under a bad schema."""
    if not schema:
        return F.lit(True), F.lit(None).cast("struct<path:string,keyword:string>")
    try:
        check_schema(schema)
        violations(F.lit(None).cast("variant"), schema)  # follows the references
    except BadSchema as bad:
        return F.lit(False), F.struct(F.lit("root").alias("path"), F.lit(f"schema: {bad}").alias("keyword"))
    v = F.try_parse_json(content)
    parsed = v.isNotNull()
    error = F.when(~parsed, F.struct(F.lit("root").alias("path"), F.lit("json").alias("keyword"))).otherwise(first_error(v, schema))
    return F.coalesce(parsed & error.isNull(), F.lit(False)), error
