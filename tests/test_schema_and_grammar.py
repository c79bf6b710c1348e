import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonschema as J
from millrace.plans import grammar as G


def verdicts(spark, schema, texts):
    ok, error = J.validate(F.col("t"), schema)
    return [(r["ok"], tuple(r["e"]) if r["e"] else None) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ok.alias("ok"), error.alias("e")).collect()]


def test_types_are_the_values_own(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "s": {"type": "string"}, "b": {"type": "boolean"}}}
    got = verdicts(spark, schema, ['{"n": 5.0}', '{"n": "5"}', '{"n": true}', '{"s": 1}', '{"b": false}', '{"n": 5.5}', "[]"])
    assert [g[0] for g in got] == [True, False, False, False, True, False, False]


def test_keywords(spark):
    schema = {
        "type": "object",
        "required": ["a"],
        "additionalProperties": False,
        "properties": {"a": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^x"}, "l": {"type": "array", "minItems": 1, "items": {"enum": [1, "1"]}}, "c": {"const": None}},
    }
    texts = ['{"a": "x😀"}', '{"a": "x"}', '{"a": "xyzw"}', '{"a": "ab"}', "{}", '{"a": "xy", "z": 1}', '{"a": "xy", "l": [1, "1", 1.0]}', '{"a": "xy", "l": [true]}', '{"a": "xy", "l": []}', '{"a": "xy", "c": null}', "oops"]
    got = verdicts(spark, schema, texts)
    assert [g[1] for g in got] == [None, ("a", "minLength"), ("a", "maxLength"), ("a", "pattern"), ("root", "required"), ("root", "additionalProperties"), None, ("l", "items"), ("l", "minItems"), None, ("root", "json")]


def test_no_schema_passes_everything(spark):
    assert verdicts(spark, None, ["hello", "{}"]) == [(True, None), (True, None)]


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"x"', "7"], ["3"]),
        ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, ["4", "9"], ["6", "5"]),
        ({"allOf": [{"required": ["a"]}, {"required": ["b"]}]}, ['{"a": 1, "b": 2}'], ['{"a": 1}']),
        ({"not": {"type": "null"}}, ["1"], ["null"]),
        ({"$defs": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/n"}}}, ['{"a": 1}', "{}"], ['{"a": "1"}']),
        ({"properties": {"v": {"type": "integer"}, "next": {"$ref": "#"}}}, ['{"v": 1, "next": {"v": 2, "next": {"v": 3}}}'], ['{"v": 1, "next": {"v": 2, "next": {"v": "3"}}}']),
        ({"uniqueItems": True}, ['[1, 2, "1"]', "[]", '"aa"'], ["[1, 2, 1]", '[{"a": 1, "b": 2}, {"b": 2, "a": 1}]']),
        ({"multipleOf": 0.1}, ["0.3", "5", '"x"'], ["0.25"]),
        ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": {"type": "string"}}, ['{"n_a": 1, "b": "x"}'], ['{"n_a": "1"}', '{"b": 1}']),
        ({"minProperties": 1, "maxProperties": 2}, ['{"a": 1}', "3"], ["{}", '{"a": 1, "b": 2, "c": 3}']),
        ({"propertyNames": {"maxLength": 2}}, ['{"ab": 1}'], ['{"abc": 1}']),
        ({"dependentRequired": {"a": ["b"]}}, ['{"b": 1}', '{"a": 1, "b": 2}'], ['{"a": 1}']),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, ['["a", 1, 2]', "[]"], ["[1]", '["a", "b"]']),
        ({"contains": {"const": 3}, "maxContains": 1}, ["[1, 3]"], ["[1]", "[3, 3]"]),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"maxProperties": 0}}, ['{"a": 1, "b": 2}', "{}"], ['{"a": 1}', '{"c": 1}']),
        ({"format": "date", "no_such_keyword": 3}, ["1"], []),
        ({"items": False}, ["[]"], ["[1]"]),
    ],
)
def test_every_keyword(spark, schema, good, bad):
    got = verdicts(spark, schema, good + bad)
    assert [g[0] for g in got] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize("schema", [{"type": "text"}, {"properties": {"a": {"oneOf": []}}}, {"minLength": -1}, {"$ref": "#/nowhere"}, {"required": "a"}, {"items": {"multipleOf": 0}}, {"enum": 3}])
def test_a_bad_schema_fails_everything(spark, schema):
    got = verdicts(spark, schema, ["{}", "1"])
    assert [g[0] for g in got] == [False, False] and got[0][1][1].startswith("schema: ")


REVIEW = {
    "start": "review",
    "rules": {
        "review": [{"template": '{"text": "<body>", "sentiment": "<sentiment_label>", "rating": <rating>, "reviewer": {"level": "<level>", "verified": <verified>}}', "weight": 1}],
        "body": [{"llm_fill": "a sentence", "weight": 1}],
        "sentiment_label": [{"template": "positive", "weight": 0.6}, {"template": "negative", "weight": 0.4}],
        "rating": [{"template": str(k), "weight": 1} for k in (5, 4, 3, 2, 1)],
        "level": [{"template": "beginner", "weight": 1}, {"template": "advanced", "weight": 1}],
        "verified": [{"template": "true", "weight": 4}, {"template": "false", "weight": 1}],
    },
}


def test_derived_schema_follows_field_names():
    assert G.derive_schema(G.Grammar(REVIEW)) == {
        "type": "object",
        "required": ["text", "sentiment", "rating", "reviewer"],
        "properties": {
            "text": {"type": "string"},
            "sentiment": {"type": "string"},
            "rating": {"type": "integer", "enum": [1, 2, 3, 4, 5]},
            "reviewer": {
                "type": "object",
                "required": ["level", "verified"],
                "properties": {"level": {"type": "string", "enum": ["advanced", "beginner"]}, "verified": {"type": "boolean", "enum": [False, True]}},
            },
        },
    }


def test_templates_merge():
    schemas = [G.value_schema(G.template_object(t)) for t in ('{"k": "x", "a": "<p>"}', '{"k": "y", "b": "<q>"}')]
    assert G.merged(schemas) == {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "enum": ["x", "y"]}, "a": {"type": "string"}, "b": {"type": "string"}}}
    assert G.template_object('{"t": "<a> <b>"}') is None


def test_derived_schema_accepts_expansions(spark):
    grammar = G.Grammar(REVIEW)
    sampler = G.Sampler(grammar, lambda p: "fine words", 0.9, 8, random.Random(1))
    texts = [sampler.sample() for _ in range(40)]
    assert all(v[0] for v in verdicts(spark, G.derive_schema(grammar), texts))


@pytest.mark.parametrize(
    "raw",
    [{}, {"start": "a", "rules": {}}, {"start": "b", "rules": {"a": [{"template": "x", "weight": 1}]}}, {"start": "a", "rules": {"a": []}}, {"start": "a", "rules": {"a": [{"template": "x", "llm_fill": "y", "weight": 1}]}}, {"start": "a", "rules": {"a": [{"template": "x", "weight": 0}]}}, {"start": "a", "rules": {"a": [{"template": "x"}]}}],
)
def test_broken_grammars(raw):
    with pytest.raises(ValueError):
        G.Grammar(raw)


def test_depth_and_unknown_rules():
    loop = G.Grammar({"start": "a", "rules": {"a": [{"template": "<a>", "weight": 1}]}})
    with pytest.raises(RecursionError):
        G.Sampler(loop, str, max_depth=5).sample()
    hole = G.Grammar({"start": "a", "rules": {"a": [{"llm_fill": "p", "weight": 1}]}})
    with pytest.raises(ValueError):
        G.Sampler(hole, lambda p: "see <nowhere>").sample()
    assert hole.uses_model("a")


def test_sampling_is_seeded_and_follows_weights(spark):
    a = G.sample_many(spark, REVIEW, 300, lambda p: "w", 1.0, 8, 4).orderBy("attempt").collect()
    b = G.sample_many(spark, REVIEW, 300, lambda p: "w", 1.0, 8, 4).orderBy("attempt").collect()
    assert a == b
    share = sum(json.loads(r["content"])["sentiment"] == "positive" for r in a) / 300
    assert 0.5 < share < 0.7
