"""Weighted grammars: checking, JSON Schema derived from templates, sampling, and the relation they form.

A rule is a list of options, each a ``template`` (text with ``<rule>`` placeholders) or an ``llm_fill`` (a prompt), with a weight.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = re.compile(r"<(\w+)>")


@dataclass(frozen=True)
class Option:
    kind: str  # template or llm_fill
    body: Any
    weight: float


class Grammar:
    """A start symbol and rules, checked when built; placeholders without a rule are only found when expanded."""

    def __init__(self, raw: dict):
        problems = check(raw)
        if problems:
            raise ValueError("; ".join(problems))
        self.start = raw["start"]
        self.rules = {name: [Option("template" if "template" in o else "llm_fill", o.get("template", o.get("llm_fill")), float(o["weight"])) for o in options] for name, options in raw["rules"].items()}

    def options(self, name: str) -> list[Option]:
        if name not in self.rules:
            raise ValueError(f"no rule named {name!r}")
        return self.rules[name]

    def uses_model(self, name: str) -> bool:
        return any(o.kind == "llm_fill" for o in self.options(name))

    def relation(self, spark: SparkSession) -> DataFrame:
        rows = [(rule, k, o.kind, o.body if isinstance(o.body, str) else json.dumps(o.body), o.weight) for rule, options in self.rules.items() for k, o in enumerate(options)]
        return spark.createDataFrame(rows, "rule string, option_idx int, kind string, body string, weight double")


def check(raw: Any) -> list[str]:
    """What is wrong with a grammar, in reading order."""
    if not isinstance(raw, dict) or "start" not in raw:
        return ["a grammar needs a start symbol"]
    rules = raw.get("rules")
    if not isinstance(rules, dict) or not rules:
        return ["a grammar needs rules"]
    out = [] if raw["start"] in rules else [f"the start symbol {raw['start']!r} has no rule"]
    for name, options in rules.items():
        if not isinstance(options, list) or not options:
            out.append(f"rule {name!r} needs a list of options")
            continue
        for k, o in enumerate(options):
            where = f"option {k} of rule {name!r}"
            if not isinstance(o, dict):
                out.append(f"{where} is not a mapping")
                continue
            if ("template" in o) == ("llm_fill" in o):
                out.append(f"{where} needs either template or llm_fill")
            w = o.get("weight")
            if isinstance(w, bool) or not isinstance(w, (int, float)):
                out.append(f"{where} needs a numeric weight")
            elif w <= 0:
                out.append(f"{where} needs a weight above 0")
    return out


def relation_violations(options: DataFrame, start: str) -> DataFrame:
    """The same rules over a relation (rule, option_idx, template, llm_fill, weight): one row per violation."""
    one_body = F.col("template").isNull() == F.col("llm_fill").isNull()
    each = options.select(
        "rule",
        "option_idx",
        F.explode(
            F.filter(
                F.array(
                    F.when(one_body, F.lit("body")),
                    F.when(F.col("weight").isNull(), F.lit("weight_missing")),
                    F.when(F.col("weight") <= 0, F.lit("weight_not_positive")),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("violation"),
    )
    has_start = options.agg(F.count_if(F.col("rule") == start).alias("n")).where("n = 0")
    return each.unionByName(has_start.select(F.lit(start).alias("rule"), F.lit(-1).alias("option_idx"), F.lit("no_start_rule").alias("violation")))


# Schema derivation


def template_object(template: str) -> dict | None:
    """A template as an object with stand-ins for its placeholders; None if that is not a JSON object."""
    text = re.sub(r'"<\w+>"', '"PLACEHOLDER"', template)
    text = PLACE.sub('"PLACEHOLDER_NUM"', text)
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        return None
    return value if isinstance(value, dict) else None


def value_schema(value: Any) -> dict:
    """The schema of one value; literals are remembered as const."""
    if isinstance(value, dict):
        return {"type": "object", "required": list(value), "properties": {k: value_schema(v) for k, v in value.items()}}
    if isinstance(value, list):
        return {"type": "array", "items": value_schema(value[0])} if value else {"type": "array"}
    if isinstance(value, bool):
        return {"type": "boolean", "const": value}
    if isinstance(value, int):
        return {"type": "integer", "const": value}
    if isinstance(value, float):
        return {"type": "number", "const": value}
    if isinstance(value, str) and not value.startswith("PLACEHOLDER"):
        return {"type": "string", "const": value}
    return {"type": "string"}


def merged_property(found: list[dict]) -> dict:
    """One schema for a field that several templates have: values seen become an enum; of differing types the first stands."""
    first = {k: v for k, v in found[0].items() if k != "const"}
    if any(s.get("type") != found[0].get("type") for s in found):
        return first
    if found[0].get("type") == "object":
        return merged(found)
    if found[0].get("type") == "array":
        return {"type": "array", "items": merged_property([s.get("items", {}) for s in found])}
    if all("const" in s for s in found):
        return first | {"enum": sorted({s["const"] for s in found}, key=str)}
    return first


def merged(schemas: list[dict]) -> dict:
    """Objects as one: required is what all of them require, properties what any has."""
    if len(schemas) == 1:
        return schemas[0]
    required = set(schemas[0].get("required", [])).intersection(*(s.get("required", []) for s in schemas[1:]))
    names = dict.fromkeys(k for s in schemas for k in s.get("properties", {}))
    properties = {k: merged_property([s["properties"][k] for s in schemas if k in s.get("properties", {})]) for k in names}
    return {"type": "object", "required": sorted(required), "properties": properties}


def rule_type(grammar: Grammar, name: str) -> dict | None:
    """The type of what a rule's templates say, with an enum if they say different things; None if only a model fills it."""
    values = []
    for o in grammar.rules.get(name, []):
        if o.kind == "template":
            try:
                values.append(json.loads(o.body))
            except json.JSONDecodeError:
                values.append(o.body.strip())
    if not values:
        return None
    for kind, match in (
        ("boolean", lambda v: isinstance(v, bool)),
        ("integer", lambda v: isinstance(v, int) and not isinstance(v, bool)),
        ("number", lambda v: isinstance(v, float)),
        ("string", lambda v: isinstance(v, str)),
    ):
        if all(match(v) for v in values):
            distinct = sorted(set(values))
            # Texts need different values for an enum, other types only several options.
            return {"type": kind} | ({"enum": distinct} if len(distinct if kind == "string" else values) > 1 else {})
    return {"type": "string"}


def typed_by_rules(schema: dict, grammar: Grammar) -> dict:
    """Text fields take the type of the rule of the same name (the field's name, not its placeholder's); objects are entered, arrays not."""
    out = dict(schema)
    for name, sub in schema.get("properties", {}).items():
        if sub.get("type") == "object":
            sub = typed_by_rules(sub, grammar)
        elif sub.get("type") == "string" and "enum" not in sub and name in grammar.rules:
            found = rule_type(grammar, name)
            sub = found if found is not None else sub
        out["properties"] = {**out.get("properties", {}), name: sub}
    return out


def derive_schema(grammar: Grammar) -> dict:
    """A JSON Schema for what the start symbol's templates produce; empty if none of them is an object."""
    found = [template_object(o.body) for o in grammar.options(grammar.start) if o.kind == "template" and isinstance(o.body, str)]
    schemas = [value_schema(v) for v in found if v is not None]
    if not schemas:
        return {}
    return typed_by_rules(merged(schemas), grammar)


# Sampling


def probabilities(weights: list[float], temperature: float) -> list[float]:
    if temperature != 1.0:
        logs = [math.log(w + 1e-10) / temperature for w in weights]
        top = max(logs)
        weights = [math.exp(x - top) for x in logs]
    total = sum(weights)
    return [w / total for w in weights]


class Sampler:
    """Expands the start symbol. ``fill`` answers llm_fill prompts; its answers may hold placeholders too, and are spliced in as they are."""

    def __init__(self, grammar: Grammar, fill: Callable[[Any], str], temperature: float = 1.0, max_depth: int = 10, rng: random.Random | None = None):
        self.grammar, self.fill, self.max_depth, self.rng = grammar, fill, max_depth, rng or random.Random()
        self.chances = {name: probabilities([o.weight for o in options], temperature) for name, options in grammar.rules.items()}

    def sample(self) -> str:
        return self.expand(self.grammar.start, 1)

    def expand(self, name: str, depth: int) -> str:
        if depth > self.max_depth:
            raise RecursionError(f"deeper than {self.max_depth} at {name!r}")
        options = self.grammar.options(name)
        option = self.rng.choices(options, self.chances[name])[0]
        text = option.body if option.kind == "template" else self.fill(option.body).strip()
        return PLACE.sub(lambda m: self.expand(m[1], depth + 1), text)


def sample_many(spark: SparkSession, raw: dict, n: int, fill: Callable[[Any], str], temperature: float = 1.0, max_depth: int = 10, seed: int = 0) -> DataFrame:
    """(attempt, content, error) of n seeded expansions, run where the rows are; attempt k gives the same text on any cluster."""
    import pandas as pd

    def run(batches):
        grammar = Grammar(raw)
        for pdf in batches:
            rows = []
            for k in pdf["id"]:
                try:
                    rows.append((k, Sampler(grammar, fill, temperature, max_depth, random.Random(f"{seed}:{k}")).sample(), None))
                except Exception as e:  # one failed attempt costs one attempt
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["attempt", "content", "error"])

    return spark.range(n).mapInPandas(run, "attempt long, content string, error string")
