"""Recipes from YAML."""

from __future__ import annotations

import logging
from pathlib import Path

import yaml

from millrace.plans.grammar import Grammar, derive_schema
from millrace.spec import Recipe

log = logging.getLogger(__name__)


def load_yaml(path: str | Path) -> dict:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def load_grammar(path: str | Path) -> dict:
    raw = load_yaml(path)
    if not isinstance(raw, dict) or "grammar" not in raw:
        raise ValueError(f"{path} has no grammar section")
    return raw["grammar"]


def load_recipe(path: str | Path) -> Recipe:
    """A recipe; one with a grammar gets its own path as grammar_path, and a schema derived from the templates where it names none.

    A grammar from which no schema can be derived leaves the recipe without one, and then every sample passes the schema check.
    """
    raw = load_yaml(path)
    if not isinstance(raw, dict):
        raise ValueError(f"{path} is not a mapping but {type(raw).__name__}")
    if "grammar" in raw:
        constraints = dict(raw.get("constraints") or {})
        constraints.setdefault("grammar_path", str(path))
        if "schema" not in constraints:
            try:
                schema = derive_schema(Grammar(raw["grammar"]))
            except Exception as e:
                log.warning("no schema could be derived: %s", e)
                schema = {}
            if schema:
                constraints["schema"] = schema | {"_derived_from_grammar": True}
        raw = raw | {"constraints": constraints}
    return Recipe.from_dict(raw)
