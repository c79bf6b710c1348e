"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = (
    "mixing",
    "secrets",
    "htmltext",
    "jaccardjoin",
    "substrings",
    "toxicity",
    "editsketch",
    "archives",
    "packing",
    "quality",
)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"millrace.llm.{_name}")
    QUERIES[_module.QUERY] = _module.query
    if getattr(_module, "ORACLE_SQL", None):
        ORACLES[_module.QUERY] = _module.ORACLE_SQL
