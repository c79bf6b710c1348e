"""Validators as plans. A sample validator adds ``<name>_score`` and ``<name>_passed`` to every sample; a batch validator yields one verdict
for the samples that passed all sample validators, and may score each of them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import jsonschema
from millrace.functions.columns import (
    JUDGE_HIDDEN_KEYS,
    cosine,
    dedup_value,
    entailment_score,
    level_score,
    passes,
)
from millrace.functions.providers import ChatProvider, OfflineChat, OfflineEntailment, embed_column, entailment_columns
from millrace.operators import diversity
from millrace.operators.dedup import flag_repeats
from millrace.spec import Recipe, original_text

# The order in which validators run, and their thresholds where a recipe sets none.
ORDER = ("deduplication", "similarity", "entailment", "json_schema", "diversity", "llm_judge")
THRESHOLDS = {"deduplication": 0.99, "similarity": 0.85, "entailment": 0.5, "json_schema": 0.7, "diversity": 0.3, "llm_judge": 0.7}
BASE_THRESHOLD = 0.7

# What the judge is asked.
LEVELS = {5: "excellent", 4: "good", 3: "acceptable", 2: "poor", 1: "unusable"}
DEFAULT_CRITERIA = "General quality and coherence"


@dataclass(frozen=True)
class Verdict:
    score: float
    passed: bool
    metadata: dict = field(default_factory=dict)
    levels: dict[int, float] = field(default_factory=dict)


class Validator:
    batch_level = False

    def __init__(self, name: str, config: dict):
        self.name, self.config = name, config
        self.threshold = float(config.get("threshold", THRESHOLDS.get(name, BASE_THRESHOLD)))

    def score(self, samples: DataFrame, recipe: Recipe) -> DataFrame:
        raise NotImplementedError

    def judge(self, survivors: DataFrame, recipe: Recipe) -> Verdict:
        raise NotImplementedError


class Deduplication(Validator):
    """By the whole content, or by a ``check_field`` other than ``content`` of the metadata where a sample has it; objects whatever the order of
    their keys. The threshold is kept and not used."""

    def __init__(self, name: str, config: dict, seen: DataFrame | None = None):
        super().__init__(name, config)
        self.seen = seen

    def score(self, samples: DataFrame, recipe: Recipe) -> DataFrame:
        value = dedup_value("content", "metadata", self.config.get("check_field", "content"))
        out = flag_repeats(samples, value, "pos", seen=self.seen, kind="content_kind" if "content_kind" in samples.columns else None)
        return out.drop("duplicate").withColumnsRenamed({"dedup_score": "deduplication_score", "dedup_passed": "deduplication_passed"})


class Similarity(Validator):
    def score(self, samples: DataFrame, recipe: Recipe) -> DataFrame:
        name = self.config.get("embedding_model", "offline/trigrams")
        v = embed_column(F.col("content"), name)
        o = embed_column(F.lit(original_text(recipe)), name)
        return samples.withColumn("similarity_score", cosine(v, o)).withColumn("similarity_passed", passes("similarity_score", self.threshold))


class Entailment(Validator):
    """Both directions must reach the threshold; the score is the smaller one."""

    def score(self, samples: DataFrame, recipe: Recipe) -> DataFrame:
        o, provider = F.lit(original_text(recipe)), self.config.get("provider", OfflineEntailment)
        both = samples.withColumn("_f", entailment_columns(o, F.col("content"), provider)).withColumn("_b", entailment_columns(F.col("content"), o, provider))
        both = both.withColumn("entailment_score", entailment_score("_f", "_b"))
        return both.withColumn("entailment_passed", passes("_f", self.threshold) & passes("_b", self.threshold)).drop("_f", "_b")


class JsonSchema(Validator):
    """1.0 or 0.0; the threshold is kept and not used."""

    def score(self, samples: DataFrame, recipe: Recipe) -> DataFrame:
        ok, error = jsonschema.validate(F.col("content"), recipe.constraints.get("schema"))
        return samples.withColumn("json_schema_passed", ok).withColumn("json_schema_score", F.when(ok, 1.0).otherwise(0.0)).withColumn("json_schema_error", error)


class Diversity(Validator):
    batch_level = True

    def judge(self, survivors: DataFrame, recipe: Recipe) -> Verdict:
        v = survivors.select(F.lit(0).alias("batch"), embed_column(F.col("content"), self.config.get("embedding_model", "offline/trigrams")).alias("v"))
        row = diversity.gate(diversity.closed_form(v, "batch", "v"), self.threshold).first()
        return Verdict(1.0, True) if row is None else Verdict(float(row["diversity"]), bool(row["passed"]))


def hidden_removed(constraints: dict) -> dict:
    return {k: v for k, v in constraints.items() if k not in JUDGE_HIDDEN_KEYS}


class Judge(Validator):
    """One call for the whole batch: its aggregate passes or fails every survivor; the levels only score them."""

    batch_level = True

    def __init__(self, name: str, config: dict, chat: ChatProvider | None = None):
        super().__init__(name, config)
        self.chat = chat or OfflineChat(config.get("model", "gpt-4o-mini"), config.get("temperature", 0.0), max_tokens=config.get("max_tokens", 2000))
        self.criteria: dict[str, str] = {}

    def criteria_for(self, recipe: Recipe) -> str:
        guidance = self.config.get("quality_criteria", "")
        key = json.dumps([recipe.domain, hidden_removed(recipe.constraints), guidance], sort_keys=True, default=str)
        if key not in self.criteria:
            task = recipe.task_input if isinstance(recipe.task_input, str) else json.dumps(recipe.task_input, default=str)
            prompt = f"Domain: {recipe.domain}\nTask: {task}\nConstraints: {hidden_removed(recipe.constraints)}\nGuidance: {guidance}\n\nName one to three criteria that tell good samples from bad ones here. Answer with the list alone."
            try:
                self.criteria[key] = self.chat.generate(prompt).strip()
            except Exception:  # a provider that fails leaves the recipe's own guidance
                self.criteria[key] = guidance or DEFAULT_CRITERIA
        return self.criteria[key]

    def prompts(self, contents: list[str], recipe: Recipe) -> tuple[str, str]:
        task = recipe.task_input
        if isinstance(task, dict):
            task = f"{task.get('original_input', '')} (expected output: {task.get('expected_output', '')})" if "original_input" in task else "\n".join(f"  {k}: {v}" for k, v in task.items())
        constraints = "\n".join(f"  - {k}: {v}" for k, v in hidden_removed(recipe.constraints).items())
        scale = "\n".join(f"{k}: {v}" for k, v in LEVELS.items())
        system = (
            f"You judge generated samples.\n\nLevels:\n{scale}\n\nCriteria:\n{self.criteria_for(recipe)}\n\n"
            'Answer with JSON: {"reasoning": text, "aggregate_quality_level": number, "samples": [{"sample_index": number from 0, "justification": text, "quality_level": 1 to 5}]}'
        )
        listed = "\n\n".join(f"Sample {k}:\n{c}" for k, c in enumerate(contents, 1))
        return system, f"Domain: {recipe.domain}\nTask: {task}\n{constraints}\n\nEvaluate these {len(contents)} generated samples:\n{listed}"

    def judge(self, survivors: DataFrame, recipe: Recipe) -> Verdict:
        contents = [r["content"] for r in survivors.orderBy("pos").select("content").collect()]  # one batch: a few samples
        if not contents:
            return Verdict(0.0, False, {"error": "empty batch"})
        system, user = self.prompts(contents, recipe)
        for attempt in range(2):
            try:
                answer = json_answer(self.chat.generate(user, system, response_format={"type": "json_object"}))
                score = float(answer.get("aggregate_quality_level", 3.0)) / 5
                levels = {int(x["sample_index"]): float(x["quality_level"]) for x in answer.get("samples", [])}
                return Verdict(score, score >= self.threshold, {"reasoning": answer.get("reasoning")}, levels)
            except (ValueError, KeyError, TypeError):
                if attempt:
                    return Verdict(0.0, False, {"error": "the judge's answer could not be read"})
        raise AssertionError


def json_answer(text: str) -> dict[str, Any]:
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    return json.loads(fenced[1] if fenced else text)


MADE = {"deduplication": Deduplication, "similarity": Similarity, "entailment": Entailment, "json_schema": JsonSchema, "diversity": Diversity, "llm_judge": Judge}


def enabled(config: dict | None) -> list[Validator]:
    """The recipe's validators that are switched on, in their fixed order; names that don't exist are ignored."""
    return [MADE[n](n, config[n]) for n in ORDER if config and (config.get(n) or {}).get("enabled")]


def judged_scores(survivors: DataFrame, verdict: Verdict) -> DataFrame:
    """Adds pos_survivor and llm_judge_score: a sample's own level, or the aggregate where the judge named none."""
    ranked = survivors.withColumn("pos_survivor", F.row_number().over(Window.orderBy("pos")) - 1)
    if not verdict.levels:
        return ranked.withColumn("llm_judge_score", F.lit(verdict.score))
    levels = F.create_map(*[F.lit(x) for kv in verdict.levels.items() for x in kv])
    return ranked.withColumn("llm_judge_score", F.coalesce(level_score(levels[F.col("pos_survivor")]), F.lit(verdict.score)))
