"""Recipes and the small values that pass through the loop. All are immutable; a step returns new ones."""

from __future__ import annotations

import enum
import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any


class GeneratorKind(enum.StrEnum):
    NAIVE = "naive"
    TEMPLATER = "templater"
    RAG_LLM = "rag_llm"  # a name only: nothing generates with it


@dataclass(frozen=True)
class Recipe:
    domain: str
    task_input: str | dict
    num_samples: int
    constraints: dict = field(default_factory=dict)
    validators: dict | None = None
    output_format: str = "text"
    output_path: str | None = None

    def __post_init__(self):
        if isinstance(self.num_samples, bool) or not isinstance(self.num_samples, int) or self.num_samples <= 0:
            raise ValueError("num_samples must be positive")

    @classmethod
    def from_dict(cls, raw: dict) -> Recipe:
        """Keys that recipes don't have are ignored."""
        missing = [k for k in ("domain", "task_input", "num_samples") if k not in raw]
        if missing:
            raise ValueError(f"a recipe needs {', '.join(missing)}")
        return cls(**{k: raw[k] for k in cls.__dataclass_fields__ if k in raw})


@dataclass(frozen=True)
class Progress:
    remaining: int
    collected: int = 0
    rejected: int = 0
    iteration: int = 0


@dataclass(frozen=True)
class Context:
    domain: str
    task_input: str | dict
    num_samples: int
    progress: Progress
    constraints: dict = field(default_factory=dict)
    grammar_path: str | None = None
    complexity_level: str = "medium"
    constraint_count: int = 0
    has_examples: bool = False
    has_knowledge_base: bool = False

    def at(self, collected: int, rejected: int, iteration: int) -> Context:
        return replace(self, progress=Progress(self.num_samples - collected, collected, rejected, iteration))


@dataclass(frozen=True)
class Plan:
    batch_size: int
    generator_arm: str
    parameters: dict
    iteration: int
    reasoning: str | None = None


@dataclass(frozen=True)
class Metrics:
    pass_rate: float = 0.0
    num_samples: int = 0
    mean_quality: float | None = None
    mean_similarity: float | None = None
    diversity_score: float | None = None
    custom_metrics: dict = field(default_factory=dict)

    @property
    def reward(self) -> float:
        return self.pass_rate * (self.mean_quality or 0.0)


@dataclass(frozen=True)
class Feedback:
    """What the bandit knows: counts and rewards by arm, and how much it still explores."""

    generated_so_far: int = 0
    iteration: int = 0
    arm_counts: dict = field(default_factory=dict)
    arm_rewards: dict = field(default_factory=dict)
    exploration_rate: float = 0.5
    state_data: dict = field(default_factory=dict)

    def after(self, arm: str, metrics: Metrics) -> Feedback:
        return replace(
            self,
            iteration=self.iteration + 1,
            generated_so_far=self.generated_so_far + metrics.num_samples,
            arm_counts=self.arm_counts | {arm: self.arm_counts.get(arm, 0) + 1},
            arm_rewards=self.arm_rewards | {arm: [*self.arm_rewards.get(arm, []), metrics.reward]},
        )

    def statistics(self) -> dict[str, dict[str, float]]:
        """Mean, population standard deviation and count of the arms that have rewards."""
        out = {}
        for arm, r in self.arm_rewards.items():
            if r:
                mean = sum(r) / len(r)
                out[arm] = {"mean_reward": mean, "std_reward": (sum((x - mean) ** 2 for x in r) / len(r)) ** 0.5, "count": self.arm_counts.get(arm, 0)}
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def is_batch_input(task_input: Any) -> bool:
    return isinstance(task_input, dict) and "input_file" in task_input


def is_augmentation(task_input: Any) -> bool:
    return isinstance(task_input, dict) and "expected_output" in task_input


def is_generator_kind(name: Any) -> bool:
    return name in {k.value for k in GeneratorKind}


def extract_context(recipe: Recipe) -> Context:
    """What routing may look at. A grammar path or schema that loading added counts as a constraint too."""
    c = recipe.constraints
    return Context(
        domain=recipe.domain,
        task_input=recipe.task_input,
        num_samples=recipe.num_samples,
        progress=Progress(recipe.num_samples),
        constraints=c,
        grammar_path=c.get("grammar_path"),
        complexity_level="simple" if not c else "complex" if len(c) > 3 or "knowledge_base" in c else "medium",
        constraint_count=len(c),
        has_examples="examples" in c,
        has_knowledge_base="knowledge_base" in c,
    )


def original_text(recipe: Recipe) -> str:
    """The text that similarity and entailment compare samples with."""
    task = recipe.task_input
    if is_augmentation(task):
        return str(task.get("original_input", ""))
    if recipe.domain == "task_rewrite":
        examples = recipe.constraints.get("examples")
        if isinstance(examples, list) and examples:
            first = examples[0]
            return str(first.get("input", task) if isinstance(first, dict) else first)
    return str(task)


def model_name(name: str) -> tuple[str, str]:
    """provider/model; the provider is openai where none is named."""
    provider, slash, model = name.partition("/")
    return (provider, model) if slash else ("openai", name)
