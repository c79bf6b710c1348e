"""Epsilon-greedy choice between generation arms."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.columns import EPSILON_DECAY, EPSILON_FLOOR
from millrace.spec import Context, Feedback, Metrics, Plan

# The arms and their parameters, in the order that breaks ties.
NAIVE_ARMS = {
    "naive_conservative": {"generator": "naive", "temperature": 0.3, "top_p": 0.8},
    "naive_balanced": {"generator": "naive", "temperature": 0.7, "top_p": 1.0},
    "naive_creative": {"generator": "naive", "temperature": 1.2, "top_p": 1.0},
}
TEMPLATER_ARMS = {
    "templater_conservative": {"generator": "templater", "temperature": 0.7, "max_depth": 8},
    "templater_exploratory": {"generator": "templater", "temperature": 1.2, "max_depth": 12},
    "templater_balanced": {"generator": "templater", "temperature": 0.9, "max_depth": 10},
}


def arms_table(spark: SparkSession) -> DataFrame:
    rows = [(name, a["generator"], k, a["temperature"], a.get("top_p"), a.get("max_depth")) for arms in (NAIVE_ARMS, TEMPLATER_ARMS) for k, (name, a) in enumerate(arms.items())]
    return spark.createDataFrame(rows, "arm string, generator string, arm_order int, temperature double, top_p double, max_depth int")


class AdaptationPolicy:
    def next_rate(self, state: Feedback, metrics: Metrics) -> float:
        raise NotImplementedError


class DecayPolicy(AdaptationPolicy):
    def __init__(self, decay: float = EPSILON_DECAY, floor: float = EPSILON_FLOOR):
        self.decay, self.floor = decay, floor

    def next_rate(self, state: Feedback, metrics: Metrics) -> float:
        return max(self.floor, state.exploration_rate * self.decay)


class StaticPolicy(AdaptationPolicy):
    def next_rate(self, state: Feedback, metrics: Metrics) -> float:
        return state.exploration_rate


class Router:
    """Plans batches. A grammar leaves only the templating arms; without one there are only the direct ones. Draws come from a seeded generator."""

    def __init__(self, batch_size: int = 5, policy: AdaptationPolicy | None = None, seed: int | None = 0):
        self.batch_size, self.policy, self.rng = batch_size, policy or DecayPolicy(), random.Random(seed)

    @staticmethod
    def arms(context: Context) -> dict[str, dict]:
        return TEMPLATER_ARMS if context.grammar_path else NAIVE_ARMS

    def choose(self, arms: list[str], state: Feedback) -> tuple[str, str]:
        means = {a: sum(r) / len(r) for a in arms if (r := state.arm_rewards.get(a))}
        if not means:
            return self.rng.choice(arms), "initial: no arm has been tried"
        draw = self.rng.random()
        if draw < state.exploration_rate:
            return self.rng.choice(arms), f"exploration: {draw:.3f} < {state.exploration_rate:.3f}"
        best = max(means, key=means.get)  # the first of equal means, in the order of the arms
        listed = ", ".join(f"{a}={m:.3f}" for a, m in sorted(means.items(), key=lambda x: -x[1]))
        return best, f"exploitation: {draw:.3f} >= {state.exploration_rate:.3f}; {listed}"

    def route(self, context: Context, state: Feedback) -> Plan:
        arms = self.arms(context)
        arm, why = self.choose(list(arms), state)
        parameters = {k: v for k, v in arms[arm].items() if k != "generator"} | {"domain": context.domain}
        return Plan(self.batch_size, arm, parameters, state.iteration, why)

    def adapt(self, state: Feedback, metrics: Metrics) -> Feedback:
        return replace(state, exploration_rate=self.policy.next_rate(state, metrics))
