"""The adaptive loop: route, generate, assess, learn, collect; one small Spark plan per batch, so plans don't grow with the iterations."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.providers import ChatProvider, OfflineChat
from millrace.operators.bandit import Router
from millrace.operators.generators import generator_for
from millrace.operators.orchestrate import Orchestrator, metrics_of
from millrace.sources.tables import read_batch, row_recipes, write_batch
from millrace.spec import Context, Feedback, Plan, Recipe, extract_context, is_batch_input

log = logging.getLogger(__name__)

RESULT_COLUMNS = ("sample_id", "pos", "content", "content_kind", "metadata", "lineage", "quality_scores")
ROW_COLUMNS = ("row_idx", "iteration", "original_input", "expected_output")


@dataclass
class Result:
    """Accepted and rejected samples, as rows on the driver: a run makes as many as its recipe asks for, a few per model call."""

    spark: SparkSession
    schema: object = None
    accepted: list = field(default_factory=list)
    rejected: list = field(default_factory=list)
    state: Feedback = field(default_factory=Feedback)
    log: list = field(default_factory=list)  # (iteration, arm, reward, pass_rate, mean_quality, num_samples)

    def frame(self, which: str) -> DataFrame:
        return self.spark.createDataFrame(getattr(self, which), self.schema)

    def rewards(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, "iteration int, arm string, reward double, pass_rate double, mean_quality double, num_samples int")


def surplus_order(seed: str):
    """The order in which a surplus is cut: by a hash, so that reruns keep the same samples."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("sample_id")))


class Pipeline:
    def __init__(self, spark: SparkSession, validators: dict | None, router: Router | None = None, chat: Callable[..., ChatProvider] = OfflineChat, reference: DataFrame | None = None, run: str = "run"):
        self.spark, self.router, self.chat, self.run_id = spark, router or Router(), chat, run
        self.orchestrator = Orchestrator(spark, validators, reference)

    def generate(self, context: Context, plan: Plan, row: int) -> DataFrame:
        return generator_for(plan.generator_arm)(self.spark, context, plan, f"{self.run_id}|{row}", self.chat).generate()

    def run(self, recipe: Recipe, state: Feedback | None = None, max_iterations: int = 100) -> Result:
        result = Result(self.spark, state=state or Feedback())
        if not is_batch_input(recipe.task_input):
            self.run_one(recipe, result, max_iterations, 0)
            return result
        # Rows follow each other: what one teaches the bandit, and what it accepted, holds for the next.
        batch = read_batch(self.spark, recipe)
        for idx, own, _, _ in row_recipes(batch, recipe):
            self.run_one(own, result, max_iterations, idx)
        if recipe.output_path and result.schema is not None:
            write_batch(batch, result.frame("accepted"), recipe.output_path)
        return result

    def run_one(self, recipe: Recipe, result: Result, max_iterations: int, row: int) -> None:
        context = extract_context(recipe)
        collected = rejected = 0
        for iteration in range(1, max_iterations + 1):
            if collected >= recipe.num_samples:
                break
            context = context.at(collected, rejected, iteration)
            plan = self.router.route(context, result.state)
            try:
                batch = self.generate(context, plan, row)
            except Exception as e:  # costs the iteration and teaches the bandit nothing
                log.error("generation failed: %s", e)
                continue
            assessed, verdicts = self.orchestrator.assess(batch, recipe)
            assessed = assessed.cache()
            self.orchestrator.remember(assessed)
            metrics = metrics_of(assessed, verdicts)
            result.state = self.router.adapt(result.state.after(plan.generator_arm, metrics), metrics)
            result.log.append((result.state.iteration, plan.generator_arm, float(metrics.reward), float(metrics.pass_rate), metrics.mean_quality, metrics.num_samples))
            task = recipe.task_input if isinstance(recipe.task_input, dict) else {}
            extra = [F.lit(row).cast("long").alias("row_idx"), F.lit(iteration).alias("iteration")]
            extra += [F.lit(None if task.get(k) is None else str(task[k])).cast("string").alias(k) for k in ("original_input", "expected_output")]
            rows = assessed.select(*RESULT_COLUMNS, "accepted", *extra)
            keep = rows.where("accepted").drop("accepted")
            need = recipe.num_samples - collected
            taken = keep.orderBy(surplus_order(f"{self.run_id}|{row}|{iteration}")).limit(need).collect()
            lost = rows.where(~F.col("accepted")).drop("accepted").collect()
            result.schema = result.schema or keep.schema
            result.accepted += taken
            result.rejected += lost
            collected += len(taken)
            rejected += len(lost)
            assessed.unpersist()
