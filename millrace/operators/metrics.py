"""Batch metrics, rewards, and what the bandit learns from them, as aggregations over an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_rate(accepted: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(accepted).cast("double"), F.count("*").cast("double")), F.lit(0.0))


def reward(rate: Column, quality: Column) -> Column:
    """Pass rate times quality, where missing quality counts as 0: with the judge off nothing is rewarded."""
    return rate * F.coalesce(quality, F.lit(0.0))


def batch_metrics(samples: DataFrame, *batch: str, accepted: str = "accepted", quality: str = "quality", similarity: str | None = None, diversity: str | None = None) -> DataFrame:
    """One row per batch: pass_rate, means over accepted samples that have the score, num_samples and reward."""
    ok = F.coalesce(F.col(accepted), F.lit(False))
    mean = lambda c: F.avg(F.when(ok, F.col(c).cast("double"))) if c else F.lit(None).cast("double")
    out = samples.groupBy(*batch).agg(
        mean(similarity).alias("mean_similarity") if similarity else F.first(F.lit(None).cast("double")).alias("mean_similarity"),
        mean(diversity).alias("diversity_score") if diversity else F.first(F.lit(None).cast("double")).alias("diversity_score"),
        mean(quality).alias("mean_quality"),
        pass_rate(ok).alias("pass_rate"),
        F.count_if(ok).alias("num_samples"),
    )
    return out.withColumn("reward", reward(F.col("pass_rate"), F.col("mean_quality")))


def validator_scores(samples: DataFrame, name: str, results: str = "validation_results") -> DataFrame:
    """The scores of one validator; skipped, missing and non-numeric ones drop out."""
    r = F.col(results)[name]
    skipped = F.coalesce(F.try_variant_get(F.try_parse_json(r["metadata"]), "$.skipped", "boolean"), F.lit(False))
    return samples.select(F.when(r.isNotNull() & ~skipped, r["score"].try_cast("double")).alias("score")).where(F.col("score").isNotNull())


def arm_statistics(log: DataFrame, arm: str = "arm", value: str = "reward") -> DataFrame:
    """Mean, population standard deviation and count of each arm with rewards."""
    v = F.col(value).cast("double")
    return log.groupBy(F.col(arm).alias("arm")).agg(F.avg(v).alias("mean_reward"), F.stddev_pop(v).alias("std_reward"), F.count("*").alias("count"))


def arm_counts(log: DataFrame, arm: str = "arm") -> DataFrame:
    return log.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("count"))


def best_arm(statistics: DataFrame, order: dict[str, int]) -> DataFrame:
    """The arm of largest mean reward; of equal ones the first in the arms' own order."""
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return statistics.withColumn("arm_order", place[F.col("arm")]).where(F.col("arm_order").isNotNull()).orderBy(F.desc("mean_reward"), "arm_order").limit(1)


def running_mean(log: DataFrame, arm: str, order: str, value: str) -> DataFrame:
    """Each row with the mean reward its arm had before it."""
    before = Window.partitionBy(arm).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("mean_before", F.avg(F.col(value).cast("double")).over(before))
