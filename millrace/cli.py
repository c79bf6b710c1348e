"""python -m millrace.cli --config RECIPE [--output DIR] [--batch-size N] [--save-state]"""

from __future__ import annotations

import argparse
import logging
import os
from pathlib import Path

from pyspark.sql import SparkSession

from millrace.functions.providers import HostedChat, OfflineChat
from millrace.loop import Pipeline, Result
from millrace.operators.bandit import Router
from millrace.sources.recipes import load_recipe
from millrace.sources.tables import sample_records

SHOWN = 3


def load_environment(path: str = ".env") -> None:
    """NAME=value lines of a file into the environment, where they aren't set already."""
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("'\""))


def write_lines(result: Result, which: str, path: Path) -> int:
    rows = getattr(result, which)
    texts = [r["value"] for r in sample_records(result.frame(which)).toLocalIterator()] if rows else []
    path.write_text("".join(t + "\n" for t in texts), encoding="utf-8")
    return len(texts)


def report(result: Result) -> list[str]:
    lines = [f"accepted {len(result.accepted)}, rejected {len(result.rejected)}, iterations {result.state.iteration}, exploration rate {result.state.exploration_rate:.3f}"]
    lines += [f"  {arm}: mean reward {s['mean_reward']:.3f}, count {s['count']}" for arm, s in result.state.statistics().items()]
    lines += [f"  sample {k}: {r['content']} {r['quality_scores']}" for k, r in enumerate(result.accepted[:SHOWN], 1)]
    return lines


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Result:
    parser = argparse.ArgumentParser(prog="millrace", description="Generate and curate samples with adaptive feedback.")
    parser.add_argument("--config", type=Path, required=True)
    parser.add_argument("--output", type=Path)
    parser.add_argument("--batch-size", type=int, default=5)
    parser.add_argument("--save-state", action="store_true")
    parser.add_argument("--provider", choices=("offline", "openai"), default="offline")
    parser.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    load_environment()
    recipe = load_recipe(args.config)
    spark = spark or SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()
    pipeline = Pipeline(spark, recipe.validators, Router(args.batch_size, seed=args.seed), OfflineChat if args.provider == "offline" else HostedChat)
    result = pipeline.run(recipe)
    print("\n".join(report(result)))
    if args.output:
        args.output.mkdir(parents=True, exist_ok=True)
        for which in ("accepted", "rejected"):
            write_lines(result, which, args.output / f"{which}_samples.jsonl")
        if args.save_state:
            (args.output / "feedback_state.json").write_text(result.state.to_json(), encoding="utf-8")
    return result


if __name__ == "__main__":
    main()
