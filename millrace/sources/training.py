"""Accepted samples as the files of a downstream training run, with a description of them. Nothing here starts a run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of 10,000 samples how many are held out to evaluate.
EVALUATED = 1000


def example(text: str, label: str) -> tuple[Column, Column]:
    """The text and the label of a sample: fields of its content where that is an object, else the content and the metadata's field."""
    v = F.when(F.col("content_kind") == "object", F.try_parse_json("content"))
    field = lambda name: F.try_variant_get(v, f'$["{name}"]', "string")
    return F.coalesce(field(text), F.when(v.isNull(), F.col("content"))), F.coalesce(field(label), F.col("metadata")[label])


def write_training_files(samples: DataFrame, at: str, text: str = "text", label: str = "label", evaluated: int = EVALUATED) -> dict:
    """Writes ``train`` and ``evaluate`` below ``at`` (JSON lines of text and label; samples without either are left out) and ``about``, which is returned.

    A sample's part is told by a hash of its id, so it stays the same on every run and however many samples there are.
    """
    shown, named = example(text, label)
    part = F.when(F.pmod(F.xxhash64("sample_id"), F.lit(10_000)) < evaluated, "evaluate").otherwise("train")
    rows = samples.select(shown.alias("text"), named.alias("label"), part.alias("part")).where(F.col("text").isNotNull() & F.col("label").isNotNull())
    for name in ("train", "evaluate"):
        rows.where(F.col("part") == name).select("text", "label").write.mode("overwrite").json(f"{at}/{name}")
    counted = rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()  # one row a label
    about = {name: {"path": f"{at}/{name}", "rows": sum(r["n"] for r in counted if r["part"] == name), "labels": {r["label"]: r["n"] for r in counted if r["part"] == name}} for name in ("train", "evaluate")}
    samples.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/about")
    return about
