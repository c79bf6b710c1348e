"""Two-phase assessment: every sample validator sees every sample; batch validators see the survivors only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import content_hash
from millrace.operators.dedup import commit
from millrace.operators.validators import Deduplication, Validator, Verdict, enabled, judged_scores
from millrace.sources.tables import read_reference
from millrace.spec import Metrics, Recipe


class Orchestrator:
    """Holds the validators of a recipe and the hashes of what it has accepted so far."""

    def __init__(self, spark: SparkSession, config: dict | None, reference: DataFrame | None = None):
        self.spark = spark
        self.validators: list[Validator] = enabled(config)
        self.reference = reference
        self.committed: list[str] = []  # of this run's accepted samples, so as few as the recipe asks for
        for v in self.validators:
            if isinstance(v, Deduplication) and v.config.get("reference_file"):
                self.reference_from(read_reference(spark, v.config["reference_file"]), v.config.get("check_field", "content"))

    @property
    def seen(self) -> DataFrame | None:
        """Every hash that counts as seen: one relation for the reference and one for the run, however many batches there were."""
        own = self.spark.createDataFrame([(h,) for h in self.committed], "content_hash string") if self.committed else None
        if self.reference is None or own is None:
            return own if self.reference is None else self.reference
        return self.reference.select("content_hash").unionByName(own)

    def assess(self, samples: DataFrame, recipe: Recipe) -> tuple[DataFrame, dict[str, Verdict]]:
        """samples (pos, content, metadata, ...) with scores, quality_scores and accepted; and the batch verdicts."""
        out = samples
        names = [v.name for v in self.validators if not v.batch_level]
        for v in self.validators:
            if isinstance(v, Deduplication):
                v.seen = self.seen
            if not v.batch_level:
                out = v.score(out, recipe)
        ok = F.lit(True)
        for n in names:
            ok = ok & F.coalesce(F.col(f"{n}_passed"), F.lit(False))
        out = out.withColumn("sample_ok", ok)
        batch = [v for v in self.validators if v.batch_level]
        verdicts: dict[str, Verdict] = {}
        accepted = F.col("sample_ok")
        if batch:
            survivors = out.where("sample_ok")
            if survivors.limit(1).count():
                verdicts = {v.name: v.judge(survivors, recipe) for v in batch}
        for name, verdict in verdicts.items():
            accepted = accepted & F.lit(verdict.passed)
            if name == "llm_judge":
                scored = judged_scores(out.where("sample_ok"), verdict).select(F.col("pos").alias("_pos"), "llm_judge_score")
                out = out.join(scored, F.col("pos") == F.col("_pos"), "left").drop("_pos")
            else:
                out = out.withColumn(f"{name}_score", F.when(F.col("sample_ok"), verdict.score))
        scores = [F.struct(F.lit(n).alias("k"), F.col(f"{n}_score").cast("double").alias("v")) for n in [*names, *verdicts]]
        entries = F.filter(F.array(*scores), lambda x: x["v"].isNotNull()) if scores else F.array().cast("array<struct<k:string,v:double>>")
        return out.withColumn("accepted", accepted).withColumn("quality_scores", F.map_from_entries(entries)), verdicts

    def remember(self, assessed: DataFrame) -> None:
        """Adds the hashes of accepted samples to the seen ones."""
        if any(isinstance(v, Deduplication) for v in self.validators):
            self.committed += [r["content_hash"] for r in commit(assessed.where("accepted")).collect()]  # one batch: a few hashes

    def reference_from(self, lines: DataFrame, field: str) -> None:
        """Seen hashes from a reference of JSON lines: the top-level ``field`` of each, a text or an object; lines that don't parse and empty fields are skipped."""
        held = F.try_variant_get(F.try_parse_json("value"), f'$["{field}"]', "variant")
        is_object = F.schema_of_variant(held).startswith("OBJECT<")
        found = lines.select(F.when(is_object, F.to_json(held)).otherwise(F.try_variant_get(held, "$", "string")).alias("content"), F.when(is_object, "object").otherwise("text").alias("kind"))
        found = found.where(F.col("content").isNotNull() & ~F.col("content").isin("", "{}"))
        hashed = found.select(content_hash("content", "kind").alias("content_hash")).distinct()
        self.reference = hashed if self.reference is None else self.reference.select("content_hash").unionByName(hashed)


def metrics_of(assessed: DataFrame, verdicts: dict[str, Verdict], quality_from: str = "llm_judge") -> Metrics:
    """Over accepted samples. Quality is the batch's own verdict, the same for each of them."""
    means = [F.avg(F.when(F.col("accepted"), F.col(f"{n}_score"))).alias(n) for n in ("similarity", "diversity") if f"{n}_score" in assessed.columns]
    row = assessed.agg(F.count("*").alias("n"), F.count_if("accepted").alias("ok"), *means).first().asDict()
    if not row["ok"]:
        return Metrics()
    quality = verdicts[quality_from].score if quality_from in verdicts else None
    return Metrics(row["ok"] / row["n"], row["ok"], quality, row.get("similarity"), row.get("diversity"))
