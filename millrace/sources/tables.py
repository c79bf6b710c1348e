"""Tables of input rows, and what is written back: CSV and JSON lines, plus any format that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import row_quota
from millrace.spec import Recipe, is_batch_input

# Formats by suffix.
FORMATS = {".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl"}


@dataclass(frozen=True)
class BatchInput:
    format: str
    rows: DataFrame  # row_idx, then the table's own columns
    input_field: str
    output_field: str


def detect_format(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no batch format has the suffix {suffix!r}")
    return FORMATS[suffix]


def numbered(df: DataFrame) -> DataFrame:
    """row_idx from 0 in the order of the file; the numbers of partitions are made consecutive by their sizes."""
    from pyspark.sql import Window

    tagged = df.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"), "*")
    sizes = tagged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return tagged.join(starts, "_p").select((F.col("_start") + F.col("_m") - F.col("_first")).alias("row_idx"), *df.columns)


def ordered_index(df: DataFrame, key: str, name: str = "row_idx", ranges: int = 64) -> DataFrame:
    """Adds ``name``: the place of each row in the order of ``key``, from 0; nulls come first.

    Rows are ranked within quantile ranges of the key, and ranges start where the rows before them end, so no task sorts all rows.
    """
    from pyspark.sql import Window

    cuts = sorted(set(df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []))
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    placed = df.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(held, lambda c: c <= F.col(key)))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + rank).drop("_range", "_start")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Objects as read by Spark; blank lines are skipped, and the first line that isn't JSON is an error that names its number."""
    lines = numbered(spark.read.text(path)).where(F.trim("value") != "")
    bad = lines.where(F.try_parse_json("value").isNull()).agg(F.min("row_idx")).first()[0]
    if bad is not None:
        raise ValueError(f"line {bad + 1} of {path} is not JSON")
    return spark.read.json(path)


def missing_anywhere(spark: SparkSession, path: str, fields: list[str]) -> str | None:
    """A field that some line lacks."""
    v = F.try_parse_json("value")
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = lines.agg(*[F.count_if(F.try_variant_get(v, f'$["{f}"]', "variant").isNull()).alias(f"m{k}") for k, f in enumerate(fields)]).first()
    return next((f for k, f in enumerate(fields) if row[f"m{k}"]), None)


def read_batch(spark: SparkSession, recipe: Recipe) -> BatchInput:
    if not is_batch_input(recipe.task_input):
        raise ValueError("batch input needs a task_input with input_file")
    task = recipe.task_input
    path, need = str(task["input_file"]), [task["input_column"], task["output_column"]]
    kind = detect_format(path)
    if kind == "csv":
        rows = read_csv(spark, path)
        lacking = next((f for f in need if f not in rows.columns), None)
        if lacking is not None:
            raise ValueError(f"the CSV has no column {lacking!r}")
    else:
        rows = read_json_lines(spark, path)
        lacking = missing_anywhere(spark, path, need)
        if lacking is not None:
            raise ValueError(f"not every line has the field {lacking!r}")
    return BatchInput(kind, numbered(rows), *need)


def with_quotas(rows: DataFrame, total: int) -> DataFrame:
    """Rows that get samples, with how many."""
    n = rows.count()
    if not n:
        raise ValueError("batch input needs at least one row")
    return rows.withColumn("quota", row_quota("row_idx", n, total)).where("quota > 0")


def row_recipes(batch: BatchInput, recipe: Recipe) -> Iterator[tuple[int, Recipe, int, dict]]:
    """A recipe for each row, in order; rows stream to the driver, which runs one loop for each."""
    task = recipe.task_input
    for row in with_quotas(batch.rows, recipe.num_samples).orderBy("row_idx").toLocalIterator():
        own = row.asDict(recursive=True)
        idx, quota = own.pop("row_idx"), own.pop("quota")
        new = {"original_input": own[batch.input_field], "expected_output": own[batch.output_field], "task_description": task.get("task_description", "")}
        new |= {k: task[k] for k in ("context", "examples") if task.get(k)}
        yield idx, Recipe(recipe.domain, new, quota, recipe.constraints), quota, own


def sample_records(samples: DataFrame) -> DataFrame:
    """The exported form of samples: id, content (an object where it is one), lineage, metadata, quality_scores; one JSON text a row."""
    lineage = F.struct(F.col("lineage.num_of_evolutions"), F.col("lineage.generator"), F.try_parse_json("lineage.generator_parameters").alias("generator_parameters"))
    content = F.when(F.col("content_kind") == "object", F.try_parse_json("content")).otherwise(F.parse_json(F.to_json(F.array("content"))))
    content = F.when(F.col("content_kind") == "object", content).otherwise(F.try_variant_get(content, "$[0]", "variant"))
    return samples.select(F.to_json(F.struct(F.col("sample_id").alias("id"), content.alias("content"), lineage.alias("lineage"), "metadata", "quality_scores")).alias("value"))


def metadata_record(samples: DataFrame) -> DataFrame:
    """Adds ``record``: what batch outputs keep about a sample."""
    lineage = F.struct(
        F.col("lineage.generator"), F.col("lineage.generator_parameters"), F.col("lineage.original_sample"), F.col("lineage.parent_id"), F.col("lineage.num_of_evolutions")
    )
    return samples.withColumn("record", F.struct("original_input", "expected_output", lineage.alias("lineage"), "quality_scores", F.col("metadata")["timestamp"].alias("timestamp")))


def write_batch(batch: BatchInput, accepted: DataFrame, path: str) -> None:
    """Accepted samples (with row_idx) joined back to their rows, in the format of the input: uuid, the row with the input replaced by the
    content, and the metadata, which CSV holds as JSON text."""
    own = [c for c in batch.rows.columns if c != "row_idx"]
    joined = metadata_record(accepted).join(batch.rows.withColumnRenamed("row_idx", "_row"), F.col("row_idx") == F.col("_row"))
    joined = joined.orderBy("row_idx", "pos")
    content = [F.col("content").alias(c) if c == batch.input_field else F.col(f"`{c}`") for c in own]
    if batch.format == "csv":
        joined.select(F.col("sample_id").alias("uuid"), *content, F.to_json("record").alias("metadata")).write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        joined.select(F.to_json(F.struct(F.col("sample_id").alias("uuid"), *content, F.col("record").alias("metadata"))).alias("value")).write.mode("overwrite").text(path)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a reference for deduplication; a path that doesn't exist is an empty one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path)
