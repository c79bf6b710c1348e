"""Deduplication of a stream of samples, in two forms.

``first_seen`` keeps the first sample of each content within a watermark, in one stateful operator. ``commit_batches`` is the exact, unbounded
form: every micro-batch is checked against the hashes that earlier ones committed, and a batch that is replayed after a failure overwrites its own
part of the log, so each sample is accepted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.columns import content_hash


def first_seen(samples: DataFrame, content: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    hashed = samples.withColumn("content_hash", content_hash(content)).withWatermark(event_time, delay)
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


def commit_batches(samples: DataFrame, content: str, order: str, log: str, sink: str, checkpoint: str, accept: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts the query. ``accept`` filters the new samples; only hashes of those it keeps are committed."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy("content_hash").orderBy(order)
        fresh = batch.withColumn("content_hash", content_hash(content)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
        try:
            seen = spark.read.parquet(log).where(F.col("batch") < number).select("content_hash")
        except Exception as e:  # the log does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = spark.createDataFrame([], "content_hash string")
        fresh = fresh.join(seen, "content_hash", "left_anti")
        kept = (accept(fresh) if accept else fresh).persist()
        kept.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        kept.select("content_hash").distinct().write.mode("overwrite").parquet(f"{log}/batch={number}")
        kept.unpersist()

    return samples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reward_windows(events: DataFrame, event_time: str, arm: str, value: str, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean reward and count of each arm in tumbling windows of event time."""
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, width), F.col(arm).alias("arm")).agg(F.avg(value).alias("mean_reward"), F.count("*").alias("count"))
