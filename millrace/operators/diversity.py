"""Batch diversity: one minus the mean cosine of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, norm, passes


def _sum_squares(vectors: DataFrame, *group: str) -> DataFrame:
    """|sum of unit vectors|^2 of each group, as ``sq``: one row per component, summed before the shuffle."""
    each = vectors.select(*group, "_n", F.posexplode("_v").alias("_k", "_x"))
    sums = each.groupBy(*group, "_k").agg(F.sum(F.try_divide("_x", "_n")).alias("_s"))
    return sums.groupBy(*group).agg(F.sum(F.col("_s") * F.col("_s")).alias("sq"))


def pairwise(vectors: DataFrame, batch: str, order: str, vector: str) -> DataFrame:
    """1 - mean cosine over all pairs of a batch whose ``order`` differs, as a join by i < j has them, without listing the pairs.

    The cosines of all pairs sum to (|S|^2 - sum |S_i|^2) / 2, with S the sum of a batch's unit vectors and S_i that of its rows of one order i
    (a unit vector, where i is alone). So every pair counts, at a cost that grows with the rows. Rows without order or vector are in no pair, a
    null batch has no pairs, and a batch without pairs is 1.0; one with pairs is NaN if a vector has no direction or another size.
    """
    all_rows = vectors.select(F.col(batch).alias("_b"), F.col(order).alias("_i"), as_double(vector).alias("_v"), norm(vector).alias("_n"))
    paired = all_rows.where(F.col("_b").isNotNull() & F.col("_i").isNotNull() & (F.size("_v") > 0))
    sound = F.coalesce((F.col("_n") > 0) & (F.col("_n") < float("inf")), F.lit(False))
    shape = paired.groupBy("_b").agg(F.count("*").alias("n"), F.every(sound).alias("sound"), F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi"))
    # What pairs of one order would add: nothing but 1 a row, unless orders repeat, which ids alone tell.
    twice = vectors.select(F.col(batch).alias("_b"), F.col(order).alias("_i")).dropna().groupBy("_b", "_i").agg(F.count("*").alias("c")).where("c > 1").select("_b", "_i")
    if twice.isEmpty():
        shape = shape.select("*", *[F.lit(0.0).alias(c) for c in ("rows", "squares", "sq_own")])
    else:
        repeated = paired.join(twice, ["_b", "_i"])
        counts = repeated.groupBy("_b", "_i").agg(F.count("*").cast("double").alias("c")).groupBy("_b").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("squares"))
        sums = _sum_squares(repeated, "_b", "_i").groupBy("_b").agg(F.sum("sq").alias("sq_own"))
        shape = shape.join(counts, "_b", "left").join(sums, "_b", "left").fillna(0.0, ["rows", "squares", "sq_own"])
    alone, n = F.col("n") - F.col("rows"), F.col("n").cast("double")
    shape = shape.select("_b", "sound", "lo", "hi", (alone + F.col("sq_own")).alias("own"), (n * n - alone - F.col("squares")).alias("pairs2"))
    found = shape.join(_sum_squares(paired, "_b"), "_b").where("pairs2 > 0")
    mean = F.when(F.col("sound") & (F.col("lo") == F.col("hi")), (F.col("sq") - F.col("own")) / F.col("pairs2")).otherwise(float("nan"))
    batches = all_rows.select("_b").distinct()
    return batches.join(found.select("_b", (1 - mean).alias("d")), "_b", "left").select(F.col("_b").alias(batch), F.coalesce("d", F.lit(1.0)).alias("diversity"))


def closed_form(vectors: DataFrame, batch: str, vector: str) -> DataFrame:
    """The same from the sum of unit vectors: 1 - (|sum|^2 - n) / (n (n - 1)). One row per component, summed before the shuffle.

    A zero vector has no direction, so a batch with one is NaN, as it is by definition; batches of fewer than two are 1.0.
    """
    # The length is taken once per vector, before its components become rows.
    sized = vectors.select(batch, as_double(vector).alias("_v"), norm(vector).alias("_n"))
    each = sized.select(batch, F.when(F.col("_n") > 0, 1).otherwise(0).alias("_ok"), "_n", F.posexplode("_v").alias("k", "x"))
    sums = each.groupBy(batch, "k").agg(F.sum(F.try_divide("x", "_n")).alias("s"), F.count("*").alias("n"), F.min("_ok").alias("ok"))
    total = sums.groupBy(batch).agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"), F.min("ok").alias("ok"))
    return total.select(batch, F.when(F.col("n") < 2, 1.0).when(F.col("ok") == 0, float("nan")).otherwise(F.expr("1 - try_divide(sq - n, CAST(n * (n - 1) AS DOUBLE))")).alias("diversity"))


def gate(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scores.withColumn("passed", passes("diversity", threshold))
