"""Exact deduplication in two scopes: earlier samples of the batch, and samples accepted in earlier batches; and samples that contain reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import content_hash


SALTS = 32


def flag_repeats(samples: DataFrame, value: Column, order: str | list[str], *batch: str, seen: DataFrame | None = None, kind: Column | str | None = None) -> DataFrame:
    """Adds content_hash, duplicate, dedup_score (1.0 or 0.0) and dedup_passed.

    A sample repeats if any earlier one of its batch has the hash, even one that other validators reject, or if ``seen`` has it; ``order`` tells
    samples apart. The first of each hash is a minimum, summed before it is shuffled, of which only hashes that repeat go back to the rows, by
    a salted key: a content that a third of all samples share is in no one task. Seen hashes come in by a join that Catalyst sizes itself;
    nothing here broadcasts a side that grows.
    """
    place = F.struct(*([order] if isinstance(order, str) else order))
    out = samples.withColumn("content_hash", content_hash(value, kind))
    keys = ["content_hash", *batch]
    first = out.select(*keys, place.alias("_place")).groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    out = out.withColumn("_salt", F.pmod(F.xxhash64(place), F.lit(SALTS)).cast("int"))
    on = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(first, on, "left").withColumn("_later", place > F.col("_first")).drop("_salt", "_s", "_first", *[f"_k{i}" for i in range(len(keys))])
    repeats = F.coalesce("_later", F.lit(False))
    if seen is not None:
        known = seen.select("content_hash").distinct().withColumn("_seen", F.lit(True))
        out = out.join(known, "content_hash", "left")
        repeats = repeats | F.coalesce("_seen", F.lit(False))
    out = out.withColumn("duplicate", repeats).withColumn("dedup_score", F.when(F.col("duplicate"), 0.0).otherwise(1.0)).withColumn("dedup_passed", ~F.col("duplicate"))
    return out.drop("_later", "_seen")


def first_of_each(samples: DataFrame, value: Column, order: str) -> DataFrame:
    """The first sample of each value. Catalyst turns the rank filter into a group limit before the shuffle."""
    w = Window.partitionBy(F.col("content_hash")).orderBy(order)
    return samples.withColumn("content_hash", content_hash(value)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def commit(accepted: DataFrame) -> DataFrame:
    """The hashes that accepted samples add to the seen ones."""
    return accepted.select("content_hash").distinct()


def against_reference(samples: DataFrame, reference: DataFrame, value: str, keep: str = "left_anti") -> DataFrame:
    """Samples whose value the reference lacks (left_anti) or has (left_semi)."""
    known = reference.select(content_hash(F.col(value)).alias("content_hash")).distinct()
    return samples.withColumn("content_hash", content_hash(F.col(value))).join(known, "content_hash", keep)


#: The words of an item's key, and the items (and their bytes) up to which they are broadcast.
RUN = 3
BROADCAST_ITEMS, BROADCAST_BYTES = 200_000, 32_000_000


def _run_keys(text: Column, run: int) -> Column:
    """A hash for each place of a text's words where a run begins. The words are the value of a lambda variable: an alias would be split again at every place."""
    return F.transform(F.array(F.split(text, " ")), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, run)])))[0]


def _keyed(texts: DataFrame, run: int) -> DataFrame:
    """(item, key): of the runs of whole words within each item the one that fewest items have, so a common opening is no key."""
    inner = F.slice(_run_keys(F.col("item"), run), F.lit(2), F.col("n") - run - 1)
    each = texts.select("item", F.explode(F.array_distinct(inner)).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("items"))
    return each.join(shared, "key").groupBy("item").agg(F.min(F.struct("items", "key"))["key"].alias("key"))


def containing(samples: DataFrame, order: str, value: str, items: DataFrame, item: str, most: int = BROADCAST_ITEMS) -> DataFrame:
    """(item, n): how many samples contain each different text of ``items``, of those that any does. Samples without ``order`` don't count.

    The first and the last word of an item may be parts of a sample's words, the others are whole: a run of those is its key, sought at every
    place of every sample, and what meets by key is compared by its text. So the work grows with the words of both sides, not with samples
    times items. Few items are broadcast, and a sample's text then stays where it is read; else ids and keys meet first. An item of one or two
    words has no whole word for sure and is compared with every sample.
    """
    d = samples.select(F.col(order).alias("id"), F.col(value).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    texts = items.select(F.col(item).alias("item")).where(F.col("item").isNotNull()).distinct().withColumn("n", F.size(F.split("item", " ")))
    within = F.col("text").contains(F.col("item"))
    kinds = {0: F.col("n") <= 2, 1: F.col("n").between(3, RUN + 1), RUN: F.col("n") > RUN + 1}
    found = texts.agg(F.count("*"), F.sum(F.octet_length("item")), *[F.count_if(c) for c in kinds.values()]).first()
    small = found[0] <= most and (found[1] or 0) <= BROADCAST_BYTES
    near = F.broadcast if small else lambda side: side
    hits = texts.limit(0).select("item")
    for (run, kind), n in zip(kinds.items(), found[2:], strict=True):
        if not n:
            continue
        some = texts.where(kind)
        if run == 0:
            hits = hits.unionByName(d.join(near(some), within).select("item"))
            continue
        keyed = near(_keyed(some, run))
        # The outer form: for the other one the optimiser adds a filter that makes the keys once more.
        places = F.array_distinct(_run_keys(F.col("text"), run)).alias("keys")
        if small:
            met = d.select("text", places).select("text", F.explode_outer("keys").alias("key")).join(keyed, "key")
        else:
            met = d.select("id", places).select("id", F.explode_outer("keys").alias("key")).join(keyed.select("key").distinct(), "key").distinct()
            met = met.join(keyed, "key").join(d, "id")
        hits = hits.unionByName(met.where(within).select("item"))
    return hits.groupBy("item").agg(F.count("*").alias("n"))
