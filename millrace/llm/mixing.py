"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's rows lie in a fixed random order (by a hash of the id) and in blocks of that order (by its first digits). A source's target
in words becomes an exact quota: whole passes over the source, then a prefix of its order, of which the last document is cut so that the
words taken equal the rounded target. The blocks of all passes are the population; a tree splits it among the output shards: each node
draws from a multivariate hypergeometric distribution how many blocks of every source go left, down to single shards. Shards then draw
disjoint consecutive blocks of each source's permuted order, and are shuffled locally by a second hash.

Only one row per source and per (source, block) is ever gathered; prefix sums go through the blocks, so a source that holds a third of all
rows is spread over all its blocks.

Defined cases: null text has size 0; a null source is a source of its own and sorts last; repeated rows are rows like others; sources
without words have target 0; rows of equal hash and size are like one another, so any order of them gives the same mix; texts are read whole,
and only the one document of a source that ends its quota is cut; extra columns are kept by ``mixed_documents`` and ignored elsewhere; an
empty table gives an empty result. The query adds up what the shards drew: words of a block that no shard was given are not taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, only, table, unwrapped

QUERY = "op2_hypergeometric_mix"

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SHARDS = 16
#: Hash blocks of a source: 16 to the power of as many digits as leave about so many rows a block if all rows were of one source.
ROWS_PER_BLOCK = 1000
MOST_DIGITS = 6
SEED = 7
#: The targets of at most so many sources are broadcast (about 200 bytes each).
MOST_BROADCAST = 20_000


# Words, and the places where words end.
WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its first n words."""
    n = n.cast("int")
    return F.array_join(F.slice(F.split(text, WORD_END, n + 1), F.lit(1), n), "")


def local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A small table from the driver, by Arrow: no Python worker takes part."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema))


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: ``share`` of all words by weight, none above ``most`` times its size, the excess reshared by weight.

    Sources reach their limit in the order of limit / weight, so the level that the others share is found in one pass.
    """
    limit = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (limit[i] / weights[i], i))
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        level = left / weight
        if level * weights[i] <= limit[i]:
            for j in order[k:]:
                out[j] = level * weights[j]
            break
        out[i] = float(limit[i])
        left, weight = left - limit[i], weight - weights[i]
    return out


#: numpy draws from populations below this.
LARGEST_POPULATION = 10**9


def drawn(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n drawn without replacement. Larger populations than numpy takes are cut into like slabs, of which each gives its share."""
    total = int(have.sum())
    slabs = -(-total // (LARGEST_POPULATION // 2))
    if slabs <= 1:
        return rng.multivariate_hypergeometric(have, n, method="marginals") if total else have
    out = np.zeros_like(have)
    given = done = 0
    for k in range(slabs):
        slab = have * (k + 1) // slabs - have * k // slabs
        done += int(slab.sum())
        share = n * done // total - given
        given += share
        out += drawn(rng, slab, share)
    return out


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """How many blocks of each source every shard gets (shards x sources); columns add up to the quotas, rows are as even as can be."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = drawn(rng, have, total * (mid - lo) // (hi - lo))
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, np.array(quotas, np.int64))
    return out


def plan_mix(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``sized`` (sk, source, size, u, block and any others) plus source_size, target and draws: an array of (pass, shard, words).

    ``sk`` is the source as a key that is never null. Rows move once, to the task of their (source, block).
    """
    spark = sized.sparkSession
    per_block = materialize(sized.groupBy("sk", "source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    w = Window.partitionBy("sk").orderBy("block")
    laid = per_block.withColumn("block_start", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("index", F.row_number().over(w) - 1)
    totals = per_block.groupBy("sk", "source").agg(F.sum("words").alias("n"), F.count("*").alias("blocks")).collect()  # one row per source
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    plans = []
    for r, size, t in zip(totals, sizes, goal, strict=True):
        whole, rest = divmod(math.floor(t + 0.5), size) if size else (0, 0)
        plans.append((r["sk"], size, t, whole, rest, int(r["blocks"])))
    schema = pa.schema([("sk", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("passes", pa.int64()), ("rest", pa.int64()), ("blocks", pa.int64())])
    hint = F.broadcast if len(plans) <= MOST_BROADCAST else (lambda x: x)
    # The last pass takes the blocks that start before its rest: counted, so that quotas are exact.
    last = laid.join(hint(local_table(spark, plans, schema)), "sk").groupBy("sk").agg(F.count_if(F.col("block_start") < F.col("rest")).alias("k"))
    partial = {r["sk"]: int(r["k"]) for r in last.collect()}
    ends = np.cumsum(split_tree([p[3] * p[5] + partial[p[0]] for p in plans], shards, seed), axis=0)
    known = local_table(spark, [(*p, ends[:, i].tolist()) for i, p in enumerate(plans)], schema.append(pa.field("ends", pa.list_(pa.int64()))))
    blocks = laid.drop("words", "source").join(hint(known), "sk")
    before = Window.partitionBy("sk", "block").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = sized.join(blocks, ["sk", "block"]).withColumn("start", F.col("block_start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    shard = lambda k: F.size(F.filter("ends", lambda e: e <= k * F.col("blocks") + F.col("index")))
    cut = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("size"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda k: F.struct(k.alias("pass"), shard(k).alias("shard"), F.col("size").alias("words")))
    some = F.array(F.struct(F.col("passes").alias("pass"), shard(F.col("passes")).alias("shard"), cut.alias("words")))
    none = F.array().cast("array<struct<pass:bigint,shard:int,words:bigint>>")
    draws = F.concat(F.when(F.col("passes") > 0, full).otherwise(none), F.when(cut > 0, some).otherwise(none))
    return d.withColumn("draws", draws).select(*sized.columns, "source_size", "target", "draws")


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: str | None = None) -> DataFrame:
    """What ``plan_mix`` needs of each row; ``keep`` names a struct with the whole row."""
    source = F.col(f"`{source_col}`")
    u = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))))
    digits = min(MOST_DIGITS, max(2, math.ceil(math.log(max(1, docs.count() / ROWS_PER_BLOCK), 16))))
    d = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        source.alias("source"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("sk"),
        count_words(F.col(f"`{text_col}`")).alias("size"),
        u.alias("u"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(keep)] if keep else []),
    )
    return d.withColumn("block", F.substring("u", 1, digits))


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix as rows of ``documents``: a document taken twice is two rows; one that the last pass cuts keeps its first words.

    Sorted by shard and shuffled within it, so that each output file is a part of a shard in its final order.
    """
    plan = plan_mix(sized_rows(docs, seed=seed, keep="row"), seed=seed, **options)
    taken = plan.select("id", "size", "row", F.explode("draws").alias("d"))
    cut, text = F.col("d.words") < F.col("size"), F.col("row.text")
    taken = taken.withColumn("text", F.when(cut, first_words(text, F.col("d.words"))).otherwise(text))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("d.shard").cast("string"), F.col("d.pass").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    spread = taken.select("row", "text", cut.alias("cut"), F.col("d.shard").alias("shard"), key.alias("key")).repartition("shard", F.substring("key", 1, 4))
    n_chars = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])
    return unwrapped(spread.sortWithinPartitions("shard", "key"), docs.columns, text=F.col("text"), n_chars=n_chars)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(sized_rows(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source")), "mix")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + F.when(d["shard"] < SHARDS, d["words"]).otherwise(0))
    return plan_mix(sized).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / w, r) AS k FROM s),
l AS (SELECT *, CAST({SHARE} * (sum(n) OVER ()) - coalesce(sum({MOST} * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
f AS (SELECT min(k) AS k FROM l WHERE level * w <= {MOST} * n),
t AS (SELECT source, n, CASE WHEN l.k >= coalesce(f.k, 1e18) THEN (SELECT level FROM l l2 WHERE l2.k = f.k) * w ELSE CAST({MOST} * n AS DOUBLE) END AS target FROM l, f),
q AS (SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // n ELSE 0 END AS p, CASE WHEN n > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % n ELSE 0 END AS rest FROM t),
c AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(p * size + least(greatest(rest - start, 0), size) AS BIGINT) AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source"""
