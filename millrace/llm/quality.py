"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each text gives a vector of transformed statistics. Over the documents that pass the base rules the estimator looks, for every (lang, source),
for the three quarters of its rows whose covariance has the least determinant: from several starts (medians and quartiles; SUBSETS random
subsets, by a hash of the vector) it takes concentration steps, in each of which the rows nearest by Mahalanobis distance give the next mean
and covariance. After FIRST_STEPS steps the FINALISTS starts of least determinant go on until no determinant shrinks any more; the least wins. A
step is one aggregation of moments by (group, start, distance bin), summed before the shuffle, so a group that holds a third of all rows is
never gathered in one place, and every row counts.

Every group has its own estimate, whatever its size. The same is estimated for each language and for all rows, and a group's mean and
covariance are drawn towards its language's by PRIOR_ROWS rows, those towards the whole's likewise; so a small group leans on its language
by degrees. A text is an outlier beyond the 99.9 % quantile of the chi-squared distribution, after the usual factor that makes the core's
covariance that of the whole.

Defined cases: a null text has no words (and fails the base rules); null lang or source is a group of its own; repeated rows get the same
verdict; rows in the same distance bin as the last of the core are all in it; extra columns are ignored; an empty table gives an empty
result; where no row passes the base rules there is nothing to judge. Very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textkernel as tk
from millrace.llm.common import forget, materialize, only, table, unwrapped, whole_rows

QUERY = "op10_robust_outliers"

# The base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_other", "n_stutter")
STATS = ("word_length", "symbols", "dup_lines", "repeats", "upper", "other", "stutter")
#: Least standard deviation of each statistic: below it differences are noise, and most texts share one value.
FLOORS = (0.05, 0.05, 0.05, 0.05, 0.04, 0.05, 0.04)
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
CORE = 0.75
# The 75 % and 99.9 % quantiles of the chi-squared distribution with 7 degrees of freedom.
CHI2_CORE = 9.037
CUTOFF = 24.322
SUBSETS, SUBSET_ROWS = 4, 24
FIRST_STEPS, FINALISTS = 2, 2
#: A log determinant that falls by less than this has stopped shrinking.
TOLERANCE = 1e-3
PRIOR_ROWS = 20
BINS_PER_OCTAVE = 16

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in SYMBOLS]] = True
_upper = np.zeros(256, bool)
_upper[ord("A") : ord("Z") + 1] = True
_other = ~tk.SPACE & (np.arange(256) < 128)
_other[[c for c in range(128) if chr(c).isalnum()]] = False


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


def _extra(key: np.ndarray) -> np.ndarray:
    """Whether each value occurred before."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        out[order[1:]] = key[order][1:] == key[order][:-1]
    return out


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in COUNTS}
    for a, b, w in tk.each_chunk(texts):
        rows = np.arange(b - a)
        salt = tk.mix(rows.astype(tk.U64) + tk.U64(1))
        word_row = np.repeat(rows, w.count)
        h = w.hashes()
        out["n_words"][a:b] = w.count
        out["word_chars"][a:b] = tk.sums_by_row(~tk.SPACE[w.data] & ((w.data & 0xC0) != 0x80), w.offsets)
        for name, flags in (("n_symbols", _symbol), ("n_upper", _upper), ("n_other", _other)):
            out[name][a:b] = tk.sums_by_row(flags[w.data], w.offsets)
        first, wh = w.windows(h, WINDOW)
        twice = first[_repeated(wh ^ salt[word_row[first]])]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        out["n_repeat_words"][a:b] = tk.sums_by_row(np.cumsum(cover[:-1]) > 0, w.at)
        stutter = np.zeros(len(h), bool)
        stutter[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
        out["n_stutter"][a:b] = tk.sums_by_row(stutter, w.at)
        breaks = np.flatnonzero(w.data == 10)
        start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
        start = start[start < len(w.data)]
        # A line ends at its line feed or where its row ends, whichever comes first.
        nxt = np.concatenate([breaks, [len(w.data)]])
        row = np.searchsorted(w.offsets, start, "right") - 1
        end = np.minimum(nxt[np.searchsorted(breaks, start)], w.offsets[row + 1])
        worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end, row = start[worded], end[worded], row[worded]
        np.add.at(out["n_lines"][a:b], row, 1)
        np.add.at(out["n_dup_lines"][a:b], row[_extra(tk.span_hashes(w.data, start, end) ^ salt[row])], 1)
    return out


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in COUNTS]))
def count_udf(texts: pa.Array) -> pa.Array:
    got = counts(texts)
    tk.release_sometimes(4)
    return pa.StructArray.from_arrays([pa.array(got[k]) for k in COUNTS], names=list(COUNTS))


# Else a filter on the counts makes them a second time, below the join, by two more Python workers an executor.
count_udf = count_udf.asNondeterministic()


def vector(c: str) -> list[Column]:
    """STATS from the struct of COUNTS named ``c``; the added constants draw short texts towards the middle."""
    n = lambda k: F.col(f"{c}.{k}").cast("double")
    words = n("n_words") + 20
    return [
        F.log((n("word_chars") + 110) / words),
        F.sqrt(n("n_symbols") / words),
        n("n_dup_lines") / (n("n_lines") + 10),
        n("n_repeat_words") / words,
        F.sqrt(n("n_upper") / (n("word_chars") + 110)),
        F.sqrt(n("n_other") / (n("word_chars") + 110)),
        n("n_stutter") / words,
    ]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({f"x{i}": v for i, v in enumerate(vector("c"))})


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m under the precision p (upper triangle)."""
    d = [F.col(f"x{i}") - F.col("m")[i] for i in range(P)]
    terms = [d[i] * d[j] * F.col("p")[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


MATRIX = [PAIRS.index((min(i, j), max(i, j))) for i in range(P) for j in range(P)]
ESTIMATE = "g string, k int, n double, m array<double>, cov array<double>, p array<double>, logdet double, scale double"


def square(upper) -> np.ndarray:
    return np.array(upper, float)[MATRIX].reshape(P, P)


def upper(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in PAIRS]


def _estimates(rows: list[tuple]) -> pa.Table:
    """(g, k, n, mean, covariance, scale) as rows of ESTIMATE."""
    cols = [[r[0] for r in rows], [r[1] for r in rows], [float(r[2]) for r in rows], [[float(x) for x in r[3]] for r in rows], [upper(r[4]) for r in rows]]
    cols += [[upper(np.linalg.inv(r[4])) for r in rows], [float(np.linalg.slogdet(r[4])[1]) for r in rows], [float(r[5]) for r in rows]]
    vectors = pa.list_(pa.float64())
    kinds = (pa.string(), pa.int32(), pa.float64(), vectors, vectors, vectors, pa.float64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in ESTIMATE.split(", ")])


def _middle(table: pa.Table) -> pa.Table:
    """Start 0: medians, and quartile distances as standard deviations, from a group's histogram of each statistic."""
    stat, bins, n = (table.column(c).to_numpy() for c in ("i", "bin", "n"))
    m, cov = np.zeros(P), np.zeros((P, P))
    for i in range(P):
        own = np.flatnonzero(stat == i)
        own = own[np.argsort(bins[own])]
        cum, edge = n[own].cumsum() / n[own].sum(), bins[own] * FLOORS[i] / 4
        q1, m[i], q3 = (edge[np.searchsorted(cum, q)] for q in (0.25, 0.5, 0.75))
        cov[i, i] = max(FLOORS[i], (q3 - q1) / 1.349) ** 2
    return _estimates([(table.column("g")[0].as_py(), 0, n[stat == 0].sum(), m, cov, 1.0)])


def _concentrate(table: pa.Table) -> pa.Table:
    """Mean and covariance of the nearest CORE of a group, from its moments by distance bin; all of it where there are no bins (bin 0 alone)."""
    bins, n = table.column("bin").to_numpy(), table.column("n").to_numpy().astype(float)
    order = np.argsort(bins)
    near = order[: int(np.searchsorted(np.cumsum(n[order]), CORE * n.sum() - 1e-9)) + 1]
    total = n[near].sum()
    mean = lambda c: table.column(c).to_numpy()[near].sum() / total
    m = np.array([mean(f"s{i}") for i in range(P)])
    cov = square([mean(f"q{i}_{j}") - m[i] * m[j] for i, j in PAIRS]) + np.diag(np.square(FLOORS))
    edge = 2.0 ** ((bins[near[-1]] + 1) / BINS_PER_OCTAVE)
    return _estimates([(table.column("g")[0].as_py(), table.column("k")[0].as_py(), n.sum(), m, cov, max(1.0, edge / CHI2_CORE))])


def _drawn(batches):
    """Rows of (lang, source, own, language, whole estimates) as (lang, source, m, p): each drawn towards the next by PRIOR_ROWS rows."""
    for batch in batches:
        means, precisions = [], []
        for own, language, whole in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            m, cov = np.array(whole["m"]), square(whole["cov"]) * whole["scale"]
            for e in (language, own):
                w = e["n"] / (e["n"] + PRIOR_ROWS)
                m, cov = w * np.array(e["m"]) + (1 - w) * m, w * square(e["cov"]) * e["scale"] + (1 - w) * cov
            means.append(m.tolist())
            precisions.append(upper(np.linalg.inv(cov)))
        vectors = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(means, vectors), pa.array(precisions, vectors)], names=["lang", "source", "m", "p"])


#: Parameters of at most so many groups (about 5 kB each while there are several starts) are broadcast; more are joined by a salted key.
MOST_BROADCAST = 2_000
SALTS = 32


def with_group(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """rows left-joined to groups on lang and source; nulls match nulls."""
    g = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[c for c in groups.columns if c not in ("lang", "source")])
    on = rows["lang"].eqNullSafe(g["_l"]) & rows["source"].eqNullSafe(g["_s"])
    if n_groups <= MOST_BROADCAST:
        return rows.join(F.broadcast(g), on, "left").drop("_l", "_s")
    g = g.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_r", F.floor(F.rand(1) * SALTS).cast("int"))
    return rows.join(g, on & (rows["_r"] == g["_salt"]), "left").drop("_l", "_s", "_salt", "_r")


def levels() -> Column:
    """The keys of the groups that a row counts in: its own, its language's, and the whole."""
    return F.array(F.concat(F.lit("s"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("l"), F.to_json(F.struct("lang"))), F.lit("a"))


def drawn_by(k: Column | int) -> Column:
    """A number from 0 to 1 that says whether a vector is in random subset k."""
    return F.pmod(F.xxhash64(*[F.col(f"x{i}") for i in range(P)], F.lit(k) if isinstance(k, int) else k), F.lit(1 << 32)) / float(1 << 32)


def moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in PAIRS]]


def starts(x: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """ESTIMATE rows: start 0 of every group, and the random subsets 1 to SUBSETS."""
    each = x.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") * (4 / FLOORS[i]) + 0.5).alias("bin")) for i in range(P)])).alias("e"))
    hist = each.groupBy("lang", "source", "e.i", "e.bin").agg(F.count("*").alias("n"))
    hist = hist.select(F.explode(levels()).alias("g"), "i", "bin", "n").groupBy("g", "i", "bin").agg(F.sum("n").alias("n"))
    middle = hist.groupBy("g").applyInArrow(_middle, ESTIMATE)
    picks = F.explode(F.sequence(F.lit(1), F.lit(SUBSETS)))
    d = with_group(x, groups, n_groups).select(F.explode("sizes").alias("z"), *[f"x{i}" for i in range(P)]).withColumn("k", picks)
    d = d.where(drawn_by(F.col("k")) * F.col("z.n") < SUBSET_ROWS).withColumn("bin", F.lit(0).cast("long"))
    return middle.unionByName(d.groupBy(F.col("z.g").alias("g"), "k", "bin").agg(*moments()).groupBy("g", "k").applyInArrow(_concentrate, ESTIMATE))


def step(x: DataFrame, groups: DataFrame, n_groups: int, params: DataFrame) -> DataFrame:
    """One concentration step of every group and start."""
    wide = groups.select("lang", "source", F.explode("sizes").alias("z")).select("lang", "source", F.col("z.g").alias("g")).join(params.select("g", "k", "m", "p"), "g")
    wide = materialize(wide.groupBy("lang", "source").agg(F.collect_list(F.struct("g", "k", "m", "p")).alias("e")), "quality-wide")  # three levels of a few starts
    d = with_group(x, wide, n_groups).select(F.explode("e").alias("e"), *[f"x{i}" for i in range(P)]).select("e.*", *[f"x{i}" for i in range(P)])
    d = d.withColumn("bin", F.floor(F.log2(distance() + 2.0**-20) * BINS_PER_OCTAVE))
    return d.groupBy("g", "k", "bin").agg(*moments()).groupBy("g", "k").applyInArrow(_concentrate, ESTIMATE)


def best(params: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("g").orderBy("logdet", "k")
    return params.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def failed() -> Column:
    words, repeated = F.col("c.n_words"), F.col("c.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * words)


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, m, p; how many rows that has) from rows of lang, source and c (the struct of COUNTS)."""
    x = _named(stats.where(~failed())).select("lang", "source", *[f"x{i}" for i in range(P)])
    own = x.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = own.select(F.explode(levels()).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    groups = own.select("lang", "source", F.explode(levels()).alias("g")).join(sizes, "g").groupBy("lang", "source").agg(F.collect_list(F.struct("g", "n")).alias("sizes"))
    groups = materialize(groups, "quality-groups")
    n = groups.count()
    params = materialize(starts(x, groups, n), "quality-starts")
    for _ in range(FIRST_STEPS):
        held, params = params, materialize(step(x, groups, n, params), "quality-step")
        forget(held)
    held, params = params, materialize(best(params, FINALISTS), "quality-finalists")
    forget(held)
    while True:  # determinants only fall, so this ends
        before = params.select("g", "k", *[F.col(c).alias(f"_{c}") for c in params.columns[2:]])
        now = step(x, groups, n, params).join(before, ["g", "k"])
        shrinks = F.col("logdet") < F.col("_logdet") - TOLERANCE
        now = materialize(now.select("g", "k", *[F.when(shrinks, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in params.columns[2:]], shrinks.alias("shrunk")), "quality-step")
        forget(params)
        params = now.drop("shrunk")
        params.materialized_at = now.materialized_at
        if now.where("shrunk").limit(1).count() == 0:
            break
    chosen = best(params, 1).select("g", F.struct("n", "m", "cov", "scale").alias("e"))
    keys = groups.select("lang", "source", levels().alias("g"))
    for k, name in enumerate(("own", "language", "whole")):
        keys = keys.join(chosen.select(F.col("g").alias("_g"), F.col("e").alias(name)), F.col("g")[k] == F.col("_g")).drop("_g")
    return materialize(keys.select("lang", "source", "own", "language", "whole").mapInArrow(_drawn, "lang string, source string, m array<double>, p array<double>"), "quality-fit"), n


def judge(stats: DataFrame, cutoff: float = CUTOFF, params: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``stats`` (with lang, source, c) plus base_failed, outlier_distance (null: nothing to judge by) and kept."""
    fitted, n = params or fit(stats)
    d = _named(with_group(stats, fitted, n)).withColumn("outlier_distance", distance())
    return d.withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("outlier_distance", F.lit(0.0)) <= cutoff)).drop("m", "p", *[f"x{i}" for i in range(P)])


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, "lang", "source", count_udf("text").alias("c"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``documents`` without those that the rules reject; the rows that stay are unchanged."""
    stats = materialize(statistics(docs), "quality")
    params = fit(stats)
    forget(stats)
    rows = whole_rows(docs, lang=F.col("lang"), source=F.col("source"), c=count_udf("text"))
    return unwrapped(judge(rows, params=params).where("kept"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "lang", "source", "text")
    judged = judge(materialize(statistics(docs, "doc_id"), "quality"))
    return judged.select("doc_id", *[f"c.{k}" for k in COUNTS[:5]], "base_failed", "kept", F.round("outlier_distance", 3).alias("outlier_distance"))
