"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Terms are words (runs of letters, lower case) and the first PREFIX letters of longer words. A bounded, documented sample of labelled rows
(MOST_TOXIC and MOST_CLEAN, the least by a hash of the id) are the examples; *all* their terms are indexed. How many documents have each term
is counted over all documents. A term weighs (1 + ln tf) x idf x relevance: FLOOR plus the absolute log odds, among the examples and drawn
towards the base rate by PRIOR, of the class given the term. Plain TF-IDF finds texts of like topic, not of like tone (the README has
figures); no term's weight is 0, so texts that share any term are neighbours.

The index holds terms as postings, and those that are common and light by blocks of examples with each block's largest weight per term. A
query scores its other terms in full and then its light ones by block, in blocks whose largest possible cosine reaches the K-th best
found; so the K nearest examples are exact. Votes weigh by squared cosine and by how many labelled rows an example stands for.
The share of toxic votes is calibrated by a logistic curve that is fitted on a second bounded sample (MOST_CALIBRATION labelled rows, none of
them an example), and the neighbours are the score's evidence. Held-out rows take no part in any of this.

Defined cases: a null or empty text, or one that shares no term with any example, has no neighbours and scores the base rate; null labels
are ignored, repeated labels count once (toxic if any says so); repeated rows get the same score; equal cosines are ranked by the example's
number (class, length, doc_id); without labels of both classes every score is the base rate (0 without labels); an empty table gives an empty result;
extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import forget, materialize, only, table

QUERY = "op3_nearest_examples"

MOST_TOXIC, MOST_CLEAN, MOST_CALIBRATION = 1500, 2500, 2000
PREFIX = 5
PRIOR, FLOOR = 20.0, 0.05
K = 16
BLOCK = 32
FIRST_BLOCKS = 8
#: Terms in more than this share of the examples are common, those of less weight than this are light.
COMMON, LIGHT = 1 / 32, 1.0
QUERIES_AT_ONCE = 128

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters U+00C0 to U+00DE; a space for every byte that is no part of a letter."""
    low = tk.LOWER[raw]
    lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))
    low[lead + 1] += 0x20
    return np.where(_LETTER[low], low, np.uint8(0x20))


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, where each row's terms begin, the distinct term hashes in order, how often each occurs)."""
    data, offsets = tk.buffers(column)
    for a, b in tk.chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        letters = lowered(data[offsets[a] : offsets[b]])
        w = tk.Words(letters, at)
        row = np.repeat(np.arange(b - a), w.count)
        longer = w.end - w.start > PREFIX
        head = w.start[longer]
        h = np.concatenate([tk.span_hashes(letters, w.start, w.end), tk.span_hashes(letters, head, head + PREFIX, seed=1)])
        row = np.concatenate([row, row[longer]])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        yield a, b, np.searchsorted(row[at], np.arange(b - a + 1)), h[at], np.diff(np.append(at, len(h)))


@tk.released
def example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, toxic, text) with the terms and their counts in place of the text."""
    for batch in batches:
        for a, b, at, h, tf in term_counts(batch.column(2)):
            part = [c.slice(a, b - a) for c in batch.columns[:2]]
            raw = [pa.array([x[at[k] : at[k + 1]].tobytes() for k in range(b - a)], pa.binary()) for x in (h, tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*part, *raw], names=["doc_id", "toxic", "terms", "tf"])


def places(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in the vocabulary (sorted), and where."""
    if not len(vocabulary):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return vocabulary[place] == h, place


def document_counts(vocabulary):
    """For mapInArrow over (text): how many texts have each term of the (broadcast) vocabulary, summed over the task."""

    @tk.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, _, h, _ in term_counts(batch.column(0)):
                hit, place = places(known, h)
                n += np.bincount(place[hit], minlength=len(known))
        some = np.flatnonzero(n)
        for a in range(0, len(some), 1 << 16):
            part = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["term", "n"])

    return run


class BlockMaxIndex:
    """Examples as unit vectors over a vocabulary of terms.

    ``weight`` of a term multiplies 1 + ln tf. Most terms have postings (``start``, ``number``, ``value``). Terms that are both common and
    light have a weight for every example, in blocks of BLOCK examples (``dense``: block, term, example), and the largest of each block.
    Examples are numbered by class and length, so that those of a block have weights of like size.
    """

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, toxic: np.ndarray):
        size = len(toxic)
        self.vocabulary, self.weight, self.size = vocabulary, weight.astype(np.float32), size
        self.order = np.lexsort((np.bincount(row, minlength=size), toxic))  # the example that has each number
        named = np.empty(size, np.int32)
        named[self.order] = np.arange(size)
        w = (1 + np.log(tf)) * weight[term]
        w /= np.maximum(np.sqrt(np.bincount(row, w * w, size)), 1e-12)[row]
        row = named[row]
        n = np.bincount(term, minlength=len(vocabulary))
        light = (n > COMMON * size) & (weight < LIGHT)
        self.light = np.where(light, np.cumsum(light) - 1, -1).astype(np.int32)
        self.blocks = max(1, -(-size // BLOCK))
        held = light[term]
        self.dense = np.zeros((self.blocks, int(light.sum()), BLOCK), np.float32)
        self.dense[row[held] // BLOCK, self.light[term[held]], row[held] % BLOCK] = w[held]
        self.largest = self.dense.max(axis=2, initial=0).T.copy()
        rest = np.flatnonzero(~held)
        rest = rest[np.argsort(term[rest], kind="stable")]
        self.number, self.value = row[rest], w[rest].astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(np.where(light, 0, n))])

    def nearest(self, at: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int = K, looked: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms ``at[q]`` to ``at[q + 1]``, places in the vocabulary) its k nearest examples and their cosines, ties by the smaller number.

        ``looked`` gets how many blocks had their light terms scored for each query.
        """
        queries, width = len(at) - 1, self.blocks * BLOCK
        row = np.repeat(np.arange(queries), np.diff(at))
        w = (1 + np.log(tf)) * self.weight[term]
        w /= np.maximum(np.sqrt(np.bincount(row, w * w, queries)), 1e-12)[row]
        light = self.light[term] >= 0
        t = term[~light]
        count = self.start[t + 1] - self.start[t]
        posting = tk.ragged(self.start[t], count)
        cell = np.repeat(row[~light] * width, count) + self.number[posting]
        score = np.bincount(cell, np.repeat(w[~light], count) * self.value[posting], queries * width).reshape(queries, self.blocks, BLOCK)
        own = np.zeros((queries, self.dense.shape[1]), np.float32)
        own[row[light], self.light[term[light]]] = w[light]
        reach = score.max(axis=2) + own @ self.largest + 1e-5
        done = np.zeros(reach.shape, bool)
        # First the blocks of the largest bounds; what they hold raises the bar for all others.
        for first in (True, False):
            if first:
                go = reach >= np.partition(reach, max(0, self.blocks - FIRST_BLOCKS), axis=1)[:, max(0, self.blocks - FIRST_BLOCKS)][:, None]
            else:
                flat = score.reshape(queries, width)
                bar = np.partition(flat, max(0, width - k), axis=1)[:, max(0, width - k)]
                go = (reach >= bar[:, None]) & ~done
            for b in np.flatnonzero(go.any(axis=0)).tolist():
                q = np.flatnonzero(go[:, b])
                score[q, b] += own[q] @ self.dense[b]
            done |= go
        if looked is not None:
            looked += done.sum(axis=1).tolist()
        flat = score.reshape(queries, width)
        bar = np.partition(flat, max(0, width - k), axis=1)[:, max(0, width - k)]
        out = []
        for q in range(queries):  # a block that was not looked at has only examples below the bar
            near = np.flatnonzero((flat[q] >= bar[q] - 1e-6) & (flat[q] > 0))
            top = near[np.lexsort((near, -np.round(flat[q, near], 6)))[:k]]
            out.append((top, flat[q, top]))
        return out

    def find(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(first row, the nearest of it and the following rows) for runs of texts."""
        for a, b, at, h, tf in term_counts(column):
            hit, place = places(self.vocabulary, h)
            at = np.concatenate([[0], np.cumsum(hit)])[at]
            term, tf = place[hit], tf[hit]
            for x in range(0, b - a, QUERIES_AT_ONCE):
                y = min(x + QUERIES_AT_ONCE, b - a)
                part = slice(at[x], at[y])
                yield a + x, self.nearest(at[x : y + 1] - at[x], term[part], tf[part])


class Voter:
    """What is broadcast: the index, what each example stands for, its document, and the base rate. Its size is bounded by the sample's."""

    def __init__(self, index: BlockMaxIndex, toxic: np.ndarray, votes: np.ndarray, documents: np.ndarray, base: float):
        self.index, self.toxic, self.votes, self.documents, self.base = index, toxic, votes, documents, base

    def share(self, near: np.ndarray, cosine: np.ndarray) -> float | None:
        """The toxic share of the neighbours' votes; None without neighbours."""
        v = self.votes[near] * cosine.astype(np.float64) ** 2
        total = float(v.sum())
        return float(v[self.toxic[near]].sum()) / total if total > 0 else None


def vote(voter, keep: list[str]):
    """For mapInArrow over (*keep, text): keep, the toxic share of votes, and the nearest examples' documents."""

    @tk.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voter.value
        for batch in batches:
            for a, found in v.index.find(batch.column(len(keep))):
                own = [c.slice(a, len(found)) for c in batch.columns[: len(keep)]]
                share = pa.array([v.share(*f) for f in found], pa.float64())
                evidence = pa.array([v.documents[f[0][:3]].tolist() for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*own, share, evidence], names=[*keep, "share", "evidence"])

    return run


def held_out(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(labels: DataFrame, most_toxic: int, most_clean: int, most_calibration: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, role) of at most so many example rows (role 0) of either class and rows for calibration (role 1); how many rows of each class there are."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    # One row in five that may be learnt from is for calibration; the least of the hashes are taken of either part.
    role = (F.crc32(F.concat(F.lit("calibration:"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0).cast("int")
    own = own.withColumn("role", role)
    parts = [own.where((F.col("role") == 0) & (F.col("toxic") == y)).orderBy(order, "doc_id").limit(most) for y, most in ((1, most_toxic), (0, most_clean))]
    parts.append(own.where("role = 1").orderBy(order, "doc_id").limit(most_calibration))
    return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "toxicity-sample"), total


def relevance(t: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """How much each term says of the class, from the toxic and all rows that its examples stand for."""
    p = (t + PRIOR * base) / (n + PRIOR)
    return FLOOR + np.abs(np.log(p / (1 - p)) - math.log(base / (1 - base)))


def curve(share: np.ndarray, toxic: np.ndarray, base: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the log odds of a share of votes to a probability, by Newton's steps on a likelihood with a weak
    prior at the curve that changes nothing."""
    x = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3))
    theta = np.array([1.0, 0.0])
    z = np.stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ z, -30, 30)))
        g = z @ (p - toxic) + (theta - [1.0, 0.0])
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + np.eye(2), g)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def calibrated(share: Column, slope: float, offset: float) -> Column:
    p = F.least(F.greatest(share, F.lit(1e-3)), F.lit(1 - 1e-3))
    return 1 / (1 + F.exp(-(F.log(p / (1 - p)) * slope + offset)))


def score_documents(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_calibration: int = MOST_CALIBRATION) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the nearest examples) for every row of docs."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    chosen, total = sample(only(labels, "doc_id", "toxic"), most_toxic, most_clean, most_calibration)
    small = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "toxic", "role"))  # at most the three bounds' sum of rows
    rows = materialize(docs.join(small, F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "role", "text"), "toxicity-rows")
    got = rows.where("role = 0").select("doc_id", "toxic", "text").mapInArrow(example_terms, "doc_id long, toxic int, terms binary, tf binary").toArrow().sort_by("doc_id")
    forget(chosen)
    base = total.get(1, 0) / max(1, total.get(0, 0) + total.get(1, 0))
    toxic = got.column("toxic").to_numpy() == 1
    if not toxic.any() or toxic.all():
        forget(rows)
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(base).alias("score"), F.lit(int(base >= 0.5)).alias("predicted"), F.array().cast("array<bigint>").alias("evidence"))
    sizes = np.array([len(x) // 8 for x in got.column("terms").to_pylist()], np.int64)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    vocabulary, term = np.unique(np.frombuffer(b"".join(got.column("terms").to_pylist()), tk.U64), return_inverse=True)
    term = term.astype(np.int32)
    tf = np.frombuffer(b"".join(got.column("tf").to_pylist()), np.int32)
    documents = got.column("doc_id").to_numpy()
    del got
    known = spark.sparkContext.broadcast(vocabulary)
    counted = docs.select("text").mapInArrow(document_counts(known), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term of the sample
    n_docs = np.zeros(len(vocabulary), np.int64)
    n_docs[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    del counted
    idf = np.log(1 + docs.count() / np.maximum(n_docs, 1))
    votes = np.where(toxic, total.get(1, 0) / toxic.sum(), total.get(0, 0) / (~toxic).sum())
    weight = idf * relevance(np.bincount(term, (votes * toxic)[row], len(vocabulary)), np.bincount(term, votes[row], len(vocabulary)), base)
    index = BlockMaxIndex(vocabulary, weight, row, term, tf, toxic)
    del row, term, tf
    sent = spark.sparkContext.broadcast(Voter(index, toxic[index.order], votes[index.order], documents[index.order], base))
    fitted = rows.where("role = 1").select("toxic", "text").mapInArrow(vote(sent, ["toxic"]), "toxic int, share double, evidence array<long>").where(F.col("share").isNotNull())
    some = fitted.select("toxic", "share").toArrow()  # at most most_calibration documents
    slope, offset = curve(some.column("share").to_numpy(), some.column("toxic").to_numpy(), base)
    forget(rows)
    scored = docs.mapInArrow(vote(sent, ["doc_id"]), "doc_id long, share double, evidence array<long>")
    score = F.when(F.col("share").isNull(), F.lit(base)).otherwise(calibrated(F.col("share"), slope, offset))
    scored = scored.withColumn("score", score)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
