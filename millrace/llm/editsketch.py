"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at step j it emits the character under its pointer and moves on, or not, by a random bit of (j, character)
that all texts share (1 three times in four). Texts a small edit distance apart fall back into step soon after an edit, so edit distance
becomes Hamming distance between the emitted strings. Of these a fingerprint keeps LANES sampled positions, WIDTH for each band: steps are
dealt to bands in turn, in rounds of LANES steps, and a band keeps a byte of each of its emissions in the round that is least, by a random
order that all texts share, among the rounds before the text's end. So positions are sampled alike for texts of every length, texts of like
length sample the same ones, and those of a band lie near each other: where two texts are in step, whole bands agree. The share of equal
lanes, less what chance makes equal, estimates the share of equal positions.

``linked_pairs`` finds near copies: fingerprints are cut into bands of sampled lanes to propose pairs, and proposals are verified by their edit
distance. The query stops at fingerprints and the comparison with the next document, which is all that its result has.

Defined cases: a null text is empty; two empty texts are alike (1.0); characters are code points, each with random bits of its own; the last
document's next is the first; a table of one row is its own next; repeated ids follow each other in order of text; a null doc_id sorts last;
texts of any length are walked to their end; equal bands of several documents are ranked by doc_id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import empty, materialize, only, quantile_ranges, range_of, table
from millrace.llm.jaccardjoin import EDGES, components, few_of_each

QUERY = "op8_edit_embedding"

LANES, WIDTH = 240, 3
BANDS = LANES // WIDTH
SEED = 20240229
#: Rows that a cell of ids aims to hold, and the most cells, which bounds what is broadcast (16 bytes a cell).
ROWS_PER_CELL, MOST_CELLS, RANGES = 100, 1_000_000, 128
CHARS_AT_ONCE = 24_000_000
#: The share of equal lanes from which pairs of a band are verified beyond its star.
LEAST_EQUAL = 0.15


def scattered(x: np.ndarray) -> np.ndarray:
    """32 random bits of each number."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def step_values(first: int, n: int, characters: np.ndarray) -> np.ndarray:
    """32 random bits for each of n steps and each character: the low two say whether the pointer moves, the high eight are what a lane keeps."""
    steps = scattered(np.arange(first, first + n, dtype=np.uint32) * np.uint32(2) + np.uint32(SEED & 0xFFFF))
    return scattered(steps[:, None] ^ scattered(characters.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(SEED))[None, :])


class Order:
    """The shared random order of rounds: ``sampled(first, n)`` says at which of the steps a lane takes a new emission; ``lane`` is a step's."""

    def __init__(self, lanes: int):
        self.lanes, self.bands = lanes, lanes // WIDTH
        self.least = np.full(self.bands, np.iinfo(np.uint64).max, np.uint64)

    def lane(self, step: int) -> int:
        at = step % self.lanes
        return at % self.bands * WIDTH + at // self.bands

    def sampled(self, first: int, n: int) -> np.ndarray:
        """``first`` and n are whole rounds."""
        out = []
        for turn in range(first // self.lanes, (first + n) // self.lanes):
            number = (turn * self.bands + np.arange(self.bands, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
            rank = (scattered(number.astype(np.uint32) ^ np.uint32(0x5BD1E995)).astype(np.uint64) << np.uint64(32)) | np.uint64(turn)
            out.append(np.tile(rank < self.least, WIDTH))
            np.minimum(self.least, rank, out=self.least)
        return np.concatenate(out)


#: Code points there are.
POINTS = 0x110000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(texts: list[str], lanes: int = LANES) -> np.ndarray:
    """The fingerprints (rows x lanes, 8 bits each; 0: the text ends before the lane) of texts, all walked in step until each has reached its end."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    known = np.zeros(POINTS, bool)
    for t in texts:
        known[code_points(t)] = True
    characters = np.flatnonzero(known).astype(np.uint32)
    end = len(characters)
    kind = np.uint16 if end < 65535 else np.uint32
    place = np.zeros(POINTS, kind)
    place[characters] = np.arange(end, dtype=kind)
    # A text at a time: beside what is kept (a small number for each character) only one text is ever held as code points.
    joined = np.full(int(size.sum()) + n, end, kind)
    starts = np.cumsum(size + 1) - size - 1
    for t, begin in zip(texts, starts.tolist(), strict=True):
        joined[begin : begin + len(t)] = place[code_points(t)]
    order = np.argsort(-size, kind="stable")
    at = starts[order]
    kept = np.zeros((lanes, n), np.uint8)
    chars, values, moves = np.empty(n, kind), np.empty(n, np.uint8), np.empty(n, bool)
    active, step, least = int((size > 0).sum()), 0, Order(lanes)
    while active:
        random = step_values(step, lanes, characters)
        move = np.zeros((lanes, end + 1), bool)
        move[:, :end] = (random & np.uint32(3)) != 0
        emit = np.zeros((lanes, end + 1), np.uint8)
        emit[:, :end] = 1 + (random >> np.uint32(24)) % np.uint32(255)
        for j, sample in enumerate(least.sampled(step, lanes)):
            p, c, m = at[:active], chars[:active], moves[:active]
            np.take(joined, p, out=c, mode="clip")
            if sample:
                v = values[:active]
                np.take(emit[j], c, out=v, mode="clip")
                lane = kept[least.lane(step + j), :active]
                np.copyto(lane, v, where=v != 0)
            np.take(move[j], c, out=m, mode="clip")
            np.add(p, m, out=p)
            if j & 63 == 63:
                # Rows are in order of length, so those that have ended are mostly the last; a row at its end changes nothing.
                going = np.flatnonzero(joined[p] != end)
                active = int(going[-1]) + 1 if len(going) else 0
                if not active:
                    break
        step += lanes
    out = np.empty((n, lanes), np.uint8)
    out[order] = kept.T
    return out


def fingerprints(texts: list[str], lanes: int = LANES) -> np.ndarray:
    """Equal texts have equal fingerprints: the walk depends on the text alone, whatever else is in the batch."""
    out = np.empty((len(texts), lanes), np.uint8)
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHARS_AT_ONCE):
            size += len(texts[b])
            b += 1
        out[a:b] = walk(texts[a:b], lanes)
        a = b
    return out


#: Unlike texts emit the same character at a position by chance about so often.
CHANCE = 0.06


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of positions that agree for more than chance.

    A lane is 0 where a text is too short to reach it; lanes that neither text reaches say nothing.
    """
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = np.where(used > 0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(1, used), 1.0)
    return np.clip((same - CHANCE) / (1 - CHANCE), 0, 1)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(lanes: int):
    """For mapInArrow over rows of (cell, own, id, text) sorted by cell, then in order: each own row with the row after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[3])
                if size > CHARS_AT_ONCE // 2:
                    yield finish(rows)
                    rows = rows[-1:]  # it waits for its next
                    size = len(row[3])
        yield finish(rows)

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        first = [k for k in range(len(rows) - 1) if rows[k][1] and rows[k][0] == rows[k + 1][0]]
        texts = [r[3] for r in rows]
        changed = [edited(texts[k], texts[k + 1]) for k in first]
        # Texts and their edited forms are walked together: few long ones then cost one pass over the steps, not two.
        prints = fingerprints(texts + changed, lanes)
        k = np.array(first, np.int64)
        own, nxt, other = prints[k], prints[k + 1], prints[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in first], pa.int64()),
                pa.array([len(texts[k]) for k in first], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([p.tobytes().hex() for p in own], pa.string()),
                pa.array([p.tobytes().hex() for p in other], pa.string()),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, nxt)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return tk.released(run)


def with_next(docs: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """(cell, own, id, text) in which every own row is followed, within its cell, by the document next in descending doc_id.

    Cells are ranges of ids. Each cell also gets one row that isn't its own: the first row of the next lower cell that has any (the lowest
    cell: of the highest). So texts move once, to their cell.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n, hi = d.agg(F.count("*"), F.max("id")).first()
    cells = max(1, min(MOST_CELLS, n // rows_per_cell))
    starts = quantile_ranges(d, "id", min(RANGES, cells)) or [0]
    parts = -(-cells // len(starts))
    # Within a range, parts of equal width: ids that cluster fill a part with a range's rows at most.
    ends = [*starts[1:], (0 if hi is None else hi) + 1]
    number = range_of(F.col("id"), starts)
    begin, width = (F.element_at(F.array(*[F.lit(float(x)) for x in xs]), number.cast("int") + 1) for xs in (starts, [max(1, -(-(e - s) // parts)) for s, e in zip(starts, ends, strict=True)]))
    inside = F.least(F.greatest(F.floor((F.col("id").cast("double") - begin) / width), F.lit(0)), F.lit(parts - 1))
    cell = F.coalesce(number * parts + inside, F.lit(-1).cast("long"))
    # A cell's first row is the one of the largest (id, text); ids tell it unless they repeat.
    tops = d.select(cell.alias("cell"), "id").groupBy("cell").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    w = Window.orderBy("cell")
    ring = tops.select("cell", "top", F.lead("cell").over(w).alias("up"), F.min("cell").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("low"))
    ring = materialize(ring.select(F.col("cell").alias("_cell"), F.col("top").alias("_top"), F.coalesce("up", "low").alias("_to")), "sketch-ring")
    rows = d.select(cell.alias("cell"), "id", "text").join(F.broadcast(ring), F.col("cell") == F.col("_cell"))
    first = F.coalesce(F.col("id") == F.col("_top"), F.col("_top").isNull())
    homes = F.when(first, F.array(F.struct("cell", F.lit(True).alias("own")), F.struct(F.col("_to").alias("cell"), F.lit(False).alias("own")))).otherwise(F.array(F.struct("cell", F.lit(True).alias("own"))))
    spread = rows.select(F.explode(homes).alias("h"), "id", "text").select("h.cell", "h.own", "id", "text")
    return spread.repartition("cell").sortWithinPartitions("cell", F.col("own").desc(), F.col("id").desc_nulls_last(), F.col("text"))


def compare_with_next(docs: DataFrame, lanes: int = LANES, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    return with_next(docs, rows_per_cell).mapInArrow(
        compare(lanes), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


@tk.released
def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            prints = fingerprints([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes().hex() for p in prints])], names=["doc_id", "fingerprint"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""
    return only(docs, "doc_id", "text").mapInArrow(_print_rows, "doc_id long, fingerprint string")


def band_rows(prints: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, band, salt: bands in which a document has no lane say nothing of it."""
    width = 2 * LANES // bands
    found = F.array(*[F.when(F.substring("fingerprint", 1 + k * width, width) != "0" * width, F.concat(F.lit(f"{k}:"), F.substring("fingerprint", 1 + k * width, width))) for k in range(bands)])
    each = prints.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array_compact(found)).alias("band"))
    return each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int"))


def banded_pairs(prints: DataFrame, bands: int = BANDS) -> DataFrame:
    """Pairs (a, b) that share a band: each row of a band with the band's least doc_id, so a large group gives as many pairs as it has rows.

    What a band is told comes by (band, salt), so no task gets all rows of a hot band.
    """
    each = band_rows(prints, bands)
    part = each.groupBy("band", "salt").agg(F.min("doc_id").alias("a"), F.count("*").alias("n"))
    least = part.groupBy("band").agg(F.min("a").alias("a"), F.sum("n").alias("n")).where(F.col("n") > 1).drop("n")
    told = part.select("band", "salt").join(least, "band")
    return each.join(told, ["band", "salt"]).where(F.col("doc_id") != F.col("a")).select("a", F.col("doc_id").alias("b")).distinct()


def edit_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``, else None; a column of differences at a time, as the bits of whole numbers."""
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return max(len(a), len(b))
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for j, c in enumerate(b):
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        score += bool(rise & top) - bool(fall & top)
        if score - (len(b) - j - 1) > most:
            return None
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal & full
    return score if score <= most else None


def verified_pairs(docs: DataFrame, pairs: DataFrame, most: float = 0.2) -> DataFrame:
    """The pairs whose texts are within ``most`` of the longer one's length in edits: a, b, edits."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = edit_distance(x or "", y or "", int(most * max(len(x or ""), len(y or ""))))
                if d is not None:
                    rows.append((a, b, d))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "edits"])

    d = only(docs, "doc_id", "text")
    left, right = d.toDF("a", "text_a"), d.toDF("b", "text_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, edits long")


def band_forest(per: int):
    """For applyInArrow: ``forest_of`` with ``per`` edges."""
    return lambda key, rows, refused: forest_of(rows, refused, per)


def forest_of(rows: pa.Table, refused: pa.Table, per: int = 1) -> pa.Table:
    """A spanning forest of a band's pairs whose components differ and that have LEAST_EQUAL of their lanes in common, without refused ones: (band, a, b) from (band, doc_id, component, fingerprint).
    Where two trees meet, ``per`` edges of a node are proposed instead of one."""
    schema = pa.schema([("band", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
    if rows.num_rows < 2:
        return schema.empty_table()
    node = rows.column("doc_id").to_numpy()
    _, label = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    prints = np.stack([np.frombuffer(bytes.fromhex(x), np.uint8) for x in rows.column("fingerprint").to_pylist()])
    barred: dict[int, list[int]] = {}
    place = {x: k for k, x in enumerate(node.tolist())}
    for x, y in zip(*(refused.column(c).to_pylist() for c in ("a", "b")), strict=True):
        if x in place and y in place:
            i, j = sorted((place[x], place[y]))
            barred.setdefault(i, []).append(j)
    a, b = [], []
    for i in range(len(node) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(other):
            both = prints[other]
            used = ((both != 0) | (prints[i] != 0)).sum(axis=1)
            other = other[((both == prints[i]) & (both != 0)).sum(axis=1) >= LEAST_EQUAL * used]
            other = np.setdiff1d(other, barred.get(i, []))
        if len(other):
            chosen = few_of_each(label[other], per)
            a += [int(node[i])] * len(chosen)
            b += node[other[chosen]].tolist()
            label[np.isin(label, label[other])] = label[i]
    band = rows.column("band")[0].as_py()
    return pa.table([pa.array([band] * len(a), pa.string()), pa.array(np.minimum(a, b) if a else [], pa.int64()), pa.array(np.maximum(a, b) if a else [], pa.int64())], schema=schema)


def linked_pairs(docs: DataFrame, prints: DataFrame, bands: int = BANDS, most: float = 0.2) -> DataFrame:
    """Links (a, b, edits) whose components are those of all pairs that share a band, have LEAST_EQUAL of their lanes in common or stand in a band's star, and are within ``most``.

    The stars of the bands come first. Then, in rounds, each band whose documents are still of several components proposes a spanning forest
    of its pairs, without those refused before, until none is left. What is proposed grows with the rows of a band, not with their square.
    """
    prints = materialize(prints.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]), "sketch-prints")
    links = materialize(verified_pairs(docs, banded_pairs(prints, bands), most), "sketch-links")
    each = materialize(band_rows(prints, bands), "sketch-bands")
    refused = empty(docs.sparkSession, "band string, a long, b long")
    per = EDGES
    while True:  # a round merges components or refuses pairs, of which there are finitely many
        labels = components(links.select("a", "b"))
        named = each.join(labels, F.col("doc_id") == F.col("id"), "left").select("band", "salt", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        part = named.groupBy("band", "salt").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed = part.groupBy("band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo") < F.col("hi")).select("band")
        left = named.join(part.select("band", "salt").join(mixed, "band"), ["band", "salt"]).join(prints, "doc_id").select("band", "doc_id", "component", "fingerprint")
        asked = materialize(left.groupBy("band").cogroup(refused.groupBy("band")).applyInArrow(band_forest(per), "band string, a long, b long"), "sketch-asked")
        if asked.limit(1).count() == 0:
            return links.distinct()
        more = materialize(verified_pairs(docs, asked.select("a", "b").distinct(), most), "sketch-links")
        refused = materialize(refused.unionByName(asked.join(more.select("a", "b"), ["a", "b"], "left_anti")), "sketch-refused")
        links = links.unionByName(more)
        per *= EDGES


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
