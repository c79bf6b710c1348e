"""Substring dedup over a log-structured fingerprint index.

A window is WINDOW consecutive words. Its fingerprint is the least hash among its shingles of ANCHOR words, so equal windows have equal
fingerprints, and neighbouring windows mostly share one: there are about an eighth as many fingerprints as windows.

The index is a folder that outlives the session: a store of texts, bucketed by the task that wrote them and in cells of bounded bytes; sorted
immutable runs of historical fingerprints, bucketed by fingerprint; and numbered manifests, of which the last says what holds. Ingesting a batch

1. appends its texts to the store (they never move again);
2. merge-joins its fingerprints, shuffled once to the runs' buckets, with each run where that lies, and with themselves;
3. verifies what met: the batch's cells, and of earlier documents only those whose fingerprints met, hash the whole windows behind them.
   Earlier documents are read from their buckets, they are not shuffled;
4. removes the windows that history has or that a smaller doc_id of the batch has, cell by cell;
5. writes a run of the fingerprints of first occurrences only (whoever repeats a window adds nothing to the index) and a new manifest; above
   FANOUT runs, all are compacted into one.

A window is compared by its fingerprint and its own hash, 128 bits in all. A cell says a fingerprint or window once, however many of its
documents have it, so a passage that a third of all documents share costs one row per cell, none of which is gathered: joins and windows over
a fingerprint spill.

Defined cases: a null or empty text has no words; rows of one doc_id are not earlier than each other (each still loses its own repeats); a
null doc_id counts as smaller than all; what an earlier batch has is earlier, whatever its ids; repeated rows give equal results; extra
columns are ignored; an empty table gives an empty result; texts of any length are read whole, one that fills a cell is a cell of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import delete, materialize, only, partitions, quantile_ranges, read_small, shared_dir, table, write_small

QUERY = "op7_window_index"

WINDOW, ANCHOR = 20, 6
#: A cell has so many rows at most where they are short, and a quarter as many for each step of four in length above SHORT bytes.
ROWS_PER_CELL, SHORT, STEPS = 1500, 1 << 14, 6
FANOUT = 2
FLUSH = 1_000_000
BATCHES = 4
LEAST = -(1 << 63)
PLACE = "part long, cell long"


def windows(w: tk.Words, anchors: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and fingerprint of each window."""
    h = w.hashes()
    first, wh = w.windows(h, WINDOW)
    if not anchors or not len(first):
        return first, wh, wh[:0]
    at, g = w.windows(h, ANCHOR)
    least = np.full(len(h), np.iinfo(np.uint64).max, tk.U64)
    least[at] = g
    span, width = WINDOW - ANCHOR + 1, 1
    while 2 * width <= span:  # least of 1, 2, 4, ... shingles in a row
        np.minimum(least[:-width], least[width:], out=least[:-width])
        width *= 2
    return first, wh, np.minimum(least[first], least[first + span - width])


def per_window(column: pa.Array, anchors: bool = True) -> Iterator[tuple[int, tk.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the words, and of each window the row, the first word, hash and fingerprint."""
    for a, b, w in tk.each_chunk(column):
        first, wh, fp = windows(w, anchors)
        row = np.repeat(np.arange(b - a), np.maximum(w.count - WINDOW + 1, 0))
        yield a, w, row, first, wh, fp


@tk.released
def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (part, cell, text) as (fp, part, cell), distinct within every FLUSH of them."""
    found: list[tuple[np.ndarray, ...]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        fp, part, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((part, cell, fp))
        fp, part, cell = fp[order], part[order], cell[order]
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
        return pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(part[new]), pa.array(cell[new])], names=["fp", "part", "cell"])

    for batch in batches:
        parts, cells = (batch.column(k).to_numpy() for k in (0, 1))
        for a, _, row, _, _, fp in per_window(batch.column(2)):
            change = turns(fp, row)
            found.append((fp[change], parts[a + row[change]], cells[a + row[change]]))
            held += int(change.sum())
            if held > FLUSH:
                yield flush()
                held = 0
    if found:
        yield flush()


def turns(fp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a fingerprint differs from the one of the window before."""
    change = np.ones(len(fp), bool)
    change[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
    return change


def inside(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    near = np.zeros(1 << 18, bool)
    near[(known >> tk.U64(46)).astype(np.int64)] = True
    out = near[(values >> tk.U64(46)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
    out[at] = known[place] == values[at]
    return out


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(LEAST).to_numpy()


def unsigned(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().view(tk.U64) if table.num_rows else np.zeros(0, tk.U64)


VERIFIED = f"fp long, h long, {PLACE}, low long"


def verify_cell(key: tuple, texts: pa.Table, shared: pa.Table) -> pa.Table:
    """A cell's windows behind shared fingerprints: (fp, h, part, cell, least doc_id that has it here)."""
    schema = pa.schema([(x, pa.int64()) for x in ("fp", "h", "part", "cell", "low")])
    if not shared.num_rows or not texts.num_rows:
        return schema.empty_table()
    tk.release_sometimes()
    known = np.sort(unsigned(shared, "fp"))
    ids, fps, hs, low = ids_of(texts), [], [], []
    for a, _, row, _, wh, fp in per_window(texts.column("text")):
        hit = inside(fp, known)
        fps.append(fp[hit])
        hs.append(wh[hit])
        low.append(ids[a + row[hit]])
    f, h, d = np.concatenate(fps), np.concatenate(hs), np.concatenate(low)
    order = np.lexsort((d, h, f))
    f, h, d = f[order], h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
    place = [pa.array(np.full(int(first.sum()), texts.column(x)[0].as_py(), np.int64)) for x in ("part", "cell")]
    return pa.table([pa.array(f[first].view(np.int64)), pa.array(h[first].view(np.int64)), *place, pa.array(d[first])], schema=schema)


STRIPPED = f"doc_id long, n_words long, n_removed long, kept_sha256 string, {PLACE}, rid long, fps binary"


def strip_cell(key: tuple, texts: pa.Table, lost: pa.Table) -> pa.Table:
    """A cell's documents without the windows lost to other cells and those that occur earlier in this one; and the fingerprints of the windows that stay."""
    kinds = {"kept_sha256": pa.string(), "fps": pa.binary()}
    schema = pa.schema([(x, kinds.get(x, pa.int64())) for x in (y.split(" ")[0] for y in STRIPPED.split(", "))])
    if not texts.num_rows:
        return schema.empty_table()
    tk.release_sometimes()
    texts = texts.take(np.argsort(ids_of(texts), kind="stable"))
    ids, column = ids_of(texts), texts.column("text").combine_chunks()
    hashes, prints, rows = [], [], []
    counts = np.zeros(len(ids), np.int64)
    for a, w, row, _, wh, fp in per_window(column):
        hashes.append(wh)
        prints.append(fp)
        rows.append(a + row)
        counts[a : a + len(w.count)] = w.count
    h, fp, row = np.concatenate(hashes), np.concatenate(prints), np.concatenate(rows)
    remove = np.zeros(len(h), bool)
    if lost.num_rows:
        gone_h, gone_fp = unsigned(lost, "h"), unsigned(lost, "fp")
        order = np.argsort(gone_h)
        gone_h, gone_fp = gone_h[order], gone_fp[order]
        at = np.flatnonzero(inside(h, gone_h))
        remove[at] = gone_fp[np.searchsorted(gone_h, h[at])] == fp[at]
    order = np.lexsort((fp, h))  # stable, and rows are in order of doc_id: the first of equal windows is the earliest
    hs, fs, rs = h[order], fp[order], row[order]
    start = np.ones(len(hs), bool)
    start[1:] = (hs[1:] != hs[:-1]) | (fs[1:] != fs[:-1])
    first_of = np.flatnonzero(start)[np.cumsum(start) - 1] if len(hs) else np.zeros(0, np.int64)
    again = np.zeros(len(hs), bool)
    again[1:] = ~start[1:] & (rs[1:] == rs[:-1])
    remove[order] |= again | (ids[rs] > ids[rs[first_of]])
    # Word k of a row with n words has number at[row] + k; its windows start at numbers of their own, WINDOW - 1 fewer a row.
    at = np.cumsum(counts) - counts
    n_windows = np.maximum(counts - WINDOW + 1, 0)
    first_word = tk.ragged(at, n_windows)[remove]
    cover = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(cover, first_word, 1)
    np.add.at(cover, first_word + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    ends = np.append(at, len(covered))
    removed = tk.sums_by_row(covered, ends)
    data, offsets = tk.buffers(column)
    shas = []
    for k in range(len(ids)):
        words = data[offsets[k] : offsets[k + 1]].tobytes().split()
        if removed[k]:
            words = [x for x, c in zip(words, covered[ends[k] : ends[k + 1]].tolist(), strict=True) if not c]
        shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
    stay = ~remove
    new = turns(fp[stay], row[stay])
    own, of = fp[stay][new], row[stay][new]
    begin = np.searchsorted(of, np.arange(len(ids) + 1))
    fps = [own[begin[k] : begin[k + 1]].tobytes() for k in range(len(ids))]
    same = [texts.column(x).combine_chunks() for x in ("part", "cell", "rid")]
    return pa.table([texts.column("doc_id").combine_chunks(), pa.array(counts), pa.array(removed), pa.array(shas, pa.string()), *same, pa.array(fps, pa.binary())], schema=schema)


@tk.released
def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (part, cell, rid, fps) as a run's rows."""
    for batch in batches:
        raw = batch.column(3).to_pylist()
        fp = np.frombuffer(b"".join(raw), np.int64)
        row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
        yield pa.RecordBatch.from_arrays([pa.array(fp), *[batch.column(k).take(pa.array(row)) for k in range(3)]], names=["fp", "part", "cell", "rid"])


def placed(batch: DataFrame, number: int) -> DataFrame:
    """(part, cell, rid, doc_id, text): where each row of a batch lies. No row moves: a part is what one task reads."""
    at = F.monotonically_increasing_id()
    row = at.bitwiseAND(F.lit((1 << 33) - 1))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    step = F.least(F.greatest(F.ceil(F.log2(size / SHORT + 1e-9) / 2), F.lit(0)), F.lit(STEPS)).cast("long")
    rows = F.greatest(F.floor(F.lit(ROWS_PER_CELL) / F.pow(F.lit(4.0), step)), F.lit(1)).cast("long")
    part = F.lit(number << 32).cast("long") + F.shiftright(at, 33)
    return batch.select(part.alias("part"), (step * (1 << 40) + F.floor(row / rows)).alias("cell"), row.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


class WindowIndex:
    """The index in a folder. Opening one reads its last manifest; nothing else is kept between sessions."""

    TEXTS = f"{PLACE}, rid long, doc_id long, text string"
    RUN = f"fp long, {PLACE}, rid long"

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark = spark
        self.at = at or f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
        self.name = f"millrace_{uuid.uuid4().hex}"
        # Rows of a part lie together, so they can be grouped by part and cell where they are.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        found = read_small(spark, f"{self.at}/manifests")
        self.state = json.loads(found[-1][1]) if found else {"version": 0, "batches": 0, "buckets": partitions(spark), "runs": []}
        self.define("texts", self.TEXTS, "part", f"{self.at}/texts")
        for run in self.state["runs"]:
            self.define(run, self.RUN, "fp", f"{self.at}/{run}")

    def table(self, kind: str) -> str:
        return f"{self.name}_{kind.replace('-', '_')}"

    def define(self, kind: str, columns: str, by: str, at: str) -> None:
        order = " SORTED BY (fp)" if by == "fp" else ""
        self.spark.sql(f"CREATE TABLE {self.table(kind)} ({columns}) USING parquet CLUSTERED BY ({by}){order} INTO {self.state['buckets']} BUCKETS LOCATION '{at}'")

    def append(self, rows: DataFrame, kind: str, by: str) -> None:
        w = rows.write.mode("append").format("parquet").bucketBy(self.state["buckets"], by)
        (w.sortBy("fp") if by == "fp" else w).saveAsTable(self.table(kind))
        self.spark.catalog.refreshTable(self.table(kind))

    def write_run(self, rows: DataFrame) -> str:
        run = f"run-{self.state['version']}-{uuid.uuid4().hex[:8]}"
        self.define(run, self.RUN, "fp", f"{self.at}/{run}")
        self.append(rows.repartition(self.state["buckets"], "fp"), run, "fp")
        return run

    def commit(self, **changes) -> None:
        self.state = self.state | changes | {"version": self.state["version"] + 1}
        write_small(self.spark, f"{self.at}/manifests", f"{self.state['version']:09d}.json", json.dumps(self.state))

    def drop(self) -> None:
        """The index and its folder go; results of earlier ingests don't read them."""
        for kind in ("texts", *self.state["runs"]):
            self.spark.sql(f"DROP TABLE {self.table(kind)}")
        delete(self.spark, self.at)

    def texts(self) -> DataFrame:
        return self.spark.table(self.table("texts"))

    def batch_of(self, part: str = "part") -> Column:
        return F.shiftright(F.col(part), 32)

    def compact(self) -> None:
        """All runs as one. A manifest that names the new run comes before the old ones go."""
        old = self.state["runs"]
        merged = self.spark.table(self.table(old[0]))
        for run in old[1:]:
            merged = merged.unionByName(self.spark.table(self.table(run)))
        self.commit(runs=[self.write_run(merged)])
        for run in old:
            self.spark.sql(f"DROP TABLE {self.table(run)}")
            delete(self.spark, f"{self.at}/{run}")

    def meetings(self, number: int) -> tuple[DataFrame, DataFrame | None]:
        """The batch's (fp, part, cell) that history or another of its cells has too; history's (fp, part, cell, rid) that the batch has too."""
        fresh = self.texts().where(self.batch_of() == number).select("part", "cell", "text").mapInArrow(fingerprint_rows, f"fp long, {PLACE}").repartition(self.state["buckets"], "fp")
        twice = fresh.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
        mine, theirs = fresh.join(twice.hint("merge"), "fp", "left_semi"), None
        for run in self.state["runs"]:
            history = self.spark.table(self.table(run))
            mine = mine.unionByName(fresh.join(history.hint("merge"), "fp", "left_semi"))
            met = history.join(fresh.hint("merge"), "fp", "left_semi")
            theirs = met if theirs is None else theirs.unionByName(met)
        return mine, theirs

    def verified(self, number: int) -> tuple[DataFrame, DataFrame | None]:
        """Windows behind fingerprints that met: of the batch's cells, and of the earlier documents that hold one of them."""
        mine, theirs = self.meetings(number)
        place = ["part", "cell"]
        fresh = self.texts().where(self.batch_of() == number)
        new = fresh.groupBy(*place).cogroup(mine.groupBy(*place)).applyInArrow(verify_cell, VERIFIED)
        if theirs is None:
            return new, None
        theirs = theirs.repartition(self.state["buckets"], "part")
        # Of the history only documents whose fingerprints met go on; the store is read where it lies.
        held = self.texts().where(self.batch_of() < number).join(theirs.select(*place, "rid").distinct().hint("merge"), [*place, "rid"], "left_semi")
        return new, held.groupBy(*place).cogroup(theirs.select("fp", *place).groupBy(*place)).applyInArrow(verify_cell, VERIFIED)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Adds a batch: doc_id, n_words, n_removed, kept_sha256 of its rows."""
        number = self.state["batches"]
        self.commit(batches=number + 1)  # a batch that fails leaves its number unused, and its rows out of every run
        self.append(placed(only(batch, "doc_id", "text"), number), "texts", "part")
        new, old = self.verified(number)
        rows = new.withColumn("new", F.lit(True))
        if old is not None:
            rows = rows.unionByName(old.withColumn("new", F.lit(False)))
        same = W.partitionBy("fp", "h")
        told = rows.withColumn("least", F.min("low").over(same)).withColumn("history", F.min("new").over(same) == F.lit(False))
        lost = told.where(F.col("new") & (F.col("history") | (F.col("low") > F.col("least")))).select("fp", "h", "part", "cell")
        fresh = self.texts().where(self.batch_of() == number)
        out = fresh.groupBy("part", "cell").cogroup(lost.groupBy("part", "cell")).applyInArrow(strip_cell, STRIPPED)
        out = materialize(out, "window-results")
        run = self.write_run(out.select("part", "cell", "rid", "fps").mapInArrow(run_rows, self.RUN))
        self.commit(runs=[*self.state["runs"], run])
        if len(self.state["runs"]) > FANOUT:
            self.compact()
        return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every document, ingested in ``batches`` steps in order of doc_id."""
    docs = only(docs, "doc_id", "text")
    index = WindowIndex(docs.sparkSession)
    starts = quantile_ranges(docs, "doc_id", batches) or [0]
    out = None
    for k in range(len(starts)):  # smaller doc_ids come first
        own = F.lit(True)
        if k:
            own = own & (F.col("doc_id") >= starts[k])
        if k < len(starts) - 1:
            own = own & (F.col("doc_id") < starts[k + 1])
        part = index.ingest(docs.where(own | F.col("doc_id").isNull() if k == 0 else own))
        out = part if out is None else out.unionByName(part)
    index.drop()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ') ORDER BY doc_id, i) > 1 AS again FROM i),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM k WHERE again) GROUP BY doc_id),
m AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
h AS (SELECT doc_id, w, len(gone) AS n, list_filter(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN list_contains(gone, j) THEN NULL ELSE w[j] END), lambda x: x IS NOT NULL) AS kept FROM m)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM h"""
