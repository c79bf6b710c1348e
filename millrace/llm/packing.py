"""Best-fit packing of token pieces into sequences, with swap-based local search.

Tokens: each distinct word of a batch is encoded once and the ids are laid out again by position; the tokenizer splits at white space and
works on each word alone, so this gives the ids of whole texts. Pieces go to shards of a bounded number of pieces by a hash of the row, so
the work spreads however ids or sources are distributed. Within a shard pieces are placed by best fit, longest first; then the local search
moves a piece, exchanges one for one, or two for one, between underfull bins wherever that raises the sum of squared fills, until no move
helps or the number of bins is the least possible. Every bin is tried, and tried again after it has changed. The LEFTOVER_BINS least filled
bins of every shard are then taken apart, and their pieces packed anew together with those of JOINED other shards, by the same fit and search,
round by round until one shard is left; so shards share their underfull bins though none ever holds more than a bounded number of pieces.

Defined cases: a null or empty text is its end token alone; a text longer than a sequence is cut into full pieces and a rest; repeated rows
are packed once each; pieces of equal length are placed in order of their rows; texts are read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import materialize, only, table

QUERY = "op4_swap_packing"

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
PIECES_PER_SHARD = 8192
LEFTOVER_BINS, JOINED = 8, 64
#: Words kept encoded between batches of a worker; beyond that the table starts anew.
WORDS_KEPT = 300_000
RECENT_WORDS = 30_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Workers are as many as cores already; the tokenizer's own threads would only add memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Bytes of ASCII letters; ASCII bytes that are neither alphanumeric, white space, nor part of contractions or special tokens.
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<"]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the letters U+00C0 to U+00FF, which the tokenizer never splits or composes."""
    out = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    nxt = data[lead + 1]
    lead = lead[(nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)]
    out[lead] = True
    out[lead + 1] = True
    return out


class WordIds:
    """The ids of words by two hashes of 64 bits: one finds a word, the other must agree as well. If ever it doesn't, the table starts anew
    under other seeds. A word of letters that ends in marks is two spans, as it is for the tokenizer."""

    def __init__(self, path: str):
        self.seed = 0
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, tk.U64), np.zeros(0, tk.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.levels = [none, none]  # (hashes in order, second hashes, starts, counts): the many, and those learnt since they were last merged
        self.ids = np.zeros(0, np.uint32)

    def look_up(self, hashes: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Starts and counts of these words' ids, start -1 where a word isn't known; None if two words share a hash."""
        start, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, others, starts, counts in self.levels:
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                if (others[place[hit]] != second[hit]).any():
                    return None
                start[hit], count[hit] = starts[place[hit]], counts[place[hit]]
        return start, count

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def spans(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, which spans are letters alone, and where each row's spans begin."""
        is_letter = letters(w.data)
        other = np.flatnonzero(~is_letter)
        turn = np.concatenate([other, [len(w.data)]])[np.searchsorted(other, w.start)]
        turn = np.minimum(turn, w.end)
        marks = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_MARK[w.data], out=marks[1:])
        two = (turn > w.start) & (turn < w.end) & (marks[w.end] - marks[turn] == w.end - turn)
        at = np.zeros(len(two) + 1, np.int64)
        np.cumsum(1 + two, out=at[1:])
        start, end, alone = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64), np.zeros(at[-1], bool)
        first, second = at[:-1], at[:-1][two] + 1
        start[first], end[first], alone[first] = w.start, np.where(two, turn, w.end), two | (turn == w.end)
        start[second], end[second] = turn[two], w.end[two]
        return start, end, alone, at[w.at]

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray, hashes: np.ndarray, second: np.ndarray) -> None:
        raw = data.tobytes()
        ids, count = [], np.zeros(len(start), np.int64)
        own = np.flatnonzero(alone)
        # Each span of letters ends in exactly one closing token, so many of them can be encoded as one text.
        groups = [own[a : a + 2000] for a in range(0, len(own), 2000)]
        texts = [b" ".join([raw[s:e] for s, e in zip(start[g].tolist(), end[g].tolist(), strict=True)]).decode() for g in groups]
        order = []
        for g, x in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            got = np.array(x.ids, np.uint32)
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) != len(g):
                raise ValueError("a run of letters did not give one closing token")
            count[g] = np.diff(ends, prepend=0)
            ids.append(got)
            order.append(g)
        rest = np.flatnonzero(~alone)
        words = [raw[s:e].decode() for s, e in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count[rest] = [len(x) for x in lists]
        ids.append(np.array([i for x in lists for i in x], np.uint32))
        order = np.concatenate([*order, rest])
        place = np.empty(len(start), np.int64)
        place[order] = len(self.ids) + np.cumsum(count[order]) - count[order]
        self.ids = np.concatenate([self.ids, *ids])
        self.levels[1] = self.merged(self.levels[1], (hashes, second, place, count))
        if len(self.levels[1][0]) > RECENT_WORDS:
            self.levels = [self.merged(*self.levels), tuple(x[:0] for x in self.levels[1])]

    def known(self, w: tk.Words, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Starts and counts of the ids of each distinct span, and which of these each span is; None if two spans share a hash."""
        unique, at, back = np.unique(tk.span_hashes(w.data, start, end, self.seed), return_index=True, return_inverse=True)
        all_second = tk.span_hashes(w.data, start, end, self.seed + 1)
        second = all_second[at]
        if (second[back] != all_second).any() or (found := self.look_up(unique, second)) is None:
            return None
        new = found[0] < 0
        if new.any():
            if sum(len(x[0]) for x in self.levels) + int(new.sum()) > WORDS_KEPT:
                self.clear()
                new[:] = True
            n = at[new]
            self.learn(w.data, start[n], end[n], alone[n], unique[new], second[new])
            found = self.look_up(unique, second)
        return (*found, back)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of those rows without end ids, ids of each row)."""
        for a, b, w in tk.each_chunk(texts):
            start, end, alone, rows = self.spans(w)
            while (got := self.known(w, start, end, alone)) is None:
                self.seed += 2
                self.clear()
            starts, counts, back = got
            count = counts[back]
            yield a, b, self.ids[tk.ragged(starts[back], count)], tk.sums_by_row(count, rows)


def cut(path: str, capacity: int, end_id: int):
    """A function for mapInArrow: rows of (id, text) become rows of pieces."""

    @tk.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        try:
            for batch in batches:
                for a, b, ids, lengths in words.encode(batch.column(1)):
                    ends = np.cumsum(lengths + 1)
                    laid = np.full(int(ends[-1]), end_id, np.uint32)
                    own = np.ones(len(laid), bool)
                    own[ends - 1] = False
                    laid[own] = ids
                    n = -(-(lengths + 1) // capacity)
                    row = np.repeat(np.arange(b - a), n)
                    piece = tk.ragged(np.zeros(b - a, np.int64), n)
                    start = piece * capacity
                    size = np.minimum(lengths[row] + 1 - start, capacity)
                    first = (ends - lengths - 1)[row] + start
                    raw = memoryview(laid.astype("<u4", copy=False).tobytes())
                    crc = [zlib.crc32(raw[4 * f : 4 * (f + s)]) for f, s in zip(first.tolist(), size.tolist(), strict=True)]
                    cols = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32"])
        finally:
            words.clear()
            tokenizer.cache_clear()  # a worker that waits for its next task holds no vocabulary

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every row."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(cut(path or vocabulary_path(), capacity, end_id), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        fits = rooms >> size
        if size and fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > size:
            by_room.setdefault(room - size, []).append(k)
            rooms |= 1 << (room - size)
    return bins


class Offers:
    """For each open bin what it can take out of itself (nothing, one piece, two pieces), as flat arrays that hold an open bin's sums once.

    A bin's old rows die when it changes and its new ones are appended; dead rows go when they are the more.
    """

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        self.size = self.dead = 0
        self.columns = [np.empty(1024, np.int32) for _ in range(4)]  # bin, pieces, their sum, the bin's room (-1: dead)
        self.rows: dict[int, tuple[int, int]] = {}

    def sums(self, members: list[int]) -> list[list[int]]:
        """The distinct sums, in order, of no piece, one piece, and two pieces."""
        sizes = [self.lengths[i] for i in members]
        one = sorted(set(sizes))
        two = {a + b for k, a in enumerate(one) for b in one[:k]}
        if len(one) < len(sizes):
            two |= {2 * a for a, n in Counter(sizes).items() if n > 1}
        return [[0], one, sorted(two)]

    def own(self, k: int, pieces: int) -> np.ndarray:
        """Bin k's sums of so many pieces, in order."""
        a, b = self.rows[k]
        n, total = (c[a:b] for c in self.columns[1:3])
        x, y = np.searchsorted(n, (pieces, pieces + 1))
        return total[x:y]

    def drop(self, k: int) -> None:
        a, b = self.rows.pop(k, (0, 0))
        self.columns[3][a:b] = -1
        self.dead += b - a

    def put(self, k: int, members: list[int], room: int) -> None:
        self.drop(k)
        if 2 * self.dead > max(1024, self.size):
            live = np.flatnonzero(self.columns[3][: self.size] >= 0)
            for c in self.columns:
                c[: len(live)] = c[live]
            self.size, self.dead = len(live), 0
            owner = self.columns[0][: self.size]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if self.size else np.zeros(0, np.int64)
            self.rows = {int(owner[x]): (int(x), int(y)) for x, y in zip(first, [*first[1:], self.size], strict=True)}
        if not members:
            return
        sums = self.sums(members)
        n = len(sums[0]) + len(sums[1]) + len(sums[2])
        if self.size + n > len(self.columns[0]):
            self.columns = [np.concatenate([c, np.empty(max(n, len(c)), np.int32)]) for c in self.columns]
        a, b = self.size, self.size + n
        for c, x in zip(self.columns, (k, [m for m, x in enumerate(sums) for _ in x], [y for x in sums for y in x], room), strict=True):
            c[a:b] = x
        self.rows[k], self.size = (a, b), b

    def members(self, members: list[int], pieces: int, total: int) -> tuple[int, ...]:
        """So many of these pieces with this sum."""
        if pieces == 0:
            return ()
        by_length: dict[int, int] = {}
        for i in members:
            if pieces == 1 and self.lengths[i] == total:
                return (i,)
            if pieces == 2 and total - self.lengths[i] in by_length:
                return (i, by_length[total - self.lengths[i]])
            by_length[self.lengths[i]] = i
        raise ValueError("no such pieces")


#: Pieces given and taken in a change: a move, an exchange of one for one, of two for one, and of one for two.
CHANGES = ((1, (0, 1, 2)), (2, (1,)))


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Moves and exchanges that raise the sum of squared fills, the least filled bins first, until none is left or the bins are the least possible.

    A bin is looked at again whenever it has changed, with all others as receivers and as givers; so at the end no change between any two helps.
    """
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    used = sum(1 for b in bins if b)
    if used <= least:
        return [b for b in bins if b]
    offers = Offers(lengths)
    waiting = np.zeros(len(bins), bool)

    def changed(k: int) -> None:
        full = fill[k] >= capacity
        offers.put(k, [] if full else bins[k], int(capacity - fill[k]))
        waiting[k] = bool(bins[k]) and not full

    def gives(k: int) -> tuple[int, ...] | None:
        """The best change in which bin k's fill falls: giver, pieces and sum given, receiver, pieces and sum taken.

        For each offer of a receiver the largest sum that fits gains most: d (f + d) grows with d wherever it is above 0.
        """
        owner, pieces, total, room = (c[: offers.size] for c in offers.columns)
        best, found = 0, None
        for n, takes in CHANGES:
            mine = offers.own(k, n)
            if not len(mine):
                continue
            at = np.searchsorted(mine, total + room, "right") - 1
            d = mine[at] - total
            gain = d.astype(np.int64) * (capacity - room - fill[k] + d)
            ok = (at >= 0) & (d > 0) & (room >= 0) & (owner != k)
            if len(takes) == 1:
                ok &= pieces == takes[0]
            gain *= ok
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = int(gain[i]), (k, n, int(total[i] + d[i]), int(owner[i]), int(pieces[i]), int(total[i]))
        return found

    def gets(k: int) -> tuple[int, ...] | None:
        """The best change in which bin k's fill rises."""
        owner, pieces, total, room = (c[: offers.size] for c in offers.columns)
        best, found = 0, None
        for n, takes in CHANGES:
            mine = np.sort(np.concatenate([offers.own(k, m) for m in takes]))
            # For each sum that another bin can give the least of k's that leaves it fitting gains most.
            at = np.searchsorted(mine, total - int(capacity - fill[k]))
            d = total - mine[np.minimum(at, len(mine) - 1)]
            gain = d.astype(np.int64) * (fill[k] - (capacity - room) + d)
            gain *= (at < len(mine)) & (d > 0) & (room >= 0) & (owner != k) & (pieces == n)
            i = int(gain.argmax())
            if gain[i] > best:
                taken = int(total[i] - d[i])
                m = next(m for m in takes if taken in offers.own(k, m))
                best, found = int(gain[i]), (int(owner[i]), n, int(total[i]), k, m, taken)
        return found

    for k in range(len(bins)):
        changed(k)
    while used > least:
        ready = np.flatnonzero(waiting)
        if not len(ready):
            break
        k = int(ready[fill[ready].argmin()])
        change = gives(k) or gets(k)
        if change is None:
            waiting[k] = False
            continue
        giver, n, given, receiver, m, taken = change
        give, take = offers.members(bins[giver], n, given), offers.members(bins[receiver], m, taken)
        bins[giver] = [i for i in bins[giver] if i not in give] + list(take)
        bins[receiver] = [i for i in bins[receiver] if i not in take] + list(give)
        fill[giver] -= given - taken
        fill[receiver] += given - taken
        used -= not bins[giver]
        changed(giver)
        changed(receiver)
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def pack_shard(capacity: int, number: int, leftover: int):
    """For applyInArrow over a shard's pieces: them with sequence_id and offset, and ``left``: true in the ``leftover`` least filled bins that have room."""

    def run(table: pa.Table) -> pa.Table:
        tk.release_sometimes()
        table = table.take(np.lexsort((table.column("rid").to_numpy(), -table.column("length").to_numpy())))
        lengths = table.column("length").to_pylist()
        bin_of, offset, left = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        bins = pack(lengths, capacity)
        fill = [sum(lengths[i] for i in b) for b in bins]
        again = {k for k in sorted(range(len(bins)), key=lambda k: fill[k])[:leftover] if fill[k] < capacity}
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                bin_of[i], offset[i], left[i] = k, at, k in again
                at += lengths[i]
        sequence = (table.column("shard").to_numpy().astype(np.int64) << 24) + bin_of + (number << 59)
        made = {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "left": pa.array(left)}
        return pa.table({**{c: table.column(c) for c in table.column_names if c not in made}, **made})

    return run


def pack_pieces(found: DataFrame, capacity: int = CAPACITY, per_shard: int = PIECES_PER_SHARD, leftover: int = LEFTOVER_BINS, joined: int = JOINED) -> DataFrame:
    """``found`` (columns of ``pieces``) plus sequence_id and offset."""
    kept = materialize(found.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    shards = max(1, round(kept.count() / per_shard))
    kind = kept.schema["id"].dataType.simpleString()
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    left, done, number = kept.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")), None, 0
    while True:
        last = shards == 1
        packed = left.groupBy("shard").applyInArrow(pack_shard(capacity, number, 0 if last else leftover), f"{columns}, rid long, shard int, sequence_id long, offset long, left boolean")
        packed = packed if last else materialize(packed, "packed")
        own = (packed if last else packed.where(~F.col("left"))).drop("rid", "shard", "left")
        done = own if done is None else done.unionByName(own)
        if last:
            return done
        shards, number = -(-shards // joined), number + 1
        left = packed.where("left").select(*kept.columns, F.floor(F.col("shard") / joined).cast("int").alias("shard"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    found = pack_pieces(pieces(only(docs, "doc_id", "text"), **options), options.get("capacity", CAPACITY))
    return found.withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
