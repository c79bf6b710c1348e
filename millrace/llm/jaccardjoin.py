"""N-gram Jaccard join by PartEnum signatures, with connected components.

A document is the set of its distinct SHINGLE-word shingles. Sets of like size share a band; a pair of Jaccard similarity 0.8 or more differs
in at most (a + b) / 9 elements, so for every band the Hamming distance is at most k. The feature domain is cut into n1 groups of n2 partitions
by ranges of the hash; a pair within k has a group with at most k2 differences, hence n2 - k2 partitions that agree: enumerating those subsets
of each group gives signatures of which similar sets share at least one. A set signs for its own band and for the bands of larger sets that it
can be similar to. Subsets without elements are no signatures; a set with so many that it might share no other also signs in a further tier with
another hash, and in the last tier the empty ones too, so no pair is lost.

Sharing a signature only proposes a pair. Proposals are filtered by odd sketches (whose Hamming distance never exceeds the sets') and then
verified on the sets. A bucket of up to SMALL sets proposes all its pairs; a larger one first proposes a star around its least id. The star
of a bucket that is hot within one task is made there, and only its least id is shuffled by the signature, so a signature of a third of all
rows is never gathered whole. What the links so far leave in different components is then compared within the bucket on sketches. The pairs that pass are proposed if they are no more
than PAIRS_A_ROW a row of the bucket; else a spanning forest of them, with up to EDGES edges where two trees meet. Buckets with a forest of which
an edge was refused do so again with more edges and without what was refused, until nothing is left. So every pair of different components is examined, and a group of n copies
costs in proportion to n rows, not n * n.

Defined cases: a null or empty text has no shingles and is linked with nothing; 1 to 4 words are one shingle; equal sets are one class from the
start; rows that share a doc_id share a component, and if their texts differ each text has its own links; a null doc_id is a row of its own;
extra columns are ignored; texts are read whole; an empty table gives an empty result. Sets are compared by 64-bit hashes of their shingles,
equal sets by 128 bits.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textkernel as tk
from millrace.llm.common import empty, forget, materialize, only, partitions, table, unwrapped, whole_rows

QUERY = "op6_partenum_join"

SHINGLE = 5
PERCENT = 80
SMALL = 8
TIERS = 4
#: Sets of at most this size use groups of 3 partitions of which 2 must agree; larger ones single partitions, whose contents are selective enough.
GROUPED_BELOW = 48
#: Signature rows that a task sorts at once, and how many of them make a signature hot: those of about a fifth of the documents.
FLUSH, HOT = 500_000, 1000
#: Within a bucket, sets of different components are compared in blocks of so many.
BLOCK = 512
#: Ids that are broadcast at most (16 bytes each); more are joined by shuffling.
MOST_BROADCAST = 1_000_000
PIVOT_ROWS = 64
#: Pairs that a bucket proposes at once, for each of its rows.
PAIRS_A_ROW = 4
#: Edges that a node proposes to a tree at first, and how many times as many after a refusal.
EDGES = 64


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, where each row's set begins, the sets' hashes in order)."""
    for a, b, w in tk.each_chunk(column):
        h = w.hashes(lower=True)
        _, s = w.windows(h, SHINGLE)
        row = np.repeat(np.arange(b - a), np.maximum(w.count - SHINGLE + 1, 0))
        for n in range(1, SHINGLE):
            short = np.flatnonzero(w.count == n)
            if len(short):
                first, g = w.windows(h, n)
                at = np.searchsorted(first, w.at[short])
                row, s = np.concatenate([row, short]), np.concatenate([s, g[at]])
        order = np.argsort(s)
        small = row[order].astype(np.uint16 if b - a < 65536 else np.int64)
        order = order[np.argsort(small, kind="stable")]
        row, s = row[order], s[order]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        row, s = row[keep], s[keep]
        yield a, b, np.searchsorted(row, np.arange(b - a + 1)), s


def reduced(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of each row's values."""
    total = np.zeros(len(values) + 1, tk.U64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


@functools.lru_cache(1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest size, and k, of each band."""
    low, high = [], []
    size = 1
    while size < 1 << 34:
        low.append(size)
        high.append(size * 100 // PERCENT)
        size = high[-1] + 1
    high_ = np.array(high, np.int64)
    # Sizes a and b, at least PERCENT similar: |a xor b| <= (a + b) * (100 - PERCENT) / (100 + PERCENT).
    return np.array(low, np.int64), high_, 2 * high_ * (100 - PERCENT) // (100 + PERCENT)


@functools.lru_cache(1)
def shapes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n1, n2, k2 and spare of each band: ``spare`` groups at least have k2 differences or fewer in a pair within k."""
    low, high, k = bands()
    n1, n2, k2 = np.zeros_like(k), np.zeros_like(k), np.zeros_like(k)
    for j in range(len(k)):
        n2[j], k2[j] = (3, 1) if high[j] <= GROUPED_BELOW else (1, 0)
        full = k[j] // (k2[j] + 1)
        groups = full + 1
        for _ in range(50):  # room for the groups that the least set signing here leaves without elements
            chosen = low[j] * PERCENT / 100 / groups * (n2[j] - k2[j]) / n2[j]
            empty = groups * min(1.0, (3 if n2[j] == 3 else 1) * np.exp(-chosen))
            more = int(full + 1 + empty + 2 * np.sqrt(empty))
            if more <= groups or more > 2 * (full + 1):
                break
            groups = more
        n1[j] = groups
    return n1, n2, k2, n1 - k // (k2 + 1)


def sign(at: np.ndarray, s: np.ndarray, tier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and signature of each signature that the sets give in a tier, and which rows need another tier."""
    low, _, k = bands()
    n1, n2, k2, spare = shapes()
    size = np.diff(at)
    own = np.searchsorted(low, size, "right") - 1
    last = np.searchsorted(low, size * 100 // PERCENT, "right") - 1
    rows, sigs = [], []
    again = np.zeros(len(size), bool)
    for up in range(int((last - own).max(initial=0)) + 1):
        band = own + up
        use = np.flatnonzero((size > 0) & (band <= last) & (k[np.minimum(band, len(k) - 1)] > 0))
        for grouped in (False, True):
            r = use[(n2[band[use]] == 3) == grouped]
            if not len(r):
                continue
            j = band[r]
            parts = n1[j] * n2[j]
            base = np.cumsum(parts) - parts
            element = tk.ragged(at[r], size[r])
            owner = np.repeat(np.arange(len(r)), size[r])
            h = s[element]
            place = h if tier == 0 else tk.mix(h ^ tk.U64(0x9E3779B97F4A7C15 * (tier + 1) & 0xFFFFFFFFFFFFFFFF))
            cell = base[owner] + (((place >> tk.U64(32)) * parts[owner].astype(tk.U64)) >> tk.U64(32)).astype(np.int64)
            value = tk.mix(h + tk.U64(0xC2B2AE3D27D4EB4F))
            if tier:
                order = np.argsort(cell, kind="stable")
                cell, value = cell[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            content = np.zeros(int(parts.sum()), tk.U64)
            content[cell[first]] = np.add.reduceat(value, first)
            full = np.zeros(len(content), bool)
            full[cell[first]] = True
            number = tk.ragged(np.zeros(len(r), np.int64), n1[j])
            salt = tk.mix(number.astype(tk.U64) + (np.repeat(j, n1[j]).astype(tk.U64) << tk.U64(40)) + tk.U64(tier << 56))
            group_row = np.repeat(np.arange(len(r)), n1[j])
            if not grouped:
                signature, some = tk.mix(content + salt), full
                empty = ~full
            else:
                c, f = content.reshape(-1, 3), full.reshape(-1, 3)
                odd = [tk.U64(0x9FB21C651E98DF25), tk.U64(0xD6E8FEB86659FD93), tk.U64(0xA0761D6478BD642F)]
                made = [(tk.mix(c[:, x] * odd[x] + c[:, y] * odd[y] + salt + tk.U64(z + 1)), f[:, x] | f[:, y]) for z, (x, y) in enumerate(itertools.combinations(range(3), 2))]
                empty = ~np.logical_and.reduce([m[1] for m in made])
                signature, some = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
            lacking = np.bincount(group_row, empty, len(r)) >= spare[j]
            again[r[lacking]] = True
            full_row = np.tile(group_row, 3) if grouped else group_row
            if tier == TIERS - 1:
                some = some | lacking[full_row]
            rows.append(r[full_row[some]])
            sigs.append(signature[some])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, tk.U64), again
    return np.concatenate(rows), np.concatenate(sigs), again


def signatures(at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature, over all tiers that each set needs."""
    rows, sigs, again = sign(at, s, 0)
    out = [(rows, sigs)]
    for tier in range(1, TIERS):
        r = np.flatnonzero(again)
        if not len(r):
            break
        size = np.diff(at)[r]
        sub = np.concatenate([[0], np.cumsum(size)])
        rows, sigs, more = sign(sub, s[tk.ragged(at[r], size)], tier)
        out.append((r[rows], sigs))
        again = np.zeros(len(at) - 1, bool)
        again[r[more]] = True
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


@tk.released
def set_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, text) as (id, n, ka, kb): size and two hashes of the set."""
    for batch in batches:
        n, ka, kb = (np.zeros(batch.num_rows, t) for t in (np.int64, tk.U64, tk.U64))
        for a, b, at, s in shingle_sets(batch.column(1)):
            n[a:b] = np.diff(at)
            ka[a:b] = tk.mix(reduced(tk.mix(s), at))
            kb[a:b] = tk.mix(reduced(tk.mix(s ^ tk.U64(0x94D049BB133111EB)), at))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ka.view(np.int64)), pa.array(kb.view(np.int64))], names=["id", "n", "ka", "kb"])


@tk.released
def set_keys_and_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``set_keys``, from rows of (id, text, text), with the text after the keys."""
    for batch in batches:
        for made in set_keys(iter([batch.select([0, 1])])):
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column(2)], names=["id", "n", "ka", "kb", "text"])


@tk.released
def signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, text) as (sig, node, least); of a task's equal sets only the first signs.

    ``least`` is null for most rows. Of a signature with more than HOT nodes among FLUSH rows, the least node has itself there, which
    says that the bucket is large, and the others have that node.
    """
    seen: dict[int, int] = {}
    done = 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(sig)))
        large = np.repeat(count > HOT, count)
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(np.repeat(node[start], count), mask=~large)], names=["sig", "node", "least"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, at, s in shingle_sets(batch.column(1)):
            key = tk.mix(reduced(tk.mix(s), at))
            rows, sigs = signatures(at, s)
            mine = np.array([seen.setdefault(k, done + a + i) == done + a + i for i, k in enumerate(key.tolist())], bool)
            keep = mine[rows]
            held.append((sigs[keep], ids[a + rows[keep]]))
            size += int(keep.sum())
            if size > FLUSH:
                yield flush()
                size = 0
        done += batch.num_rows
    if held:
        yield flush()


@tk.released
def bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's (sig, node, least) rows: kind 0 has pairs (a < b), kind 1 the rows (a: sig, b: node) of large buckets."""
    parts = []
    for b in batches:
        if b.num_rows:
            sig, node, least = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            known = least.is_valid().to_numpy(zero_copy_only=False)
            least = least.fill_null(0).to_numpy()
            stars = known & (least != node)
            if stars.any():  # of buckets that were large where their rows were made
                kind = np.repeat(np.array([0, 1], np.int32), int(stars.sum()))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([least[stars], sig[stars]])), pa.array(np.concatenate([node[stars]] * 2))], names=["kind", "a", "b"])
            parts.append((sig[~stars], node[~stars], known[~stars]))
    if not parts:
        return
    sig, node, large = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(sig)
    sig, node, large = sig[order], node[order], large[order]
    again = np.zeros(len(sig), bool)
    again[1:] = sig[1:] == sig[:-1]
    again[:-1] |= again[1:]
    again |= large
    sig, node, large = sig[again], node[again], large[again]
    order = np.lexsort((~large, node, sig))
    sig, node, large = sig[order], node[order], large[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, large = sig[keep], node[keep], large[keep]
    if not len(sig):
        return
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(start, len(sig)))
    first = np.repeat(start, count)
    rank = np.arange(len(sig)) - first
    star = rank > 0
    a, b = [node[first[star]]], [node[star]]
    small = np.repeat((count <= SMALL) & ~np.logical_or.reduceat(large, start), count)
    for gap in range(1, SMALL):  # pairs of a small bucket that the star lacks
        other = np.flatnonzero(small[gap:] & (sig[gap:] == sig[:-gap]) & (rank[:-gap] > 0))
        a.append(node[other])
        b.append(node[other + gap])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    big = ~small
    kind = np.concatenate([np.zeros(int(new.sum()), np.int32), np.ones(int(big.sum()), np.int32)])
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([a[new], sig[big]])), pa.array(np.concatenate([b[new], node[big]]))], names=["kind", "a", "b"])


@tk.released
def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, text) as (id, n, odd): of a set whose size has w binary digits, 2**(w + 2) bits of parity (64 at least)."""
    for batch in batches:
        for a, b, at, s in shingle_sets(batch.column(1)):
            n = np.diff(at)
            out = []
            for k in range(b - a):
                out.append(odd_sketch(s[at[k] : at[k + 1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(out, pa.binary())], names=["id", "n", "odd"])


def odd_sketch(s: np.ndarray) -> bytes:
    bits = max(64, 1 << (int(len(s)).bit_length() + 2))
    parity = np.bincount((tk.mix(s ^ tk.U64(0x2545F4914F6CDD1D)) & tk.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def folded_to(odd: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits from one of more: halves are added by parity, as the hash's top bit is dropped."""
    while odd.shape[-1] > size:
        half = odd.shape[-1] // 2
        odd = odd[..., :half] ^ odd[..., half:]
    return odd


def may_link(na: int, nb: int, differ: int) -> bool:
    return 100 * min(na, nb) >= PERCENT * max(na, nb) and (100 + PERCENT) * differ <= (100 - PERCENT) * (na + nb)


@F.arrow_udf(T.BooleanType())
def sketches_pass(na: pa.Array, a: pa.Array, nb: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for p, x, q, y in zip(na.to_pylist(), a.to_pylist(), nb.to_pylist(), b.to_pylist(), strict=True):
        u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        size = min(len(u), len(v))
        out.append(may_link(p, q, int(np.bitwise_count(folded_to(u, size) ^ folded_to(v, size)).sum())))
    return pa.array(out, pa.bool_())


@tk.released
def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (pivot, part, id, text) with the set in place of the text."""
    for batch in batches:
        for a, b, at, s in shingle_sets(batch.column(3)):
            own = [c.slice(a, b - a) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array([s[at[k] : at[k + 1]].tobytes() for k in range(b - a)], pa.binary())], names=["pivot", "part", "id", "elements"])


def verify(key: tuple, members: pa.Table, pivots: pa.Table) -> pa.Table:
    """The members whose sets are similar to their pivot's: (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not members.num_rows or not pivots.num_rows:
        return schema.empty_table()
    tk.release_sometimes()
    p = np.frombuffer(pivots.column("elements")[0].as_py(), tk.U64)
    a, b = [], []
    for member, raw in zip(members.column("id").to_pylist(), members.column("elements"), strict=True):
        m = np.frombuffer(raw.as_py(), tk.U64)
        if len(m) and len(p):
            place = np.minimum(np.searchsorted(p, m), len(p) - 1)
            both = int((p[place] == m).sum())
            if 100 * both >= PERCENT * (len(p) + len(m) - both):
                a.append(pivots.column("id")[0].as_py())
                b.append(member)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def few_of_each(labels: np.ndarray, per: int) -> np.ndarray:
    """The places of the first ``per`` of each label."""
    order = np.argsort(labels, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], labels[order][1:] != labels[order][:-1]]))
    rank = np.arange(len(labels)) - np.repeat(first, np.diff(np.append(first, len(labels))))
    return order[rank < per]


def cross_pairs(per: int):
    """For applyInArrow: ``forest_of`` with ``per`` edges."""
    return lambda key, rows, refused: forest_of(rows, refused, per)


def forest_of(rows: pa.Table, refused: pa.Table, per: int = 1) -> pa.Table:
    """A bucket's pairs whose components differ and whose sketches pass, without refused ones: (sig, a, b) from rows of (sig, node, component, n,
    odd); or, where they are very many, a spanning forest of them, with ``per`` edges of a node where two trees meet. ``partial``: whether it is one."""
    schema = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("partial", pa.bool_())])
    if rows.num_rows < 2:
        return schema.empty_table()
    tk.release_sometimes(1024)
    node, comp, n = (rows.column(c).to_numpy() for c in ("node", "component", "n"))
    raw = rows.column("odd").to_pylist()
    size = min(map(len, raw))
    _, label, members = np.unique(comp, return_inverse=True, return_counts=True)
    if len(members) < 2:
        return schema.empty_table()
    # The largest component comes last: its own pairs are never looked at.
    order = np.argsort(label == np.argmax(members), kind="stable")
    node, label, n = node[order], label[order], n[order]
    odd = np.stack([folded_to(np.frombuffer(raw[k], np.uint8), size) for k in order]).view(np.uint64)
    place = {int(x): k for k, x in enumerate(node.tolist())}
    barred: dict[int, list[int]] = {}
    for x, y in zip(*(refused.column(c).to_pylist() for c in ("a", "b")), strict=True):
        i, j = place.get(x), place.get(y)
        if i is not None and j is not None:
            barred.setdefault(min(i, j), []).append(max(i, j))
    a, b, before, passing, every = [], [], label.copy(), 0, []
    for i in range(0, len(node) - int(members.max()), BLOCK):
        x = slice(i, i + BLOCK)
        passes = np.zeros((len(node[x]), len(node)), bool)
        for j in range(i, len(node), BLOCK):
            y = slice(j, j + BLOCK)
            differ = np.zeros((len(node[x]), len(node[y])), np.int64)
            for word in range(odd.shape[1]):
                differ += np.bitwise_count(odd[x, None, word] ^ odd[None, y, word])
            na, nb = n[x, None], n[None, y]
            passes[:, y] = ((100 + PERCENT) * differ <= (100 - PERCENT) * (na + nb)) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))
        for p in range(len(passes)):
            good = passes[p]
            good[: i + p + 1] = False
            good[barred.get(i + p, [])] = False
            good &= before != before[i + p]
            passing += int(good.sum())
            if passing <= PAIRS_A_ROW * len(node):
                every += [(i + p, x) for x in np.flatnonzero(good).tolist()]
            q = np.flatnonzero(good & (label != label[i + p]))
            if len(q):  # one edge to each tree that it touches, and all are one tree then
                chosen = few_of_each(label[q], per)
                a += [int(node[i + p])] * len(chosen)
                b += node[q[chosen]].tolist()
                label[np.isin(label, label[q])] = label[i + p]
    sig = rows.column("sig")[0].as_py()
    if passing == len(every):
        a, b = [int(node[x]) for x, _ in every], [int(node[y]) for _, y in every]
    low, high = (pa.array(f(a, b) if a else [], pa.int64()) for f in (np.minimum, np.maximum))
    return pa.table([pa.array([sig] * len(a), pa.int64()), low, high, pa.array([passing > len(a)] * len(a), pa.bool_())], schema=schema)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def exact_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Each member goes to its pivot in parts of about PIVOT_ROWS, so a pivot of many is spread."""
    pairs = materialize(pairs, "join-pairs")  # these two go with the folder: the result reads them
    n = pairs.count()
    per = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / PIVOT_ROWS).cast("int").alias("parts"))
    per = materialize(per, "join-pivots")
    dealt = pairs.join(small_side(per, n), "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    pivots = per.select(F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    schema = "pivot long, part int, id long, elements binary"
    sides = [docs.join(small_side(x, n), "id").select("pivot", "part", "id", "text").mapInArrow(set_rows, schema) for x in (dealt, pivots)]
    return sides[0].groupBy("pivot", "part").cogroup(sides[1].groupBy("pivot", "part")).applyInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id; the component is the least id that links reach.

    Every round takes the least label among neighbours and then the label's own label, so chains shorten by halves.
    """
    edges = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("a", "b").distinct(), "join-edges")
    held = labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "id"), "join-labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("l").alias("m"))
        nxt = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("l", "m").alias("l"), F.col("l").alias("before"))
        step = materialize(nxt, "join-labels")
        jump = step.select(F.col("id").alias("j"), F.col("l").alias("jl"))
        nxt = materialize(step.join(jump, F.col("l") == F.col("j")).select("id", F.least("l", "jl").alias("l"), "before"), "join-labels")
        forget(step)
        forget(held)
        held, labels = nxt, nxt.select("id", "l")
        if nxt.where(F.col("l") < F.col("before")).limit(1).count() == 0:
            forget(edges)
            return labels.withColumnRenamed("l", "component")


def with_nodes(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (id, text; no null ids) and ``keys`` with ``node`` for ``id``: the id, but where texts of one id differ in their sets, ids of their own, above all others, for all but one."""
    differ = F.min("ka") != F.max("ka")
    shared = materialize(keys.where(F.col("id").isNotNull()).groupBy("id").agg(differ.alias("differ")).where("differ").select("id"), "join-shared-ids")
    n = shared.count()
    if not n:
        return docs.withColumnRenamed("id", "node"), keys.withColumn("node", F.col("id"))
    top = keys.agg(F.max("id")).first()[0]
    kinds = keys.join(small_side(shared, n), "id").select("id", "n", "ka", "kb").distinct()
    own = Window.partitionBy("id").orderBy("n", "ka", "kb")
    # Numbered over all such ids by the hash buckets that Spark gives; the first text of each keeps the id.
    later = materialize(kinds.withColumn("rank", F.row_number().over(own)).where("rank > 1").select("id", "n", "ka", "kb", (F.monotonically_increasing_id() + F.lit(top) + 1).alias("own")), "join-own-nodes")
    joined = lambda d: d.join(small_side(later, n), ["id", "n", "ka", "kb"], "left").withColumn("node", F.coalesce("own", "id"))
    texts = docs.join(small_side(shared.withColumn("twin", F.lit(True)), n), "id", "left")
    plain = texts.where(F.col("twin").isNull()).select(F.col("id").alias("node"), "text")
    told = texts.where("twin").select("id", "text", "text").toDF("id", "keyed", "text").mapInArrow(set_keys_and_text, "id long, n long, ka long, kb long, text string")
    return plain.unionByName(joined(told).select("node", "text")), joined(keys.where(F.col("id").isNotNull())).drop("own").unionByName(keys.where(F.col("id").isNull()).withColumn("node", F.lit(None).cast("long")))


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text)."""
    all_docs = docs.select(F.col("doc_id").alias("id"), "text")
    keys = materialize(all_docs.mapInArrow(set_keys, "id long, n long, ka long, kb long"), "join-sets")
    named, keys = with_nodes(all_docs.where(F.col("id").isNotNull()), keys)
    named = named.select(F.col("node").alias("id"), "text")
    # Equal sets: the least id stands for the class. Sums come before the shuffle, so a class of a third of all rows is no burden.
    members = keys.where((F.col("n") > 0) & F.col("id").isNotNull()).select(F.col("node").alias("id"), "n", "ka", "kb")
    classes = members.groupBy("n", "ka", "kb").agg(F.min("id").alias("rep"), F.max("id").alias("top"))
    away = F.col("least").isNotNull() & (F.col("least") != F.col("node"))
    signed = named.mapInArrow(signature_rows, "sig long, node long, least long").repartition(2 * partitions(docs.sparkSession), F.when(away, F.col("node")).otherwise(F.col("sig")))
    raw = materialize(signed.mapInArrow(bucket_pairs, "kind int, a long, b long"), "join-buckets")
    pairs = raw.where("kind = 0").select("a", "b").distinct()
    big = raw.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node"))
    nodes = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "join-nodes")
    n_nodes = nodes.count()
    first_text = named.join(small_side(nodes, n_nodes), "id")
    odd = materialize(first_text.select("id", "text").mapInArrow(sketches, "id long, n long, odd binary").dropDuplicates(["id"]), "join-sketches")
    a, b = odd.toDF("a", "na", "oa"), odd.toDF("b", "nb", "ob")
    passed = pairs.join(a, "a").join(b, "b").where(sketches_pass("na", "oa", "nb", "ob")).select("a", "b")
    found = materialize(exact_links(named, passed), "join-links")
    same = classes.where(F.col("top") > F.col("rep"))
    # Members of a class are linked to it by (class, salt), of which a class has few, so none is gathered in one task.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)).cast("int"))
    spread = salted.select("n", "ka", "kb", "salt").distinct().join(same, ["n", "ka", "kb"])
    copies = salted.join(spread, ["n", "ka", "kb", "salt"]).where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    twins = keys.where(F.col("node") != F.col("id")).select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = found.union(materialize(copies.union(twins).distinct(), "join-copies"))
    named_by = components(found)
    refused, per = empty(docs.sparkSession, "sig long, a long, b long"), EDGES
    while True:  # a round merges components or refuses pairs, of which there are finitely many
        left = big.join(named_by, F.col("node") == F.col("id"), "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        # Whether a bucket is still of several components is summed and sent back by (sig, salt), so a bucket of very many sets stays spread.
        left = left.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(32)).cast("int"))
        part = left.groupBy("sig", "salt").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed = part.groupBy("sig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo") < F.col("hi")).select("sig")
        open_rows = left.join(part.select("sig", "salt").join(mixed, "sig"), ["sig", "salt"]).select("sig", "node", "component").distinct()
        open_rows = open_rows.join(odd, F.col("node") == F.col("id")).select("sig", "node", "component", "n", "odd")
        asked = materialize(open_rows.groupBy("sig").cogroup(refused.groupBy("sig")).applyInArrow(cross_pairs(per), "sig long, a long, b long, partial boolean"), "join-asked")
        if asked.limit(1).count() == 0:
            forget(asked)
            break
        more = materialize(exact_links(named, asked.select("a", "b").distinct()), "join-links")
        if more.limit(1).count():
            found = found.union(more)
            named_by = components(found)
        no = materialize(asked.join(more, ["a", "b"], "left_anti"), "join-refused")
        # A bucket whose pairs were all proposed is done, and so is one whose forest holds: its trees are one component.
        again = no.where("partial").select("sig").distinct()
        if again.limit(1).count() == 0:
            break
        big = big.join(again, "sig", "left_semi")
        refused = refused.unionByName(no.select("sig", "a", "b"))
        per *= EDGES
    for done in (raw, nodes, odd):
        forget(done)
    out = keys.join(named_by.withColumnRenamed("id", "_id"), F.col("node") == F.col("_id"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``documents`` with one row of each component, the one of least doc_id; rows without shingles all stay."""
    found = join_components(only(docs, "doc_id", "text"))
    drop = materialize(found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("k")).distinct(), "join-dropped")
    return unwrapped(whole_rows(docs, k=F.col("doc_id")).join(small_side(drop, drop.count()), "k", "left_anti"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS y FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT doc_id, min(y) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
