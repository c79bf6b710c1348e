"""The pipeline against a brute-force version, and the robust estimator against numpy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_documents import brute_components, brute_counts, brute_secrets, words
from textmaker import prose

import corpus_pipeline
from millrace.llm import packing, quality


def brute_mix(rows):
    """Rows of (doc_id, text, lang, source, n_chars) as the mix takes them."""
    by = defaultdict(list)
    for r in rows:
        u = hashlib.md5(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        by[r[3]].append((u, len(words(r[1])), r))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[1] for x in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, goal = 1.5 * sum(size.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 2.0 * size[s]
            left -= goal[s]
            free.remove(s)
    out = []
    for s in names:
        whole, rest = divmod(int(goal[s] + 0.5), size[s]) if size[s] else (0, 0)
        start = 0
        for _, n, r in sorted(by[s], key=lambda x: x[:2]):
            out += [r] * whole
            cut = max(0, min(rest - start, n))
            if cut:
                m = re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % cut, r[1])
                out.append(r if cut == n else (r[0], m[0], r[2], r[3], len(m[0])))
            start += n
    return out


def test_pipeline_equals_brute_force(spark, rows, tmp_path):
    rows = [r for r in rows if r[0] is None or r[0] < 600] + [(700 + k, prose(random.Random(k), 90), "en", "b", 0) for k in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    far = brute_distances(spark, rows)
    rows = [r for r in rows if (c := brute_counts(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0] and far[r[0]] <= quality.CUTOFF]
    first = {i: c for i, _, c in brute_components(rows)}
    rows = [r for r in rows if r[0] is None or first[r[0]] == r[0]]
    masked = []
    for r in rows:
        spans = sorted((s, e) for p in brute_secrets(r[1]) for s, _, e in p)
        text, at = "", 0
        for s, e in spans:
            if s >= at:
                text += r[1][at:s] + "[REDACTED]"
            at = max(at, e)
        text += r[1][at:]
        masked.append((r[0], text, r[2], r[3], len(text) if spans else r[4]))
    tok = packing.tokenizer(packing.vocabulary_path())
    want = Counter()
    for r in brute_mix(masked):
        ids = [*tok.encode(r[1], add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[(r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_stages_keep_the_columns(spark, wide, tmp_path):
    docs = wide.where("doc_id < 60")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == wide.columns and docs.count() > 0


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "piece", "start"]


def brute_vector(text):
    n, chars, symbols, dup, repeat = brute_counts(text)
    w = words(text)
    text = text or ""
    lines = sum(1 for x in text.split("\n") if words(x))
    other = sum(c.isascii() and not c.isalnum() and c not in " \t\n\r\x0b\f" for c in text)
    upper = sum("A" <= c <= "Z" for c in text)
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    m = n + 20
    return [np.log((chars + 110) / m), np.sqrt(symbols / m), dup / (lines + 10), repeat / m, np.sqrt(upper / (chars + 110)), np.sqrt(other / (chars + 110)), stutter / m]


def brute_distances(spark, rows):
    """Squared distances of rows (doc_id, text, lang, source, n_chars; distinct doc_ids) by the estimator written out in numpy; null for none. Spark only says who is in which random subset."""
    ok = [r for r in rows if (c := brute_counts(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    if not ok:
        return {r[0]: None for r in rows}
    x = np.array([brute_vector(r[1]) for r in ok])
    df = spark.createDataFrame(ok, "doc_id long, text string, lang string, source string, n_chars long")
    named = quality._named(quality.statistics(df, "doc_id"))
    u = {r[0]: r[1:] for r in named.select("doc_id", *[quality.drawn_by(k).alias(f"u{k}") for k in range(1, quality.SUBSETS + 1)]).collect()}
    floors = np.array(quality.FLOORS)

    def moments(near):
        return near.mean(axis=0), np.cov(near.T, ddof=0).reshape(7, 7) + np.diag(floors**2) if len(near) > 1 else np.diag(floors**2)

    def concentrate(x, m, cov):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
        bins = np.floor(np.log2(d + 2.0**-20) * quality.BINS_PER_OCTAVE)
        last = np.sort(bins)[int(np.ceil(quality.CORE * len(x) - 1e-9)) - 1]
        return (*moments(x[bins <= last]), max(1.0, 2.0 ** ((last + 1) / quality.BINS_PER_OCTAVE) / quality.CHI2_CORE))

    def estimate(pick):
        own, ids = x[pick], [ok[i][0] for i in pick]
        edges = np.floor(own * 4 / floors + 0.5) * floors / 4
        at = lambda q: np.array([np.sort(edges[:, i])[int(np.ceil(q * len(own) - 1e-9)) - 1] for i in range(7)])
        tried = [(at(0.5), np.diag(np.maximum(floors, (at(0.75) - at(0.25)) / 1.349) ** 2), 1.0)]
        for k in range(quality.SUBSETS):
            some = [i for i, d in enumerate(ids) if u[d][k] * len(own) < quality.SUBSET_ROWS]
            if some:
                tried.append((*moments(own[some]), 1.0))
        det = lambda e: np.linalg.slogdet(e[1])[1]
        for _ in range(quality.FIRST_STEPS):
            tried = [concentrate(own, *e[:2]) for e in tried]
        ends = []
        for e in sorted(tried, key=det)[: quality.FINALISTS]:
            while det(new := concentrate(own, *e[:2])) < det(e) - quality.TOLERANCE:
                e = new
            ends.append(e)
        m, cov, scale = min(ends, key=det)
        return len(own), m, cov * scale

    def drawn(*estimates):
        _, m, cov = estimates[0]
        for n, m2, cov2 in estimates[1:]:
            w = n / (n + quality.PRIOR_ROWS)
            m, cov = w * m2 + (1 - w) * m, w * cov2 + (1 - w) * cov
        return m, np.linalg.inv(cov)

    whole = estimate(list(range(len(ok))))
    by_lang = {lang: estimate([i for i, r in enumerate(ok) if r[2] == lang]) for lang in {r[2] for r in ok}}
    fitted = {g: drawn(whole, by_lang[g[0]], estimate([i for i, r in enumerate(ok) if r[2:4] == g])) for g in {r[2:4] for r in ok}}
    out = {}
    for r in rows:
        m, p = fitted.get(r[2:4], (None, None))
        d = None if m is None else np.array(brute_vector(r[1])) - m
        out[r[0]] = None if d is None else float(d @ p @ d)
    return out


def test_estimator_equals_numpy(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(25, 200)), rng.choice(["en", "de", None]), rng.choice(["s", "t", None]), 0) for k in range(260)]
    rows += [(500 + k, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "s", 0) for k in range(20)]
    rows += [(700, prose(rng, 50), "fr", "alone", 0), (701, "few words", "fr", "nothing", 0), (702, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["outlier_distance"] for r in quality.judge(quality.statistics(df, "doc_id")).collect()}
    want = brute_distances(spark, rows)
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None} == {701}
    assert all(got[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items() if v is not None)
    assert all(got[k] > quality.CUTOFF for k in range(500, 520)) and sum(got[k] < quality.CUTOFF for k in range(260)) >= 257


def test_moderate_junk_is_rejected_at_every_size(spark):
    """Twelve symbols in a hundred words, a few such texts among any number of clean ones of their source; the least determinant is found among several starts."""
    rng = random.Random(3)
    for size in (12, 60, 400):
        rows = [(k, prose(rng, rng.randint(60, 200)), "en", "s", 0) for k in range(size)]
        rows += [(10_000 + k, " ".join(f"{w}#" if i % 8 == 0 else w for i, w in enumerate(prose(rng, 100).split())), "en", "s", 0) for k in range(max(1, size // 10))]
        kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
        assert not [k for k in kept if k >= 10_000] and len(kept) >= 0.98 * size


def test_determinants_only_fall(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(25, 200)), "en", "s", 0) for k in range(150)] + [(900 + k, "# " * 30 + prose(rng, 60), "en", "s", 0) for k in range(30)]
    stats = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    x = quality._named(stats.where(~quality.failed())).select("lang", "source", *[f"x{i}" for i in range(quality.P)]).cache()
    from pyspark.sql import functions as F

    groups = x.groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source", F.transform(quality.levels(), lambda g: F.struct(g.alias("g"), F.col("n"))).alias("sizes")).cache()
    params = quality.materialize(quality.starts(x, groups, 1), "t")
    first = quality.materialize(quality.step(x, groups, 1, params), "t")
    second = {(r["g"], r["k"]): r["logdet"] for r in quality.step(x, groups, 1, first).collect()}
    assert len(second) == 3 * (1 + quality.SUBSETS)
    assert all(second[r["g"], r["k"]] <= r["logdet"] + 0.05 for r in first.collect())  # a bin's width may be added
