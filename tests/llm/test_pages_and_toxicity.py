"""Operators over pages and labels: exact round trips, held-out accuracy and brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import archives, htmltext, toxicity


# op1


def test_held_out_pages():
    model = htmltext.trained()
    rng = random.Random(2024)
    blocks = wrong = 0
    for _ in range(150):
        found, labels = htmltext.labelled(rng)
        if found:
            got = model.scores(model.inputs(found, [len(found)]), [len(found)]) >= 0
            blocks += len(labels)
            wrong += int((got != np.array(labels, bool)).sum())
    assert blocks > 2000 and wrong / blocks < 0.02


# Pages written by hand, unlike those that the labeller is trained on: markup of common publishing systems, and the texts that are the article.
HAND_MADE = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Rain | The Valley Post</title><script>window.dl=[]</script></head><body class="single single-post">
        <a class="skip-link screen-reader-text" href="#content">Skip to content</a><header id="masthead" class="site-header"><p class="site-title"><a href="/">The Valley Post</a></p>
        <nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li></ul></nav></header>
        <div id="content"><main id="main"><article id="post-12" class="post hentry"><header class="entry-header"><h1 class="entry-title">Rain fills the reservoir at last</h1></header>
        <div class="entry-content"><p>After eleven dry weeks the reservoir above the valley is full again, the water board said on Tuesday.</p><p>&ldquo;We had almost given up,&rdquo; said its engineer, who has measured the level by hand every morning since spring.</p>
        <h2>What happens now</h2><ul><li>Hoses may be used again from Friday.</li><li>Meters stay in place until autumn.</li></ul></div></article>
        <section id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>About time too!</p></li><li class="comment"><p>My garden says thanks.</p></li></ol></section></main>
        <aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Most read</h2><ul><li><a href=/a>Bridge closed</a></li><li><a href=/b>New baker in town</a></li></ul></section></aside></div>
        <footer id="colophon" class="site-footer"><div class="site-info">Proudly printed since 1901</div></footer></body></html>""",
        "Rain fills the reservoir at last After eleven dry weeks the reservoir above the valley is full again, the water board said on Tuesday. \u201cWe had almost given up,\u201d said its engineer, who has measured the level by hand every morning since spring. What happens now Hoses may be used again from Friday. Meters stay in place until autumn.",
    ),
    (
        """<html><body><div class="cookie-consent"><p>We value your privacy. Choose which cookies we may set.</p><button>Accept all</button><button>Settings</button></div><div class="container"><div class="row"><div class="col-md-8">
        <div class="article-body"><h1>Bread without kneading</h1><p>Mix flour, water, salt and a little yeast the evening before. Leave the bowl on the table.</p><div class="ad-slot"><p>Kitchen scales, now half price.</p></div>
        <p>In the morning the dough has doubled. Fold it twice and let it rest while the oven heats.</p><table><tr><td>Flour</td><td>500 g</td></tr><tr><td>Water</td><td>380 g</td></tr></table><blockquote>Time does the work that arms would do.</blockquote></div></div>
        <div class="col-md-4 sidebar"><h4>Newsletter</h4><form><label>Email</label><input><button>Subscribe</button></form></div></div></div><div class="footer"><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body></html>""",
        "Bread without kneading Mix flour, water, salt and a little yeast the evening before. Leave the bowl on the table. In the morning the dough has doubled. Fold it twice and let it rest while the oven heats. Flour 500 g Water 380 g Time does the work that arms would do.",
    ),
    (
        """<html><body><nav class="breadcrumb"><a href=/>Docs</a> / <a href=/g>Guide</a></nav><main role="main"><h1>Installing the driver</h1><p>The driver needs a kernel of version five or later.</p><pre>make
        make install</pre><p>If the module does not load, look at the log first:</p><pre>dmesg | tail</pre><h2>Known problems</h2><p>On some boards the second port stays dark until the next start.</p></main>
        <nav class="pagination"><a href=/1>Previous</a><a href=/3>Next</a></nav><footer>Copyright the authors. All rights reserved.</footer></body></html>""",
        "Installing the driver The driver needs a kernel of version five or later. make make install If the module does not load, look at the log first: dmesg | tail Known problems On some boards the second port stays dark until the next start.",
    ),
    (
        """<HTML><BODY><CENTER><TABLE><TR><TD><H2>My uncle's boat</H2><P>It lay in the barn for thirty years, under a sheet that had once been white.<P>We carried it to the lake on a hay cart. It floated.<BR>Nobody had expected that.</TABLE></CENTER></BODY></HTML>""",
        "My uncle's boat It lay in the barn for thirty years, under a sheet that had once been white. We carried it to the lake on a hay cart. It floated. Nobody had expected that.",
    ),
    (
        """<html><body><div id="wrapper"><div id="header"><h2><a href="/">Wanderfreunde</a></h2></div><div id="menu"><ul><li><a href=/t>Touren</a></li><li><a href=/k>Kontakt</a></li></ul></div><div id="content"><h1>Von der H&uuml;tte zum Gipfel</h1>
        <p>Der Weg beginnt hinter der H&uuml;tte und steigt gleich steil an. Nach einer Stunde erreicht man den Sattel.</p><p>Oben sieht man bei klarem Wetter bis zum See. F&uuml;r den Abstieg sollte man zwei Stunden rechnen.</p><div class="share">Teilen: <a href=#>Mail</a></div></div>
        <div id="footer">&copy; Wanderfreunde &ndash; Alle Rechte vorbehalten</div></div></body></html>""",
        "Von der H\u00fctte zum Gipfel Der Weg beginnt hinter der H\u00fctte und steigt gleich steil an. Nach einer Stunde erreicht man den Sattel. Oben sieht man bei klarem Wetter bis zum See. F\u00fcr den Abstieg sollte man zwei Stunden rechnen.",
    ),
    (
        """<html><body><div class="topbar">Free delivery on all orders this week</div><div class="story"><h1>The last ferry</h1><p class="lead">The last ferry of the season left at four, with nine passengers and a dog.</p><figure><img src=x><figcaption>The landing stage in the evening.</figcaption></figure>
        <p>From November to March the island is on its own.</p><aside class="related"><h3>More stories</h3><ul><li><a href=/1>The first ferry</a></li><li><a href=/2>The island school</a></li></ul></aside><p>Mail comes by helicopter when the wind allows.</p></div>
        <div class="disqus"><p>I lived there as a child and can confirm the wind part.</p><a href=#>Reply</a></div></body></html>""",
        "The last ferry The last ferry of the season left at four, with nine passengers and a dog. The landing stage in the evening. From November to March the island is on its own. Mail comes by helicopter when the wind allows.",
    ),
]


def test_hand_made_pages():
    """Words of the article that are found, and found words that are of the article, over pages that the generator didn't make."""
    got = htmltext.main_texts(htmltext.trained(), [p for p, _ in HAND_MADE])
    both = found = wanted = 0
    for text, (_, want) in zip(got, HAND_MADE, strict=True):
        a, b = Counter(text.split()), Counter(want.split())
        both, found, wanted = both + sum((a & b).values()), found + sum(a.values()), wanted + sum(b.values())
    exact = sum(text == want for text, (_, want) in zip(got, HAND_MADE, strict=True))
    print(both / wanted, both / found, exact)
    assert both / wanted > 0.95 and both / found > 0.95


def test_extraction_decodes_and_joins():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>"
        '<!-- ad --><div class="ad">Buy now, cheap.</div><article><h1>A  title &amp; more</h1><script>var t="</p>";</script><p>One <b>bo</b>ld&nbsp;word &#233;&lt;x&gt;<br>next.'
        "<p>Second\n\n paragraph of the text, with some words in it.</p></article><footer>&copy; site &middot; all rights reserved</footer></body></html>"
    )
    assert htmltext.main_texts(htmltext.trained(), [page]) == ["A title & more One bold word é<x> next. Second paragraph of the text, with some words in it."]


def test_reader_of_broken_markup():
    assert [b[1] for b in htmltext.blocks("<p>a<p>b <!-- unclosed")] == ["a", "b"]
    assert [b[1] for b in htmltext.blocks("x < y <b title='>'>bold</b> <div>z")] == ["x < y bold", "z"]
    assert [b[1] for b in htmltext.blocks("<style>never closed <p>x")] == []
    assert htmltext.blocks("") == []
    assert htmltext.blocks("<ul><li>a<li>b</ul>")[1][0].endswith("ul/li")


@pytest.mark.parametrize("icon", ['<svg class="icon"/>', "<svg/>", "<math />", "<SVG a='x>y' viewBox=\"0 0 1 1\" hidden />", '<svg class="a" data-x=b />', "<svg><path d='M0'/></svg>", "<svg a=b/><path/></svg>"])
def test_svg_and_math_hide_only_themselves(icon):
    assert [b[1] for b in htmltext.blocks(f"<p>before {icon}after</p><p>next</p>")] == ["before after", "next"]
    assert [b[1] for b in htmltext.blocks(f"<p>a{icon}</p><p>b</p><svg><text>unseen</text></svg><p>c</p>")] == ["a", "b", "c"]


def test_deep_and_broken_pages():
    """Blocks of deeply nested pages cost in proportion to the page; comments that end at once hide nothing; texts that browsers show raw are none of the article."""
    import time

    began = time.monotonic()
    deep = htmltext.blocks("<div>x" * 20_000 + "</p>" * 20_000)
    assert len(deep) == 20_000 and sum(len(b[0]) for b in deep) < 100 * len(deep) * 3 and time.monotonic() - began < 10
    assert [b[1] for b in htmltext.blocks("<p>a<!-->b</p><p>c<!--->d<!-- x -- y --!>e</p>")] == ["ab", "cde"]
    assert [b[1] for b in htmltext.blocks("<p>a</p><textarea><p>typed</textarea><p>b</p>")] == ["a", "b"]


def test_pages_of_any_kind(spark):
    rows = [(1, "u", None, "extra"), (2, None, "", "extra"), (3, "u", "<article><p>" + "words and words. " * 5000 + "</p></article>", "extra"), (3, "u", "<p>", "extra"), (None, None, "plain text", "extra")]
    got = htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert max(r["n_chars"] for r in got) == len(" ".join(["words and words."] * 5000))
    assert htmltext.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients_by_differences():
    found = [(p, t, 0) for p, t in zip(["html/body/p", "html/body/div class:ad/p", "html/body/p", "html/body/nav/ul/li"] * 2, "One two. three Four five six! seven eight nine".split() , strict=False)][:7]
    vocabulary = {t: k for k, t in enumerate(sorted({t for p, _, _ in found for t in htmltext.path_tokens(p)}))}
    model = htmltext.Labeller(vocabulary, 3)
    x = model.inputs(found, [4, 3])
    y = (np.random.default_rng(0).random(7) > 0.5).astype(np.float32)
    _, grad = model.gradients(x, y, [4, 3])
    for name in ("uf", "wb", "pf", "ps", "v", "bf"):
        at = tuple(np.unravel_index(int(np.abs(grad[name]).argmax()), grad[name].shape))
        kept = model.w[name][at]
        loss = []
        for e in (1e-2, -1e-2):
            model.w[name][at] = kept + e
            loss.append(model.gradients(x, y, [4, 3])[0])
        model.w[name][at] = kept
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(float(grad[name][at]), rel=0.05, abs=1e-3)


# op5


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    docs = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\n1 2 3\n", b"", "ünï\n".encode()]
    data = archives.write_arc([(f"http://x/{k}", "1.2.3.4", "20010203040506", "text/html", d) for k, d in enumerate(docs)], version)
    got = list(archives.read_arc(data))
    assert [r["content"] for r in got] == docs and got[0]["ip"] == "1.2.3.4" and got[0]["version"] == version
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(archives.read_arc(data.replace(b"filedesc:", b"filedisk:", 1)))
    headers, block = next(archives.read_warc(archives.to_warc(got[0])))
    assert headers["warc-type"] == "response" and headers["warc-date"] == "2001-02-03T04:05:06Z" and block == docs[0]
    assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body\n\n1 2 3\n").digest()).decode()


def test_records_of_any_bytes():
    """Legacy records are mostly not UTF-8: a Latin-1 page and an image come through as they are, each a gzip member."""
    pages = [("http://x/a", "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>d\u00e9j\u00e0 vu</p>".encode("latin-1")), ("http://x/b", b"HTTP/1.0 200 OK\r\n\r\n" + bytes(range(256)) * 3), ("dns:x", b"20000101\nx. 1 IN A \xff\n")]
    arc = archives.write_arc([(u, "1.2.3.4", "1999123123", "text/html", d) for u, d in pages])
    records = list(archives.read_arc(arc))
    data = archives.member(archives.warcinfo()) + b"".join(archives.member(archives.to_warc(r)) for r in records) + archives.EMPTY_MEMBER
    held = list(archives.members(data))
    assert len(held) == 5 and held[-1] == b""
    got = [x for m in held for x in archives.read_warc(m)]
    assert [h["warc-type"] for h, _ in got] == ["warcinfo", "response", "response", "resource"]
    assert [b for _, b in got[1:]] == [d for _, d in pages] and got[1][0]["warc-date"] == "1999-12-31T23:00:00Z"
    assert len({h["warc-record-id"] for h, _ in got}) == 4
    again = next(archives.read_warc(archives.to_warc(records[0], got[1][0]["warc-record-id"])))
    assert again[0]["warc-refers-to"] == got[1][0]["warc-record-id"] and again[0]["warc-profile"] == archives.PROFILE and again[1].endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(archives.members(data[:-3]))
    with pytest.raises(ValueError):
        list(archives.read_warc(held[1][:-20]))


def test_pages_through_archives(spark):
    rng = random.Random(1)
    html = ["same page", "", None, "<p>é\r\n\r\nWARC/1.0</p>", "long " * 100_000]
    rows = [(k, f"http://h/{k} ü\n", rng.choice(html), "x") for k in range(60)] + [(7, "http://again", "same page", "x"), (59, None, "only here", "x"), (None, "u", "same page", "x"), (None, "u", "nowhere else", "x")]
    rows += [(200, "u", "same page", "x"), (200, "u", "same page", "x")]
    got = archives.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, sha string").repartition(3), archive_bytes=20_000).collect()
    top = {}
    for i, _, h, _ in rows:
        h = h or ""
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        first = top[h or ""]
        again = first >= 0 and (i is None or i < first)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, want)) == sorted(key((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    by_id = defaultdict(set)
    for r in got:
        by_id[r["record_id"]].add((r["page_id"], r["record_type"]))
    assert all(by_id[r["refers_to_id"]] == {(r["refers_to"], "response")} for r in got if r["record_type"] == "revisit")
    assert archives.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_payloads_are_never_revisits(spark):
    got = archives.archive_pages(spark.createDataFrame([(1, "u", "ab", *"xxxx"), (2, "u", "ab", *"xxxx"), (3, "u", "abcd", *"xxxx"), (4, "u", "abcd", *"xxxx")], "page_id long, url string, html string, sha string, refers_to string, n string, top string"), min_bytes=3).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# op3


def flat(lists):
    """Rows of (terms, tf) as the flat arrays that the index takes."""
    row = np.repeat(np.arange(len(lists)), [len(t) for t, _ in lists]).astype(np.int32)
    return row, np.array([x for t, _ in lists for x in t], np.int32), np.array([x for _, f in lists for x in f], np.int32)


def test_search_is_exact():
    rng = random.Random(3)
    v, n = 200, 1500

    def doc():
        t = sorted({min(v - 1, int(rng.paretovariate(0.7))) for _ in range(max(1, int(rng.expovariate(1 / 6))))})
        return t, [rng.randint(1, 4) for _ in t]

    examples = [doc() for _ in range(n)]
    idf = np.log(1 + n / np.maximum(1, np.bincount([x for t, _ in examples for x in t], minlength=v)))
    idf[:40] *= 0.1
    toxic = np.arange(n) % 7 == 0
    index = toxicity.BlockMaxIndex(np.arange(v, dtype=np.uint64), idf, *flat(examples), toxic)
    assert 2 < index.dense.shape[1] < 40  # some terms are light
    dense = np.zeros((n, v))
    for i, (t, f) in enumerate(examples):
        dense[i, t] = (1 + np.log(np.array(f))) * idf[t]
    dense = (dense / np.linalg.norm(dense, axis=1, keepdims=True))[index.order]
    queries = [doc() for _ in range(80)]
    row, term, tf = flat(queries)
    looked = []
    found = index.nearest(np.searchsorted(row, np.arange(81)), term, tf, looked=looked)
    assert np.mean(looked) < 0.8 * index.blocks  # whole blocks are passed over
    for (t, f), (got, cosine) in zip(queries, found, strict=True):
        q = np.zeros(v)
        q[t] = (1 + np.log(np.array(f))) * idf[t]
        s = dense @ (q / np.linalg.norm(q))
        want = np.sort(s)[::-1][: toxicity.K]
        assert cosine == pytest.approx(want[want > 0], abs=3e-6) and cosine == pytest.approx(s[got], abs=3e-6)


def terms_of(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return Counter(words + [f"{w[: toxicity.PREFIX]}*" for w in words if len(w.encode()) > toxicity.PREFIX])


def test_scores_equal_brute_force(spark):
    """Whole texts through the operator, against dense vectors over all terms in plain Python."""
    from textmaker import prose

    rng = random.Random(12)
    rows, labels = [], []
    for k in range(420):
        text = prose(rng, rng.choice([3, 15, 60, 200]))
        if k % 5 == 0:
            text += " " + " ".join(rng.choices(["grimlout", "vexnarl", "zorkpest"], k=rng.randint(1, 3)))
        rows.append((k, text))
        labels.append((k, int(k % 5 == 0)))
    rows += [(1000, "grimlout"), (1001, ""), (1002, None), (1003, "qqqq zzzz")]
    crc = lambda s: zlib.crc32(s.encode()) % 5 == 0
    train = [(k, y) for k, y in labels if not crc(str(k))]
    examples = sorted(k for k, _ in train if not crc(f"calibration:{k}"))
    y, text = dict(labels), dict(rows)
    df = Counter(t for _, x in rows for t in terms_of(x))
    n = Counter(y[k] for k, _ in train)
    base = n[1] / len(train)
    have = Counter(y[k] for k in examples)
    votes = {c: n[c] / have[c] for c in (0, 1)}
    t_sum, all_sum = defaultdict(float), defaultdict(float)
    for k in examples:
        for t in terms_of(text[k]):
            all_sum[t] += votes[y[k]]
            t_sum[t] += votes[y[k]] * y[k]
    df = Counter(t for _, x in rows for t in set(terms_of(x)))
    weight = {}
    for t in all_sum:
        p = (t_sum[t] + toxicity.PRIOR * base) / (all_sum[t] + toxicity.PRIOR)
        weight[t] = math.log(1 + len(rows) / df[t]) * (toxicity.FLOOR + abs(math.log(p / (1 - p)) - math.log(base / (1 - base))))

    def vector(x):
        v = {t: (1 + math.log(f)) * weight[t] for t, f in terms_of(x).items() if t in weight}
        size = math.sqrt(sum(a * a for a in v.values()))
        return {t: a / size for t, a in v.items()}

    known = {k: vector(text[k]) for k in examples}

    def share(x):
        q = vector(x)
        cos = sorted(((sum(a * known[k].get(t, 0) for t, a in q.items()), k) for k in examples), reverse=True)[: toxicity.K]
        v = [(c * c * votes[y[k]], y[k]) for c, k in cos if c > 0]
        return sum(a for a, c in v if c) / sum(a for a, _ in v) if v else None

    fit = [(share(text[k]), y[k]) for k, _ in train if crc(f"calibration:{k}")]
    slope, offset = toxicity.curve(*(np.array(x) for x in zip(*[f for f in fit if f[0] is not None], strict=True)), base)
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    for k, x in rows:
        s = share(x)
        if s is None:
            assert got[k]["score"] == pytest.approx(base) and not got[k]["evidence"], (k, x, got[k])
            continue
        s = min(max(s, 1e-3), 1 - 1e-3)
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-(slope * math.log(s / (1 - s)) + offset))), abs=2e-3)
        assert got[k]["evidence"]  # whoever has an indexed term has neighbours


def test_scores_are_calibrated(spark):
    """On held-out rows whose class is random given a mark, scores agree with frequencies."""
    from textmaker import prose

    rng = random.Random(5)
    rows, labels = [], []
    for k in range(5000):
        mark, chance = rng.choice([("alphamark", 0.9), ("betamark", 0.6), ("gammamark", 0.25), ("", 0.03)])
        rows.append((k, f"{prose(rng, 12)} {mark} {mark} {mark}"))
        labels.append((k, int(rng.random() < chance)))
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    y = dict(labels)
    p, t = np.array([r["score"] for r in got]), np.array([y[r["doc_id"]] for r in got])
    bins = np.minimum((p * 5).astype(int), 4)
    gap = sum(abs(p[bins == b].mean() - t[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    assert gap < 0.1 and abs(p.mean() - t.mean()) < 0.04  # 1000 held-out rows: the gap measured is 0.065


def test_toxicity(spark):
    rng = random.Random(8)
    from textmaker import prose

    bad = ["grimlout", "vexnarl", "Zorkpest"]
    rows, labels = [], []
    for k in range(900):
        text, toxic = prose(rng, rng.randint(20, 120)), k % 4 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "%%%", "en"]))
            text = " ".join(w)
        rows.append((k, text, "x"))
        labels.append((k, 1, int(toxic)))
    rows += [(901, None, "x"), (902, "", "x"), (903, "grimlout vexnarl grimlout", "x"), (903, "grimlout vexnarl grimlout", "x"), (None, "fine words", "x")]
    labels += [(1, 1, 0), (2, None, None), (None, 1, 1), (5000, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = toxicity.score_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert len(held) > 100 and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[903]["predicted"] == 1 and by[903]["evidence"] and by[901]["predicted"] == by[902]["predicted"] == 0 and by[901]["score"] == by[902]["score"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(df, none).first()["score"] == 0.0
    assert toxicity.score_documents(df.limit(0), none).count() == 0
