"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text that share a block-level place in the tag tree. Each block gives a vector of tag-path
tokens (tags, classes, ids, roles; those that training never saw say nothing), hashed words and a few measures; a bidirectional LSTM in numpy reads the page's sequence of vectors and
labels every block as main text or not, so each label depends on the whole page. The labeller is trained here, from a fixed seed, on pages
that ``specimen`` generates with known labels (``SPECIMENS`` of them, a documented bound that does not depend on the data).

Defined cases: a null or empty html gives an empty text; unclosed tags, comments and character references are read as browsers do; html of
any length is read whole; repeated rows give the same text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as htmllib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import table

QUERY = "op1_recurrent_extract"

WORD_DIMS, MEASURES, HIDDEN = 32, 6, 20
OTHERS = WORD_DIMS + MEASURES
LEAST_SEEN = 8
SPECIMENS, EPOCHS, BATCH, SEED = 3000, 6, 24, 11

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object svg math audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section main body html div nav aside header footer form select".split())

#: An svg or math tag that closes itself is empty (a slash that ends an unquoted value closes nothing); others hide all up to their end tag.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:svg|math)(?=[\s/])(?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]++)|[^>=])*?/>|<(script|style|textarea|title|iframe|noscript|template|svg|math)\b(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")


@functools.lru_cache(200_000)
def label_of(tag: str, attributes: str) -> str:
    words = [tag]
    if "=" in attributes:
        for name, value in NAMED.findall(attributes):
            words += [f"{name.lower()}:{p.lower()}" for p in PARTS.findall(value)]
    return " ".join(words)


#: Elements of a path: the outermost and the innermost, so that paths of deeply nested pages stay short.
OUTER, INNER = 8, 24


def extended(path: str, tag: str, attributes: str) -> str:
    """The path with one more element; inline elements are none, and of a long path's elements those in the middle go."""
    if tag in INLINE:
        return path
    longer = f"{path}/{label_of(tag, attributes)}" if path else label_of(tag, attributes)
    if longer.count("/") >= OUTER + INNER:
        levels = longer.split("/")
        longer = "/".join(levels[:OUTER] + levels[-INNER + 1 :])
    return longer


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, characters inside links) of each leaf block that has text, in page order."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []  # tag, and the path down to it
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    linked = 0
    hidden = 0

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            held.clear()
            text = " ".join((htmllib.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((stack[-1][1] if stack else "", text, linked))
        linked = 0

    def drop_to(k: int) -> None:
        nonlocal hidden
        for tag, _ in stack[k:]:
            hidden -= tag in UNSEEN
            open_tags[tag] -= 1
        del stack[k:]

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not hidden:
            held.append(page[a:b])
            if any(x[0] == "a" for x in stack[-4:]):
                linked += b - a

    at = 0
    for m in TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[2])
        if tag not in INLINE and tag != "br":
            flush()
        if tag == "br":
            held.append(" ")
        elif closing:
            if open_tags[tag]:
                drop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        elif tag not in VOID:
            ends = SIBLING.get(tag) or (("p",) if tag in CLOSES_P else ())
            if any(open_tags[t] for t in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        drop_to(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
            if not m[4].endswith("/") or tag not in INLINE:
                stack.append((tag, extended(stack[-1][1] if stack else "", tag, m[4])))
                open_tags[tag] += 1
                hidden += tag in UNSEEN
    text(at, len(page))
    flush()
    return out


@functools.lru_cache(50_000)
def path_tokens(path: str) -> frozenset[str]:
    """Tokens of a path: those of its elements, its last element's tag, and the pair of its last two tags."""
    levels = path.split("/")
    tags = [x.split(" ", 1)[0] for x in levels]
    return frozenset({t for x in levels for t in x.split(" ")} | {"leaf " + tags[-1], "pair " + " ".join(tags[-2:])})


class Inputs:
    """The blocks of some pages: each one's path as a row of ``paths`` (distinct paths by known tokens), and its other features."""

    def __init__(self, found: list[tuple[str, str, int]], lengths: list[int], vocabulary: dict[str, int]):
        distinct: dict[str, int] = {}
        self.path = np.array([distinct.setdefault(p, len(distinct)) for p, _, _ in found], np.int64)
        self.paths = np.zeros((len(distinct), len(vocabulary)), np.float32)
        for p, k in distinct.items():
            self.paths[k, [vocabulary[t] for t in path_tokens(p) if t in vocabulary]] = 1
        self.other = other_features(found, lengths)

    def project(self, w_path: np.ndarray, w_other: np.ndarray) -> np.ndarray:
        return (self.paths @ w_path)[self.path] + self.other @ w_other

    def gradients(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_path = np.zeros((len(self.paths), g.shape[1]), np.float32)
        np.add.at(by_path, self.path, g)
        return self.paths.T @ by_path, self.other.T @ g


def other_features(found: list[tuple[str, str, int]], lengths: list[int]) -> np.ndarray:
    """Hashed words and measures, a row for each block; ``lengths`` has the blocks of each page."""
    x = np.zeros((len(found), OTHERS), np.float32)
    if not found:
        return x
    sizes = np.array([len(t) for _, t, _ in found], np.float32)
    words = np.zeros(len(found), np.float32)
    for a, b, w in tk.each_chunk(pa.array([t for _, t, _ in found], pa.large_string())):
        row = np.repeat(np.arange(b - a), w.count)
        column = (w.hashes(lower=True) >> tk.U64(40)).astype(np.int64) % WORD_DIMS
        got = np.bincount(row * WORD_DIMS + column, minlength=(b - a) * WORD_DIMS).reshape(b - a, WORD_DIMS)
        x[a:b, :WORD_DIMS] = got / np.maximum(1, np.linalg.norm(got, axis=1, keepdims=True))
        words[a:b] = w.count
    x[:, WORD_DIMS] = np.log1p(sizes) / 6
    x[:, WORD_DIMS + 1] = np.log1p(words) / 5
    x[:, WORD_DIMS + 2] = np.minimum(1, np.array([c for _, _, c in found], np.float32) / np.maximum(1, sizes))
    n = np.repeat(np.array(lengths), lengths)
    x[:, WORD_DIMS + 3] = tk.ragged(np.zeros(len(lengths), np.int64), np.array(lengths)) / n
    x[:, WORD_DIMS + 4] = [t[-1] in ".!?:;\"”»" for _, t, _ in found]
    x[:, WORD_DIMS + 5] = [t[0].isupper() for _, t, _ in found]
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def run_direction(z: np.ndarray, mask: np.ndarray, u: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (steps x pages x HIDDEN) from projected inputs z (steps x pages x 4 HIDDEN); padding leaves the state as it is."""
    steps, pages, _ = z.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        a = z[t] + h @ u
        gates = sigmoid(a[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        if trace is not None:
            trace.append((h, c, i, f, o, g, tc, m))
        h, c = np.where(m, h2, h), np.where(m, c2, c)
        out[t] = h * m
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, vocabulary: dict[str, int] | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary or {}
        n = len(self.vocabulary)
        self.w = {}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w |= {f"p{d}": init(n, 4 * HIDDEN) if n else np.zeros((0, 4 * HIDDEN), np.float32), f"w{d}": init(OTHERS, 4 * HIDDEN), f"u{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
        self.w |= {"v": init(2 * HIDDEN, 1), "ps": np.zeros((n, 1), np.float32), "s": np.zeros((OTHERS, 1), np.float32), "c": np.zeros(1, np.float32)}

    def inputs(self, found: list[tuple[str, str, int]], lengths: list[int]) -> Inputs:
        return Inputs(found, lengths, self.vocabulary)

    @staticmethod
    def padded(x: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers by step and page, forwards and backwards, and which of them are real."""
        n = np.array(lengths)
        first = np.cumsum(n) - n
        t = np.arange(n.max())[:, None]
        mask = t < n
        return np.where(mask, first + t, 0), np.where(mask, first + n - 1 - t, 0), mask, n

    def scores(self, x: Inputs, lengths: list[int]) -> np.ndarray:
        """The log odds of main text for each block."""
        fw, bw, mask, _ = self.padded(x, lengths)
        w, h = self.w, np.zeros((len(x.path), 2 * HIDDEN), np.float32)
        for d, rows, part in (("f", fw, slice(0, HIDDEN)), ("b", bw, slice(HIDDEN, None))):
            z = (x.project(w[f"p{d}"], w[f"w{d}"]) + w[f"b{d}"])[rows]
            h[rows[mask], part] = run_direction(z, mask, w[f"u{d}"])[mask]
        return (h @ w["v"] + x.project(w["ps"], w["s"]) + w["c"])[:, 0]

    def gradients(self, x: Inputs, y: np.ndarray, lengths: list[int]) -> tuple[float, dict]:
        fw, bw, mask, _ = self.padded(x, lengths)
        w, h, kept = self.w, np.zeros((len(x.path), 2 * HIDDEN), np.float32), {}
        for d, rows, part in (("f", fw, slice(0, HIDDEN)), ("b", bw, slice(HIDDEN, None))):
            trace: list = []
            z = (x.project(w[f"p{d}"], w[f"w{d}"]) + w[f"b{d}"])[rows]
            h[rows[mask], part] = run_direction(z, mask, w[f"u{d}"], trace)[mask]
            kept[d] = trace
        p = sigmoid((h @ w["v"] + x.project(w["ps"], w["s"]) + w["c"])[:, 0])
        e = ((p - y) / len(y))[:, None]
        grad = {"v": h.T @ e, "c": e.sum(0)}
        grad["ps"], grad["s"] = x.gradients(e)
        dh_out = e @ w["v"].T
        for d, rows, part in (("f", fw, slice(0, HIDDEN)), ("b", bw, slice(HIDDEN, None))):
            u = w[f"u{d}"]
            du, dz_rows = np.zeros_like(u), np.zeros((len(x.path), 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((len(lengths), HIDDEN), np.float32), np.zeros((len(lengths), HIDDEN), np.float32)
            own = dh_out[:, part]
            for t in range(len(rows) - 1, -1, -1):
                h0, c0, i, f, o, g, tc, m = kept[d][t]
                dh = dh + own[rows[t]] * m
                dh2, dc2 = dh * m, dc * m
                dct = dc2 + dh2 * o * (1 - tc * tc)
                da = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), dh2 * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
                du += h0.T @ da
                real = mask[t]
                dz_rows[rows[t][real]] = da[real]
                dh, dc = np.where(m, da @ u.T, dh), np.where(m, dct * f, dc)
            grad |= {f"u{d}": du, f"b{d}": dz_rows.sum(0)}
            grad[f"p{d}"], grad[f"w{d}"] = x.gradients(dz_rows)
        loss = -float(np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        return loss, grad

    def fit(self, pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.008, seed: int = SEED) -> float:
        rng = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step, loss = 0, 0.0
        for _ in range(epochs):
            order = list(range(len(pages)))
            rng.shuffle(order)
            for a in range(0, len(order), batch):
                chosen = [pages[k] for k in order[a : a + batch]]
                lengths = [len(p[0]) for p in chosen]
                x = self.inputs([b for p in chosen for b in p[0]], lengths)
                y = np.array([t for p in chosen for t in p[1]], np.float32)
                loss, grad = self.gradients(x, y, lengths)
                step += 1
                slow = rate * (1 - 0.9 * step / (epochs * -(-len(order) // batch)))
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss


# What sites call their parts, and words that such parts tend to hold.
NAMES = {
    "header": "header site-header masthead page-header topbar top branding banner-top",
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs sub-nav links pagination pager skip-link tabs",
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert alert-info privacy-notice announcement popup modal overlay paywall warning",
    "ad": "ad ads advert advertisement ad-slot ad-container sponsored sponsor promo promotion banner adsbygoogle commercial",
    "side": "sidebar side-bar widget related related-posts recommended trending popular share social tags author-box toc aside rail",
    "form": "search search-form newsletter subscribe signup login contact-form comment-form",
    "comments": "comments comment-list comment reply replies discussion disqus respond reader-comments user-comments",
    "footer": "footer site-footer page-footer bottom copyright legal colophon credits",
    "main": "article content main post entry entry-content post-content article-body story story-body body-text text page-content main-content blog-post",
}
TYPICAL = {
    "header": "home welcome site official blog news daily online",
    "nav": "home about contact products next previous page archive topics more menu",
    "notice": "we use cookies accept consent privacy policy agree settings notice important",
    "ad": "advertisement sponsored buy now sale offer free click here discount",
    "side": "related read more popular share follow us tags posted in trending also",
    "form": "search submit email address name password log in sign up subscribe send",
    "comments": "reply comment says posted ago report like thanks great i think agree",
    "footer": "copyright all rights reserved privacy terms contact © · imprint",
}
OWN_TAG = {"header": "header", "nav": "nav", "side": "aside", "form": "form", "footer": "footer", "notice": "dialog"}


def specimen(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A generated page and its block texts with labels (1: main text)."""
    truth: list[tuple[str, int]] = []
    syllables = [a + b for a in "b c d f g l m n p r s t v th sh".split() for b in "a e i o u er an in on é ö".split()]

    # Main texts of any kind: prose, tables flattened with bars, text full of symbols, shouting, numbers, repeats.
    style = rng.choice([None] * 6 + [lambda w: w + " |", lambda w: w + rng.choice(["***", "###", "&&&", "%%%", "$$$"]), lambda w: w.upper() + "!!", lambda w: str(rng.randint(0, 9999)), lambda w: f"{w} {w} {w}"])

    def words(n: int, role: str | None = None) -> str:
        own = TYPICAL.get(role or "", "").split()
        got = [rng.choice(own) if own and rng.random() < 0.5 else "".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
        if role is None and style:
            got = [style(w) for w in got]
        text = " ".join(got)
        return text[0].upper() + text[1:] + (rng.choice([".", ".", ".", "!", "?", ""]) if role is None or rng.random() < 0.4 else "")

    def say(text: str, label: int) -> str:
        truth.append((" ".join(text.split()), label))
        return htmllib.escape(text, quote=False)

    def named(role: str) -> tuple[str, str]:
        name = rng.choice(NAMES[role].split())
        attribute = rng.choice(["class", "class", "id"])
        more = f" {rng.choice(['box', 'clearfix', 'wide', 'row', 'inner', 'x1'])}" if attribute == "class" and rng.random() < 0.3 else ""
        own = OWN_TAG.get(role)
        if own and rng.random() < 0.55:
            return own, f' {attribute}="{name}{more}"' if rng.random() < 0.4 else ""
        return rng.choice(["div", "div", "section", "aside"] if role in ("ad", "side", "notice") else ["div", "div", "section"]), f' {attribute}="{name}{more}"'

    def other(role: str) -> str:
        tag, at = named(role)
        n = rng.randint(1, 5)
        if role in ("nav", "side") and rng.random() < 0.7:
            inner = "<ul>" + "".join(f'<li><a href="/x">{say(words(rng.randint(1, 4), role), 0)}</a></li>' for _ in range(n + 1)) + "</ul>"
        elif role == "form":
            inner = "".join(f"<label>{say(words(rng.randint(1, 3), role), 0)}</label><input name=q><br><p></p>" for _ in range(n)) + f"<p><button>{say(words(1, role), 0)}</button></p>"
        elif role == "comments":
            inner = f"<h3>{say(words(2, role), 0)}</h3>" + "".join(f'<{t}{rng.choice(["", " class=comment"])}><p>{say(words(rng.randint(4, 50), rng.choice([role, None])), 0)}</p></{t}>' for t in rng.choices(["div", "article", "li"], k=n))
        else:
            # Some notices and adverts read like any other prose: only their place tells them apart.
            prose = None if rng.random() < 0.5 else role
            inner = rng.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<p><a href=/y>{}</a></p>"]).format(say(words(rng.randint(2, 25), prose), 0))
            if rng.random() < 0.3:
                inner += f"<p>{say(words(rng.randint(2, 12), role), 0)}</p>"
        return f"<{tag}{at}>{inner}</{tag}>"

    def main_text() -> str:
        parts = [f"<h1>{say(words(rng.randint(2, 10)), 1)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 25, 40])):
            r = rng.random()
            size = rng.choice([1, 1, 2, 4, 12, 30, 60, 120])
            if r < 0.62:
                body = say(words(size), 1)
                parts.append(rng.choice([f"<p>{body}</p>"] * 4 + [f"<p><b>{body}<br>", f"<div>{body}</div>", f"<p>{body}"]))
            elif r < 0.70:
                parts.append(f"<{(t := rng.choice(['h2', 'h3', 'h4']))}>{say(words(rng.randint(1, 6)), 1)}</{t}>")
            elif r < 0.76:
                parts.append("<ul>" + "".join(f"<li>{say(words(rng.randint(2, 20)), 1)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.82:
                parts.append(f"<{(t := rng.choice(['blockquote', 'pre', 'figcaption', 'dd']))}>{say(words(size), 1)}</{t}>")
            elif r < 0.86:
                cells = "".join(f"<td>{say(words(rng.randint(1, 6)), 1)}</td>" for _ in range(rng.randint(1, 4)))
                parts.append(f"<table><tr>{cells}</tr></table>")
            else:
                parts.append(other(rng.choice(["ad", "side", "form", "notice"])))
        if rng.random() < 0.15:
            parts.append(other("comments"))
        body = "".join(parts)
        how = rng.random()
        if how < 0.45:
            body = f"<article{rng.choice(['', '', ' class=post'])}>{body}</article>"
        elif how < 0.6:
            body = f"<main>{body}</main>"
        elif how < 0.9:
            body = '<{0} {1}="{2}">{3}</{0}>'.format(rng.choice(["div", "section"]), rng.choice(["class", "id"]), rng.choice(NAMES["main"].split()), body)
        return f'<main role="main">{body}</main>' if rng.random() < 0.15 else body

    bare = rng.random() < 0.1  # nothing around the main text
    before = [] if bare else [r for r in ("notice", "header", "nav", "ad", "side") if rng.random() < 0.55]
    rng.shuffle(before)
    after = [] if bare else [r for r in ("side", "comments", "form", "ad", "nav", "notice", "footer") if rng.random() < 0.45]
    body = "".join(other(r) for r in before) + main_text() + "".join(other(r) for r in after)
    if rng.random() < 0.3:
        body = f'<div {rng.choice(["class", "id"])}="{rng.choice(["wrapper", "page", "container", "site", "root"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{body}</body></html>", truth


def labelled(rng: random.Random) -> tuple[list[tuple[str, str, int]], list[int]]:
    """A specimen's blocks with their labels; blocks that hold several texts get the label that all of them have."""
    page, truth = specimen(rng)
    found, labels, k = blocks(page), [], 0
    for _, text, _ in found:
        label = truth[k][1]
        left = len(text)
        while left > 0 and k < len(truth):
            left -= len(truth[k][0]) + (left != len(text))
            k += 1
        labels.append(label)
    return found, labels


@functools.lru_cache(1)
def trained(specimens: int = SPECIMENS, seed: int = SEED) -> Labeller:
    rng = random.Random(seed)
    pages = [x for x in (labelled(rng) for _ in range(specimens)) if x[0]]
    seen = Counter(t for found, _ in pages for p in {b[0] for b in found} for t in path_tokens(p))
    model = Labeller({t: k for k, t in enumerate(sorted(t for t, n in seen.items() if n >= LEAST_SEEN))}, seed)
    model.fit(pages)
    return model


def main_texts(model: Labeller, pages: list[str], at_once: int = 128) -> list[str]:
    """The main text of each page: its blocks of that label, joined by one space."""
    found = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    # Pages of like length go together, so that little of a batch is padding.
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    for a in range(0, len(order), at_once):
        part = order[a : a + at_once]
        lengths = [len(found[k]) for k in part]
        score = model.scores(model.inputs([b for k in part for b in found[k]], lengths), lengths)
        at = 0
        for k in part:
            n = len(found[k])
            out[k] = " ".join(b[1] for b, s in zip(found[k], score[at : at + n], strict=True) if s >= 0)
            at += n
    return out


def extract(vocabulary: dict[str, int], weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(vocabulary)
        model.w = weights
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = main_texts(model, [x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    p = pages.select("page_id", "url", F.col("html"))
    model = model or trained()
    return p.mapInArrow(extract(model.vocabulary, model.w), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
