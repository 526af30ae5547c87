"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements and text runs. Trees that were boosted on generated, labelled pages give
each node the probability that its subtree holds main text, from its tag, attribute tokens, depth, text and link
density of the subtree, and siblings. The most probable labelling in which a kept node has only kept ancestors is
found by one pass up and one down the tree, so a dropped element never holds kept text. Kept runs are the blocks.

Defined results: null, empty or text-free html gives ''; unclosed and stray tags are repaired; repeated rows are
extracted alike; nodes may nest to any depth; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg canvas iframe select textarea button".split())
#: What may stand in a head; anything else ends one that is still open.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes open elements of these kinds, up to a container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = frozenset("ul ol dl table".split())
#: Attribute tokens that speak for and against main text.
GOOD = frozenset("article body content entry main page post story text".split())
BAD = frozenset(
    "ad ads advert advertisement alert banner bar breadcrumb breadcrumbs comment comments consent cookie disqus footer form header login masthead menu meta modal nav navbar "
    "navigation newsletter notice popup promo related replies reply search share sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
TAGS = "article aside body blockquote div footer form h1 h2 header li main nav p section table td ul #run".split()
_TOKEN = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")


class _Page(HTMLParser):
    """Nodes in page order: tag, parent, attribute tokens; runs also have their text, its length and its linked length."""

    def __init__(self, html: str, unclosed: frozenset = frozenset()) -> None:
        """`unclosed`: which of the skipped elements, by their place among these, have no end tag of their own."""
        super().__init__(convert_charrefs=True)
        self.unclosed, self.started, self.skipped, self.left = unclosed, 0, [], set()
        self.tag, self.parent, self.tokens, self.text, self.linked = ["#root"], [-1], [frozenset()], [""], [0]
        self.open: list[tuple[str, int]] = [("#root", 0)]  # tag, node that its text belongs to
        self.counts: dict[str, int] = {}
        self.run: list[str] = []
        self.run_linked = 0
        self.feed(html)
        self.close()
        self._flush()
        self.left.update(self.skipped)

    def _flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.run)).strip()
        if text:
            self._node("#run", self.open[-1][1], frozenset(), text, min(self.run_linked, len(text)))
        self.run, self.run_linked = [], 0

    def _node(self, tag: str, parent: int, tokens: frozenset, text: str = "", linked: int = 0) -> int:
        for to, x in ((self.tag, tag), (self.parent, parent), (self.tokens, tokens), (self.text, text), (self.linked, linked)):
            to.append(x)
        return len(self.tag) - 1

    def _pop(self) -> None:
        tag, _ = self.open[-1]
        if tag in BLOCKS:
            self._flush()
        self.counts[tag] -= 1
        self.open.pop()
        if tag in SKIPPED and tag != "head":
            self.left.add(self.skipped.pop())

    def _leave_head(self, tag: str) -> None:
        """Ends an open head at what can't stand in it; a body ends whatever is open in it too."""
        if self.counts.get("head") and tag not in _IN_HEAD and (tag == "body" or not self._within()):
            while self.counts["head"]:
                self._pop()

    def _within(self) -> bool:
        """Whether a skipped element other than head is open."""
        return any(self.counts.get(x) for x in SKIPPED if x != "head")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._leave_head(tag)
        if tag == "br":
            self.run.append(" ")
            return
        if tag in VOID and tag != "hr":
            return
        if self.unclosed and (tag in BLOCKS or self.counts.get(tag) and tag in SKIPPED):  # one without an end tag holds no block, nor its like
            while self.unclosed.intersection(self.skipped):
                self._pop()
        if tag in BLOCKS:
            if self.counts.get("p"):  # a block ends an open paragraph
                k = len(self.open) - 1
                while self.open[k][0] != "p" and (self.open[k][0] not in BLOCKS):
                    k -= 1
                if self.open[k][0] == "p":
                    while len(self.open) > k:
                        self._pop()
            closes = _CLOSES.get(tag)
            if closes and any(self.counts.get(x) for x in closes):
                k = len(self.open) - 1
                last = None
                while k > 0 and self.open[k][0] not in _SCOPE:
                    last = k if self.open[k][0] in closes else last
                    k -= 1
                while last is not None and len(self.open) > last:
                    self._pop()
            self._flush()
            if tag == "hr":
                return
            words = " ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
            node = self._node(tag, self.open[-1][1], frozenset(_TOKEN.findall(words)) if words else frozenset())
        else:
            node = self.open[-1][1]
        self.open.append((tag, node))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in SKIPPED and tag != "head":
            self.skipped.append(self.started)
            self.started += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.counts.get("p"):
            self._flush()
        if not self.counts.get(tag):
            return
        if tag not in BLOCKS and tag not in SKIPPED:  # an inline end tag doesn't reach through a block
            k = len(self.open) - 1
            while self.open[k][0] not in BLOCKS and self.open[k][0] != tag and k:
                k -= 1
            if self.open[k][0] != tag:
                return
        while self.open[-1][0] != tag:
            self._pop()
        own = self.skipped[-1] if tag in SKIPPED and tag != "head" else None
        self._pop()
        self.left.discard(own)

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._leave_head("#text")
        if any(self.counts.get(x) for x in SKIPPED):
            return
        self.run.append(data)
        if self.counts.get("a"):
            self.run_linked += len(data.strip())


N_FEATURES = len(TAGS) + 20


def features(page: _Page) -> np.ndarray:
    """One row for each node."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.array([len(t) for t in page.text], float)
    text, linked = own.copy(), np.array(page.linked, float)
    marks = np.array([sum(map(t.count, ".,;:!?")) for t in page.text], float)
    runs, paragraphs = (own > 0).astype(float), np.array([t == "p" for t in page.tag], float)
    index, children = np.zeros(n), np.zeros(n)
    depth, good, bad = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        k = parent[i]
        for x in (text, linked, marks, runs, paragraphs):
            x[k] += x[i]
    own_good = np.array([len(t & GOOD) for t in page.tokens], float)
    own_bad = np.array([len(t & BAD) for t in page.tokens], float)
    structural = np.array([t in ("nav", "header", "footer", "aside", "form", "menu") for t in page.tag], float)
    core = np.array([t in ("article", "main") for t in page.tag], float)
    under, inside = structural.copy(), core.copy()
    for i in range(1, n):
        k = parent[i]
        depth[i], good[i], bad[i] = depth[k] + 1, good[k] + own_good[k], bad[k] + own_bad[k]
        under[i] += under[k]
        inside[i] += inside[k]
        index[i], children[k] = children[k], children[k] + 1
    up = np.maximum(parent, 0)
    core_in = core.copy()
    for i in range(n - 1, 0, -1):
        core_in[parent[i]] += core_in[i]
    one_hot = np.array([[t == x for x in TAGS] for t in page.tag], float)
    siblings = children[up]
    more = np.stack([
        depth, np.log1p(text), linked / np.maximum(text, 1), marks / np.maximum(text, 1) * 100, np.log1p(runs), text / np.maximum(runs, 1), np.log1p(paragraphs),
        own_good, own_bad, good, bad, structural, under, inside, core_in, text / np.maximum(text[up], 1), text / max(text[0], 1), index / np.maximum(siblings, 1), np.log1p(siblings),
        text[up] / np.maximum(runs[up], 1),
    ], axis=1)
    return np.concatenate([one_hot, more], axis=1)


class Trees:
    """Boosted trees of fixed depth on binned features, for the logistic loss."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> None:
        self.n_trees, self.depth, self.rate, self.bins = n_trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
        inner = 2**self.depth - 1
        self.feature, self.cut = np.zeros((self.n_trees, inner), np.int64), np.full((self.n_trees, inner), np.inf)
        self.leaf = np.zeros((self.n_trees, inner + 1))
        p = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(n, self.start)
        for t in range(self.n_trees):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best, choice = np.full(width, 1e-6), [None] * width
                place = at - first
                for j in range(d):
                    size = len(cuts[j]) + 1
                    if size == 1:
                        continue
                    cell = place * size + binned[:, j]
                    gs = np.bincount(cell, g, width * size).reshape(width, size).cumsum(axis=1)
                    hs = np.bincount(cell, h, width * size).reshape(width, size).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    k = gain[:, :-1].argmax(axis=1)
                    for w in np.flatnonzero(gain[np.arange(width), k] > best):
                        best[w], choice[w] = gain[w, k[w]], (j, k[w])
                for w, c in enumerate(choice):
                    if c:
                        self.feature[t, first + w], self.cut[t, first + w] = c[0], cuts[c[0]][c[1]]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.cut[t, at])
            leaf = at - inner
            self.leaf[t] = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            raw += self.leaf[t][leaf]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        raw, rows, inner = np.full(len(x), self.start), np.arange(len(x)), self.feature.shape[1]
        for t in range(self.n_trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            raw += self.leaf[t][at - inner]
        return raw


def decode(parent: list[int], logits: np.ndarray) -> np.ndarray:
    """The most probable labelling in which kept nodes have kept ancestors only: keeping a node is worth its logit and
    the worth of the children that are worth keeping."""
    worth = logits.copy()
    for i in range(len(parent) - 1, 0, -1):
        if worth[i] > 0:
            worth[parent[i]] += worth[i]
    kept = np.zeros(len(parent), bool)
    kept[0] = True
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and worth[i] > 0
    return kept


def _extract(pages: list[_Page], trees: Trees) -> list[str]:
    rows = [features(p) for p in pages]
    logits = trees.logits(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for page, x in zip(pages, rows):
        kept = decode(page.parent, logits[at : at + len(x)])
        at += len(x)
        out.append("\n\n".join(t for t, k in zip(page.text, kept) if k and t))
    return out


# -- generated pages, for training and for held-out tests

_MARK = "\x01"  # begins every text of main content in a generated page


def generated(seed: int) -> tuple[str, str]:
    """A page and its main text. Layouts, tags, attribute names and lengths vary; text is invented."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u en or is".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: words(r.randint(3, 18)).capitalize() + r.choice([".", ".", ".", "?", ",", ""])
    link = lambda n: f'<a href="/{word()}">{words(n)}</a>'
    links = lambda n: "<ul>" + "".join(f"<li>{link(r.randint(1, 2))}</li>" for _ in range(n)) + "</ul>"
    main: list[str] = []

    def content(text: str) -> str:
        main.append(text)
        return _MARK + text

    def passage(lo: int, hi: int) -> str:
        return " ".join(sentence() for _ in range(r.randint(lo, hi)))

    def block() -> str:
        kind = r.random()
        if kind < 0.7:
            text = content(passage(1, r.choice([1, 3, 8, 40])))
            return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><em>{text}</em></p>", f'<p>{text} </p>'])
        if kind < 0.8:
            return "<ul>" + "".join(f"<li>{content(passage(1, 2))}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if kind < 0.9:
            level = r.choice("234")
            return f"<h{level}>{content(words(r.randint(1, 6)))}</h{level}>"
        if kind < 0.95:
            return f"<blockquote>{content(passage(1, 3))}</blockquote>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{content(words(2))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"

    def noise() -> str:
        kind, name = r.randrange(9), r.choice(["", "box", "top", "x1"])
        if kind == 0:
            return r.choice([f"<nav>{links(r.randint(2, 9))}</nav>", f'<div class="menu {name}">{links(r.randint(2, 9))}</div>', f'<ul class="navbar">{"".join(f"<li>{link(1)}</li>" for _ in range(5))}</ul>'])
        if kind == 1:
            text = passage(1, 4)
            return r.choice([f'<div class="ad">{text}</div>', f'<div id="ad-{name}">{text}</div>', f'<section class="sponsored"><p>{text}</p></section>', f'<div class="promo banner">{link(4)}</div>'])
        if kind == 2:
            return r.choice([f"<aside>{f'<p>{passage(1, 3)}</p>'}{links(3)}</aside>", f'<div class="sidebar"><h3>{words(2)}</h3>{links(5)}</div>', f"<aside><p>{passage(1, 5)}</p></aside>"])
        if kind == 3:
            return r.choice([f'<div class="cookie notice"><p>{passage(1, 2)}</p></div>', f'<div role="alert" class="consent">{passage(1, 2)}</div>', f'<p class="notice">{passage(1, 1)}</p>'])
        if kind == 4:
            return f"<form><label>{words(2)}</label><input><button>{word()}</button><p>{passage(1, 1)}</p></form>"
        if kind == 5:
            return f'<div class="{r.choice(["comments", "comment-list", "replies"])}" id="comments"><h3>{words(1)}</h3>' + "".join(r.choice([f'<div class="comment"><p>{passage(1, 4)}</p></div>', f'<article class="comment"><p>{passage(1, 3)}</p></article>']) for _ in range(r.randint(1, 6))) + "</div>"
        if kind == 6:
            return f'<div class="{r.choice(["related", "share social", "newsletter", "tags"])}">{r.choice([links(4), "<p>" + passage(1, 2) + "</p>"])}</div>'
        if kind == 7:
            return f"<script>var {word()} = '</p>';</script><style>p{{margin:0}}</style><!-- {words(3)} -->"
        return f'<div class="breadcrumbs">{link(1)} &gt; {link(1)}</div>'

    # the heading may stand in the article or before it
    title = words(r.randint(2, 9)).capitalize()
    inner = [f"<h1>{content(title)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 2, 4, 8, 20])):
        inner.append(block())
        if r.random() < 0.08:
            inner.append(noise())
    body = "".join(inner)
    body = r.choice([
        f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f'<main><article class="post">{body}</article></main>', f'<div class="content">{body}</div>',
        f'<div id="main"><div class="entry-content">{body}</div></div>', f'<section class="story">{body}</section>', f'<div><div>{body}</div></div>',
    ])
    before = [noise() for _ in range(r.randint(0, 4))]
    after = [noise() for _ in range(r.randint(0, 4))]
    if r.random() < 0.7:
        before.insert(0, r.choice([f"<header><p>{words(3)}</p>{links(4)}</header>", f"<nav>{links(6)}</nav>", f'<div class="header">{words(4)}</div>']))
    if r.random() < 0.8:
        after.append(r.choice([f"<footer>&copy; {passage(1, 2)}</footer>", f'<div class="footer"><p>{passage(1, 2)}</p></div>', f"<footer>&copy; {word()}.example &middot; {passage(1, 2)}</footer>"]))
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
    return page, "\n\n".join(" ".join(x.split()) for x in main if x.split())


@lru_cache(maxsize=1)
def trained(pages: int = 500, seed: int = 1) -> Trees:
    """Trees fitted on `pages` generated pages: a bounded sample, whatever the size of the input."""
    xs, ys = [], []
    for k in range(pages):
        page = _Page(generated(seed * 1_000_003 + k)[0])
        label = np.array([_MARK in t for t in page.text], float)
        page.text = [t.replace(_MARK, "").strip() for t in page.text]
        for i in range(len(label) - 1, 0, -1):
            label[page.parent[i]] = max(label[page.parent[i]], label[i])
        xs.append(features(page)[1:])
        ys.append(label[1:])
    return Trees().fit(np.concatenate(xs), np.concatenate(ys))


def _parsed(html: str) -> _Page:
    """The page; where skipped elements had no end tag, parsed once more with that known."""
    page = _Page(html)
    return _Page(html, frozenset(page.left)) if page.left else page


def main_text(html: list[str | None], trees: Trees) -> list[str]:
    return _extract([_parsed(h or "") for h in html], trees)


def main_texts(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages` (page_id, url, html)."""
    model = trees or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_text(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
