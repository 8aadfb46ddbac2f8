"""HTML extraction by a recurrent block labeller.

A page becomes its leaf blocks in order: the text between block-level tags, with the path of open
elements (tags, classes, ids, roles). Each block is a vector: hashed path marks, hashed words and a
few counts. A bidirectional LSTM in numpy reads the page's blocks and labels each as main text or
not, with the whole page as context.

No page is labelled, so the labeller learns from pages whose structure names its parts, a bounded
sample of the table, and from layouts put together from common ways of naming parts, filled with
the sample's words as articles, link lists, notices or comments are written. Most are learned twice,
the second time with names and structural tags taken away, so that what a page's text, links and
order tell is learned too. It labels pages by what it has learned, not by those names.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# ---- pages to blocks -----------------------------------------------------------------------

_MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: The rest of a tag: a quote matters after "=" only, and not if nothing ends it. Possessive, so no place is tried twice.
_TAG_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
#: Elements whose inside is no text; those in _TO_END last to the end of the page if nothing ends them, others are then mere tags.
_RAW = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?>", re.I) for t in "script style template textarea svg iframe select title".split()}
_TO_END = frozenset(("script", "style"))
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes open elements of these kinds first, up to the barrier.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


PATH_DIMS, WORD_DIMS, COUNT_DIMS = 96, 32, 6
DIMS = PATH_DIMS + WORD_DIMS + COUNT_DIMS
#: As in browsers, elements deeper than this are siblings of their parents.
DEEPEST = 512


class Element:
    """An open element: tag, marks, the elements above it and the sum of their path features."""

    __slots__ = ("tag", "marks", "above", "depth", "features", "kids")

    def __init__(self, above: Element | None, tag: str, marks: tuple):
        self.tag, self.marks, self.above = tag, marks, above
        self.depth = above.depth + 1 if above else 0
        self.features = above.features + _path_features(tag, marks) if above else np.zeros(PATH_DIMS, dtype=np.float32)
        self.kids: dict = {}

    def child(self, tag: str, attributes: str) -> Element:
        """Siblings of like tag and attributes are one element: their paths are the same."""
        got = self.kids.get((tag, attributes))
        if got is None:
            if len(self.kids) > 256:
                self.kids.clear()
            got = self.kids[tag, attributes] = Element(self, *_marks(tag, attributes))
        return got

    def path(self) -> list[tuple[str, tuple]]:
        at, out = self, []
        while at.above:
            out.append((at.tag, at.marks))
            at = at.above
        return out[::-1]


class Block:
    """Text of a leaf block, the element it stands in, and how many of its characters are links."""

    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked

    @property
    def path(self) -> list[tuple[str, tuple]]:
        return self.element.path()


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple:
    words = []
    for name, *values in _ATTR.findall(attributes):
        for w in re.split(r"[\s_-]+", " ".join(values).strip().lower()):
            if w:
                words.append(f"{name.lower()}={w}")
                words.append(f"word={w}")
    return (tag, tuple(words))


def page_blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order. Comments and what _RAW names are no text.

    A page is read once from front to back. A tag that nothing ends takes the rest of the page, as in
    browsers; one whose ending is only found inside quotes ends there, and from then on quotes don't count.
    """
    page = page or ""
    blocks: list[Block] = []
    stack: list[Element] = [Element(None, "", ())]
    opened: Counter = Counter()
    too_deep: Counter = Counter()
    parts: list[str] = []
    linked = in_link = 0
    quotes = True

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    at, n = 0, len(page)
    unended = set()
    while m := _MARKUP.search(page, at):
        start, name = m.start(), m[2]
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = m.end()
        if not name:
            end = page.find("-->", at - 2) if page.startswith("<!--", start) else page.find(">", at)
            at = n if end < 0 else end + (3 if page.startswith("<!--", start) else 1)
            continue
        rest = _TAG_REST.match(page, at) if quotes else None
        if rest:
            end = rest.end()
        else:
            quotes = False
            end = page.find(">", at) + 1 or n + 1
        attributes, at = page[at : end - 1], min(end, n)
        tag, ends = name.lower(), m[1]
        if tag in _RAW and not ends and tag not in unended:
            empty = tag == "svg" and attributes.endswith("/")
            end = None if empty else _RAW[tag].search(page, at)
            if empty or end or tag in _TO_END:
                at = at if empty else end.end() if end else n
                parts.append(" ")
                continue
            unended.add(tag)
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag in ("br", "wbr", "img"):
                parts.append(" ")
            continue
        close()
        in_link = 0
        if ends:
            if too_deep[tag]:
                too_deep[tag] -= 1
            elif opened[tag]:
                while (gone := stack.pop().tag) != tag:
                    opened[gone] -= 1
                opened[tag] -= 1
            continue
        closes = _CLOSES.get(tag, ("p",) if tag in _ENDS_P else ())
        while stack[-1].tag in closes:
            opened[stack.pop().tag] -= 1
        if tag not in VOID and not attributes.endswith("/"):
            if len(stack) <= DEEPEST:
                stack.append(stack[-1].child(tag, attributes))
                opened[tag] += 1
            else:
                too_deep[tag] += 1
    if at < n:
        parts.append(page[at:])
    close()
    return blocks


# ---- blocks to vectors ---------------------------------------------------------------------

@lru_cache(maxsize=16384)
def _path_features(tag: str, marks: tuple) -> np.ndarray:
    v = np.zeros(PATH_DIMS, dtype=np.float32)
    for name in (f"<{tag}", *marks):
        h = zlib.crc32(name.encode())
        v[h % PATH_DIMS] += 1.0 if h & 0x10000 else -1.0
        v[(h >> 17) % PATH_DIMS] += 1.0 if h & 0x8000 else -1.0
    return v


class _WordSlots(dict):
    """Slot of a word, upper half for a negative sign; a cache that starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = zlib.crc32(word.lower().encode())
        self[word] = slot = h % WORD_DIMS + (0 if h & 0x10000 else WORD_DIMS)
        return slot


_word_slots = _WordSlots()


def block_vectors(blocks: list[Block], lo: int = 0, hi: int | None = None, mask: NameMask | None = None) -> np.ndarray:
    """Vectors of blocks lo to hi of a page; with a mask, as if the page's names were others."""
    part = blocks[lo:hi]
    x = np.zeros((len(part), DIMS), dtype=np.float32)
    for i, b in enumerate(part):
        x[i, :PATH_DIMS] = mask.features(b.element) if mask else b.element.features
        words = b.text.split(" ")
        seen = np.bincount([_word_slots[w] for w in words], minlength=2 * WORD_DIMS)
        v = seen[:WORD_DIMS] - seen[WORD_DIMS:]
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = v / max(1.0, float(np.sqrt((v * v).sum())))
        n = len(b.text)
        x[i, -COUNT_DIMS:] = (np.log1p(n) / 6, min(1.0, b.linked / n), len(words) / 50 if len(words) < 50 else 1.0, sum(map(b.text.count, ".!?")) / (1 + len(words)), b.element.depth / 8, (lo + i) / max(1, len(blocks) - 1))
    x[:, :PATH_DIMS] = np.clip(x[:, :PATH_DIMS], -3, 3) / 2
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] *= 0.3
    return x


#: Tags that say what a part is for.
_TELLING_TAGS = frozenset("article main nav aside footer header section form menu dialog button label address figure".split())


class NameMask:
    """A page's paths without telling names: structural tags are div, marks are gone or mean nothing."""

    def __init__(self, r: np.random.Generator):
        self.r, self.bare, self.names, self.known = r, r.random() < 0.5, {}, {}

    def features(self, element: Element) -> np.ndarray:
        if not element.above:
            return element.features
        got = self.known.get(id(element))
        if got is None:
            if element.marks and element.marks not in self.names:
                word = f"q{self.r.integers(1 << 30)}"
                self.names[element.marks] = () if self.bare else (f"class={word}", f"word={word}")
            got = self.features(element.above) + _path_features("div" if element.tag in _TELLING_TAGS else element.tag, self.names.get(element.marks, ()))
            self.known[id(element)] = got
        return got


# ---- the network ---------------------------------------------------------------------------

HIDDEN = 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs, one in each direction, and a logistic layer over both states at each block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (r.standard_normal((DIMS, 4 * HIDDEN)) / np.sqrt(DIMS)).astype(np.float32)
            self.p[f"U{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["v"] = (r.standard_normal(2 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
        self.p["c"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States for x (time, page, dims); a masked step carries the state on. d: 'f' or 'b'."""
        t_max, n, _ = x.shape
        pre = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
        out, tape = np.zeros((t_max, n, HIDDEN), dtype=np.float32), []
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = pre[t] + h @ self.p[f"U{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            tape.append((t, h, c, i, f, o, g, tc, on))
            c = np.where(on, new_c, c)
            h = np.where(on, o * tc, h)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        (hf, tf), (hb, tb) = self._run(x, mask, "f"), self._run(x, mask, "b")
        both = np.concatenate((hf, hb), axis=2)
        return _sigmoid(both @ self.p["v"] + self.p["c"][0]), (both, tf, tb)

    def _back(self, x: np.ndarray, tape: list, d: str, dout: np.ndarray, grads: dict) -> None:
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t, h0, c0, i, f, o, g, tc, on in reversed(tape):
            dh = dh + dout[t]
            dht, dct = np.where(on, dh, 0), np.where(on, dc, 0)
            dct = dct + dht * o * (1 - tc * tc)
            dz = np.concatenate((dct * g * i * (1 - i), dct * c0 * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)), axis=1)
            dz_all[t] = dz
            grads[f"U{d}"] += h0.T @ dz
            dh = np.where(on, dz @ self.p[f"U{d}"].T, dh)
            dc = np.where(on, dct * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"W{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"b{d}"] += flat.sum(axis=0)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss over the blocks, and its gradients."""
        p, (both, tf, tb) = self.forward(x, mask)
        n = max(1, mask.sum())
        loss = -float((np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / n)
        d = ((p - y) * mask / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["v"] = np.einsum("tn,tnh->h", d, both)
        grads["c"] = np.array([d.sum()], dtype=np.float32)
        dboth = d[:, :, None] * self.p["v"]
        self._back(x, tf, "f", dboth[:, :, :HIDDEN], grads)
        self._back(x, tb, "b", dboth[:, :, HIDDEN:], grads)
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 16, batch: int = 32, rate: float = 0.02, seed: int = 3) -> float:
        """Adam at a falling rate over shuffled batches of pages of like length. The last epoch's loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        batches = [order[a : a + batch] for a in range(0, len(order), batch)]
        step, mean = 0, 0.0
        for epoch in range(epochs):
            slow = rate * (1.0 - 0.95 * epoch / epochs)
            losses = []
            for k in r.permutation(len(batches)):
                x, mask, y = stack_pages([pages[q] for q in batches[k]])
                loss, grads = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                for name, g in grads.items():
                    m[name] += 0.1 * (g - m[name])
                    s[name] += 0.01 * (g * g - s[name])
                    self.p[name] -= (slow * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses)) if losses else 0.0
        return mean

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions take from each block: all that labelling needs of it."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"], axis=1)

    def _logits(self, pre: np.ndarray, mask: np.ndarray, d: str) -> np.ndarray:
        """One direction's share of the logit of each (time, page); keeps no states but the last."""
        t_max, n, _ = pre.shape
        u, v = self.p[f"U{d}"], self.p["v"][:HIDDEN] if d == "f" else self.p["v"][HIDDEN:]
        h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.zeros((t_max, n), dtype=np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = pre[t] + h @ u
            s = _sigmoid(z[:, : 3 * HIDDEN])
            on = mask[t][:, None]
            new_c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
            c = np.where(on, new_c, c)
            h = np.where(on, s[:, 2 * HIDDEN :] * np.tanh(new_c), h)
            out[t] = h @ v
        return out

    def label_projected(self, pages: list[np.ndarray], limit: int = 20_000) -> list[np.ndarray]:
        """Probability that each block is main text, for each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and len(pages[order[hi]]) * (hi + 1 - lo) <= limit:
                hi += 1
            mine = order[lo:hi]
            longest = len(pages[mine[-1]])
            mask = np.arange(longest)[:, None] < np.array([len(pages[k]) for k in mine])
            logits = np.full(mask.shape, self.p["c"][0], dtype=np.float32)
            for d, half in (("f", slice(0, 4 * HIDDEN)), ("b", slice(4 * HIDDEN, None))):
                pre = np.zeros((*mask.shape, 4 * HIDDEN), dtype=np.float32)
                for col, k in enumerate(mine):
                    pre[: len(pages[k]), col] = pages[k][:, half]
                logits += self._logits(pre, mask, d)
            p = _sigmoid(logits)
            for col, k in enumerate(mine):
                out[k] = p[: len(pages[k]), col]
            lo = hi
        return out

    def label(self, pages: list[np.ndarray], limit: int = 20_000) -> list[np.ndarray]:
        """As label_projected, from block vectors."""
        return self.label_projected([self.project(x) for x in pages], limit)

    def label_blocks(self, pages: list[list[Block]], limit: int = 20_000, step: int = 4096) -> list[np.ndarray]:
        """As label, from blocks; vectors of a long page are made and projected a few thousand at a time."""
        empty = np.zeros((0, 8 * HIDDEN), dtype=np.float32)
        return self.label_projected([np.concatenate([self.project(block_vectors(b, lo, lo + step)) for lo in range(0, len(b), step)] or [empty]) for b in pages], limit)


def stack_pages(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max((len(y) for _, y in pages), default=0)
    x = np.zeros((longest, len(pages), DIMS), dtype=np.float32)
    mask, y = np.zeros((longest, len(pages)), dtype=bool), np.zeros((longest, len(pages)), dtype=np.float32)
    for k, (a, b) in enumerate(pages):
        x[: len(b), k], mask[: len(b), k], y[: len(b), k] = a, True, b
    return x, mask, y


# ---- what it learns from -------------------------------------------------------------------

_ASIDE_TAGS = frozenset("nav aside footer form button menu dialog header".split())
_ASIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header login masthead menu nav navbar navigation newsletter notice popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_MAIN_TAGS = frozenset(("article", "main"))
_MAIN_WORDS = frozenset("article content entry main post story".split())
SAMPLE_PAGES = 300
LAYOUT_PAGES = 700
#: Blocks of a page that are learned from, at most; labelling has no such limit.
LEARN_BLOCKS = 60


def named_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks inside an element that says it's the article, unless inside one that says it isn't.

    None if the page names no article.
    """
    labels = np.zeros(len(blocks), dtype=np.float32)
    seen = False
    for i, b in enumerate(blocks):
        state = 0
        for tag, marks in b.path:
            words = {m[5:] for m in marks if m.startswith("word=")}
            if tag in _ASIDE_TAGS or words & _ASIDE_WORDS:
                state = -1
            elif state == 0 and (tag in _MAIN_TAGS or words & _MAIN_WORDS):
                state = 1
        labels[i] = state > 0
        seen |= state > 0
    return labels if seen else None


_MAIN_OPEN = ['<article>', '<main><article class="post">', '<main>', '<div class="content">', '<div id="content">', '<div class="post">', '<section class="story">', '<div class="article-body">', '<div class="entry-content">', '<div role="main">', '<div id="main">']
_ASIDE_OPEN = {
    "menu": ['<nav>', '<nav class="main-nav">', '<ul class="menu">', '<div class="navbar">', '<div id="nav">', '<div class="breadcrumb">', '<div role="navigation">'],
    "top": ['<header>', '<div class="header">', '<div id="header">', '<header class="site-header">'],
    "side": ['<aside>', '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<div class="widget">'],
    "notice": ['<div class="cookie-notice">', '<div class="cookie">', '<div class="notice">', '<div id="cookie-banner">', '<div class="consent">', '<div role="alert">', '<div class="newsletter">', '<div class="popup">'],
    "ad": ['<div class="ad">', '<div class="advert">', '<div class="ads">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div class="banner">', '<div class="advertisement">', '<div id="ad-1">'],
    "form": ['<form>', '<form class="search">', '<form action="/subscribe">', '<div class="login"><form>'],
    "comments": ['<section class="comments">', '<div id="comments">', '<div class="comments">', '<ol class="comment-list">', '<div class="comment">', '<section id="comments">'],
    "bottom": ['<footer>', '<div class="footer">', '<div id="footer">', '<footer class="site-footer">'],
}


#: Words that such parts often have, in no order.
_ASIDE_TALK = {
    "notice": "we use cookies consent accept privacy policy agree subscribe newsletter wir verwenden nous utilisons usamos".split(),
    "ad": "sponsored advertisement offer buy now sale anzeige publicité anuncio shop free".split(),
    "form": "name email search password submit send login suche chercher buscar".split(),
    "comments": "comment comments reply says wrote likes kommentar commentaire comentario ago posted".split(),
    "bottom": "copyright all rights reserved terms privacy imprint contact about impressum".split(),
    "top": "home welcome blog news".split(),
    "side": "related popular latest tags archive more read".split(),
    "menu": "home about contact news products services".split(),
}


def _closing(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opened)))


class LayoutWriter:
    """Parts of made-up pages, filled as such parts are written: articles in sentences, menus in links, and so on."""

    def __init__(self, words: list[str], seed: int):
        self.r, self.words = np.random.default_rng(seed), words or ["word"]

    def some(self, lo: int, hi: int, kind: str = "") -> str:
        """lo to hi words, half of the time with some of the part's own."""
        r, own = self.r, _ASIDE_TALK.get(kind)
        k = int(r.integers(lo, hi + 1))
        mixed = bool(own) and r.random() < 0.5
        return html.escape(" ".join(own[r.integers(len(own))] if mixed and r.random() < 0.4 else self.words[r.integers(len(self.words))] for _ in range(k)))

    def sentences(self, lo: int, hi: int, kind: str = "") -> str:
        out = []
        for _ in range(int(self.r.integers(lo, hi + 1))):
            t = self.some(3, 24, kind)
            out.append(t[:1].upper() + t[1:] + ".!?.."[self.r.integers(5)])
        return " ".join(out)

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.integers(1000)}">{text}</a>'

    def aside(self, kind: str) -> str:
        r = self.r
        opened = _ASIDE_OPEN[kind][r.integers(len(_ASIDE_OPEN[kind]))]
        links = [self.link(self.some(1, 3, kind)) for _ in range(int(r.integers(2, 9)))]
        listed = "".join(f"<li>{x}</li>" for x in links) if "<ul" in opened else f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>" if r.random() < 0.6 else " | ".join(links)
        if kind == "menu":
            inside = listed
        elif kind == "form":
            inside = f"<label>{self.some(1, 3, kind)}</label><input><button>{self.some(1, 2, kind)}</button>"
        elif kind == "comments":
            heading = f"<h3>{self.some(1, 3, kind)}</h3>" if r.random() < 0.6 else ""
            one = [f"<p>{self.some(1, 3, kind)}</p><p>{self.sentences(1, 3, kind)}</p>{self.link(self.some(1, 1, kind))}", f"<p>{self.some(3, 40, kind)}</p>", f'<div class="comment">{self.sentences(1, 3, kind)}</div>', f"<p>{self.sentences(1, 2, kind)}</p>"]
            which = one[r.integers(len(one))]
            inside = heading + "".join(which if r.random() < 0.3 else f"<p>{self.sentences(1, 2, kind)}</p>" for _ in range(int(r.integers(1, 6))))
        elif kind == "side":
            inside = [f"<h3>{self.some(1, 4, kind)}</h3>{listed}", f"<p>{self.some(1, 25, kind)}</p>", f"<h4>{self.some(1, 3, kind)}</h4><p>{self.link(self.some(3, 10, kind))}</p>", self.sentences(1, 2, kind)][r.integers(4)]
        elif kind == "bottom":
            inside = [f"&copy; {self.some(1, 12, kind)}", f"<p>&copy; {self.some(1, 5, kind)} &middot; {self.sentences(1, 2, kind)}</p>", listed, f"{self.some(2, 15, kind)}", f"<p>{self.some(1, 8, kind)}</p>{listed}"][r.integers(5)]
        elif kind == "notice":
            inside = self.sentences(1, 2, kind) + (f" <button>{self.some(1, 2, kind)}</button>" if r.random() < 0.5 else "")
        else:
            text = self.some(1, 12, kind) if r.random() < 0.5 else self.sentences(1, 2, kind)
            inside = [text, f"<p>{text}</p>", self.link(text), f"<h2>{self.some(1, 4, kind)}</h2><p>{text}</p>"][r.integers(4)]
        return f"{opened}{inside}{_closing(opened)}"

    def article(self) -> str:
        r = self.r
        main = _MAIN_OPEN[r.integers(len(_MAIN_OPEN))]
        body = [f"<h1>{self.some(1, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(int(r.integers(1, 9))):
            kind = ["p", "p", "p", "p", "h2", "blockquote", "li", "pre", "td", "div"][r.integers(10)]
            text = self.sentences(1, 6) if r.random() < 0.8 else self.some(1, 60)
            if kind == "h2":
                text = self.some(1, 8)
            elif r.random() < 0.1:
                text = f"{text} {self.link(self.some(1, 3))} {self.some(1, 5)}"
            body.append({"li": f"<ul><li>{text}</li><li>{self.some(1, 8)}</li></ul>", "td": f"<table><tr><td>{text}</td><td>{self.some(1, 4)}</td></tr></table>"}.get(kind, f"<{kind}>{text}</{kind}>"))
            if r.random() < 0.12:
                body.append(self.aside(["ad", "side", "notice", "form"][r.integers(4)]))
        return main + "".join(body) + _closing(main)

    def page(self) -> str:
        before = [self.aside(k) for k in ("top", "menu", "notice", "ad", "side") if self.r.random() < 0.5]
        after = [self.aside(k) for k in ("comments", "side", "ad", "form", "notice", "bottom") if self.r.random() < 0.5]
        return "<html><body>" + "".join(before) + self.article() + "".join(after) + "</body></html>"


def layout_pages(words: list[str], n: int = LAYOUT_PAGES, seed: int = 11) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Pages put together from ways of naming and filling parts, with labels."""
    writer = LayoutWriter(words, seed)
    for _ in range(n):
        blocks = page_blocks(writer.page())
        labels = named_labels(blocks)
        if labels is not None:
            yield blocks, labels


def learned_views(pages: list[tuple[list[Block], np.ndarray]], share: float, r: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of each page, and for a share of them once more with names masked."""
    out = []
    for blocks, labels in pages:
        blocks, labels = blocks[:LEARN_BLOCKS], labels[:LEARN_BLOCKS]
        out.append((block_vectors(blocks), labels))
        if r.random() < share:
            out.append((block_vectors(blocks, mask=NameMask(r)), labels))
    return out


def masked_accuracy(net: BiLstm, pages: list[list[Block]], seed: int = 5) -> float:
    """Share of blocks labelled as their names say, on pages whose names are masked."""
    r, right, total = np.random.default_rng(seed), 0, 0
    for blocks in pages:
        labels = named_labels(blocks)
        if labels is not None:
            right += int(((net.label([block_vectors(blocks, mask=NameMask(r))])[0] > 0.5) == (labels > 0)).sum())
            total += len(blocks)
    return right / max(1, total)


def fit_on_pages(texts: list[str]) -> BiLstm:
    """A labeller fitted on the pages that name their article and on LAYOUT_PAGES layouts.

    Of a page at most LEARN_BLOCKS blocks are learned from; 80 words of its first 8 blocks go to layouts.
    """
    named, words = [], []
    for text in texts:
        blocks = page_blocks(text)[:LEARN_BLOCKS]
        words += " ".join(b.text for b in blocks[:8]).split()[:80]
        labels = named_labels(blocks)
        if labels is not None:
            named.append((blocks, labels))
    r = np.random.default_rng(19)
    net = BiLstm()
    net.fit(learned_views(named, 1.0, r) + learned_views(list(layout_pages(words)), 0.5, r))
    return net


def fit_labeller(pages: DataFrame, sample: int = SAMPLE_PAGES) -> BiLstm:
    """fit_on_pages of at most `sample` pages, by hash of their id; one task fits, the driver gets the weights."""
    # First the sample's largest hash, then the pages up to it: tasks send hashes, not whole pages by the hundred.
    hashed = pages.filter("html is not null").select(F.col("html").cast("string").alias("html"), F.xxhash64("page_id", F.length("html")).alias("h"))
    least = hashed.select("h").orderBy("h").limit(sample).collect()
    if not least:
        return fit_on_pages([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in batch.column(0).to_pylist()]
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_on_pages(texts).p)], pa.binary())], ["weights"])

    net = BiLstm()
    net.p = pickle.loads(hashed.filter(F.col("h") <= least[-1]["h"]).orderBy("h", "html").limit(sample).select("html").coalesce(1).mapInArrow(run, "weights binary").first()["weights"])
    return net


# ---- the job -------------------------------------------------------------------------------

PAGES_SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, least_margin double"


def extract_main_text(pages: DataFrame, net: BiLstm) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks and least_margin, for each row of pages.

    pages: page_id, url, html; more columns are ignored. A null or empty page has empty text.
    Repeated rows, and rows without an id, are labelled each; an empty table gives no rows.
    least_margin is how far the least certain block is from 1/2. Map-only; whole pages, in batches
    of a few hundred.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [page_blocks(x.as_py()) for x in part.column(2)]
                chance = net.label_blocks(found)
                texts = ["\n\n".join(b.text for b, p in zip(blocks, c, strict=True) if p > 0.5) for blocks, c in zip(found, chance, strict=True)]
                margins = [float(np.abs(c - 0.5).min()) if len(c) else None for c in chance]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64()), pa.array(margins, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PAGES_SCHEMA.split(", ")])

    return bounded_batches(pages).selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, PAGES_SCHEMA)
