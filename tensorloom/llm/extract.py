"""Main text of HTML pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block-level tags, with
the tags that enclose them.  Scripts, styles and markup have no text; inline
tags do not end a block.  Each block has binary features of its ancestors
(tag names, words of ``class``, ``id`` and ``role``) and of its text (length,
density of links and punctuation, place in the page).  A chain of two labels,
main text or not, is scored by feature weights and transitions, trained by
gradient descent on the conditional likelihood (forward-backward) and decoded
by Viterbi.

The training pages are made by a seeded generator (``training_pages``): made-up
sentences in many page layouts whose blocks it labels as it writes them, so
nothing is learned from the pages that are judged.  Their number is a
parameter.

In a tag a quote opens a value only after an equals sign; elsewhere it is a sign
like others.  Character references are decoded; white space inside a block becomes one
space; blocks are joined in page order by one space.  A null or empty page has
an empty text.  Broken markup is read as far as it goes: an unknown closing
tag is passed over, an unclosed one ends with its parent.  Repeated rows get
equal results; other columns pass through, but for one named as the output,
which is replaced.  A very long page costs memory in proportion to itself only.
An empty table has an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

# fixed values: tags of HTML by their role
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe svg object textarea select".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-label|itemprop|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
BUCKETS = 1 << 14


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    path: tuple[str, ...]  # signs of the enclosing tags, outermost first


@lru_cache(maxsize=4096)  # few kinds of tags make most of them
def _signs(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag and the words of the attributes that name its purpose."""
    out = [tag]
    for name, a, b, c in _ATTR.findall(attributes):
        value = a or b or c
        if name.lower() == "style":
            out += ["=hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        elif name.lower() == "hidden":
            out.append("=hidden")
        else:
            out += ["=" + w.lower() for w in _WORD.findall(value)]
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = at = 0

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, min(linked, len(text)), tuple(s for _, signs in stack for s in signs)))
        parts.clear()
        linked = 0

    def text_until(stop: int) -> None:
        nonlocal linked
        if stop > at:
            parts.append(page[at:stop])
            linked += (stop - at) * (links > 0)

    find = _TOKEN.search
    while m := find(page, at):
        text_until(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                end()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            links -= tag == "a" and links > 0
            continue
        if tag in SILENT:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in BLOCKS:
                end()
            at = close.end() if close else len(page)
            continue
        if tag in BLOCKS:
            end()
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
        if tag not in VOID:
            signs = _signs if len(m[3]) <= 2000 else _signs.__wrapped__  # long ones are read whole, but not kept
            stack.append((tag, signs(tag, m[3])))
            links += tag == "a"
    text_until(len(page))
    end()
    return blocks


_LENGTHS = (3, 8, 20, 60, 150, 400)


def _features(blocks: list[Block]) -> list[np.ndarray]:
    """Bucket numbers of the features of each block."""
    out, known = [], {}
    n = len(blocks)
    for i, b in enumerate(blocks):
        if b.path not in known:
            known[b.path] = [crc32(s.encode()) % BUCKETS for s in {"up " + s for s in b.path} | {"begins " + s[:5] for s in b.path if s[0] == "="} | {f"last {s}" for s in b.path[-3:]}]
        t = b.text
        size = sum(len(t) > k for k in _LENGTHS)
        marks = [f"size {size}", f"links {4 * b.linked // len(t)}", f"ends {t[-1] in '.!?…:;'}", f"stops {min(3, t.count('. ') + t.count(', '))}", f"place {4 * i // n}"]
        if t[0] in "©" or "copyright" in t[:40].lower():
            marks.append("copyright")
        out.append(np.array(known[b.path] + [crc32(m.encode()) % BUCKETS for m in marks]))
    return out


class Chain:
    """Weights of features by label, of transitions and of the ends."""

    def __init__(self):
        self.w = np.zeros((BUCKETS, 2))
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[f].sum(axis=0) for f in features])

    def decode(self, features: list[np.ndarray]) -> list[int]:
        """The best labels, by Viterbi."""
        if not features:
            return []
        e = self.scores(features)
        (a, b), back = (e[0] + self.first).tolist(), []
        (s00, s01), (s10, s11) = self.step.tolist()
        for x, y in e[1:].tolist():
            back.append((b + s10 > a + s00, b + s11 > a + s01))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]

    def update(self, features: list[np.ndarray], labels: list[int], rate: float, decay: float) -> None:
        """One ascent of the log-likelihood of a page's labels."""
        e = self.scores(features)
        n = len(e)
        fore, back = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = e[0] + self.first
        for i in range(1, n):
            fore[i] = e[i] + np.logaddexp.reduce(fore[i - 1][:, None] + self.step, axis=0)
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp.reduce(self.step + e[i + 1] + back[i + 1], axis=1)
        whole = np.logaddexp.reduce(fore[-1])
        miss = -np.exp(fore + back - whole)
        miss[np.arange(n), labels] += 1
        pairs = np.zeros((2, 2))
        for i in range(1, n):
            pairs[labels[i - 1], labels[i]] += 1
            pairs -= np.exp(fore[i - 1][:, None] + self.step + e[i] + back[i] - whole)
        for f, g in zip(features, miss, strict=True):
            self.w[f] += rate * g
        self.w *= 1 - rate * decay
        self.step += rate * pairs / n
        self.first += rate * miss[0]


# fixed values: names by which pages mark what is not their text
_ASIDES = {
    "menu": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "tabs", "toolbar", "navigation", "pagination", "pager"],
    "header": ["header", "masthead", "banner", "topbar", "branding", "site-header"],
    "footer": ["footer", "foot", "colophon", "site-footer", "legal", "copyright"],
    "sidebar": ["sidebar", "aside", "widget", "related", "related-posts", "recommended", "trending", "popular", "rail", "tags", "toc"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "alert", "disclaimer", "modal", "popup", "overlay", "subscribe", "newsletter", "paywall"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsense"],
    "comment": ["comment", "comments", "comment-list", "commentlist", "user-comments", "discussion", "replies", "reply", "disqus", "responses"],
    "share": ["share", "social", "share-buttons", "follow"],
    "form": ["login", "search", "signup", "contact-form"],
}
_MAIN = ["article", "content", "main", "post", "entry", "entry-content", "post-body", "article-body", "story", "main-content", "text"]


def training_pages(count: int = 900, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages with a label for each leaf block: 1 for main text."""
    rng = random.Random(seed)
    vowels, rest = "aeiouäéo", "bcdfghlmnprstvzñß"

    def word() -> str:
        return "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 3, high: int = 18) -> str:
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize() + rng.choice(["."] * 8 + ["!", "?", ""])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    out = []
    for _ in range(count):
        pieces: list[tuple[str, int | None]] = []  # markup has no label
        add = lambda text, label=None: pieces.append((text, label))

        def wrap(kind: str, inside) -> None:
            name = rng.choice(_ASIDES[kind])
            own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
            tag = own if own and rng.random() < 0.5 else rng.choice(["div", "div", "section", "aside", "ul" if kind == "menu" else "div"])
            mark = "" if tag == own and rng.random() < 0.6 else f' {rng.choice(["class", "class", "id", "role"])}="{name}{rng.choice(["", "", " x1", " block"])}"'
            add(f"<{tag}{mark}>")
            inside()
            add(f"</{tag}>")

        def links() -> None:
            for _ in range(rng.randint(2, 9)):
                add(rng.choice(["<li>", "<li>", "<div>"]) + f'<a href="/{word()}">')
                add(" ".join(word() for _ in range(rng.randint(1, 4))).capitalize(), 0)
                add("</a></li>")

        def blurb() -> None:
            for _ in range(rng.randint(1, 3)):
                tag = rng.choice(["p", "div", "h3", "span", ""])
                add(f"<{tag}>" if tag else "")
                add(sentence(2, 12) if rng.random() < 0.7 else paragraph(), 0)
                add(f"</{tag}>" if tag else "<br>")

        def remarks() -> None:
            if rng.random() < 0.5:
                add("<h3>")
                add(sentence(1, 3), 0)
                add("</h3>")
            marked = rng.random() < 0.5
            for _ in range(rng.randint(1, 5)):
                add(f'<{rng.choice(["div", "li", "article"])} class="{rng.choice(["comment", "reply", "comment-body", "response"])}"><p>' if marked else rng.choice(["<div><p>", "<li><p>", "<div>", "<p>"]))
                add(paragraph(), 0)
                add("</p></div>")

        def notes() -> None:
            add("<p>" if rng.random() < 0.5 else "")
            add(rng.choice(["© ", "Copyright ", "&copy; "]) + sentence(2, 8), 0)
            add("<br>")

        def main() -> None:
            tag = rng.choice(["article", "article", "main", "div", "div", "section"])
            mark = f' {rng.choice(["class", "id"])}="{rng.choice(_MAIN)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
            add(f"<{tag}{mark}>")
            if rng.random() < 0.8:
                add("<h1>")
                add(sentence(3, 12), 1)
                add("</h1>")
            for _ in range(rng.randint(1, 14)):
                kind = rng.random()
                if kind < 0.72:
                    add("<p>" + rng.choice(["", "", "", "<b>", "<em>"]))
                    add(paragraph(), 1)
                    add(rng.choice(["</p>", "</p>", "</p>", "<br>", ""]))
                elif kind < 0.8:
                    add(f"<h{rng.randint(2, 4)}>")
                    add(sentence(2, 8), 1)
                    add("</h2>")
                elif kind < 0.87:
                    add("<ul>")
                    for _ in range(rng.randint(2, 5)):
                        add("<li>")
                        add(sentence(2, 12), 1)
                    add("</ul>")
                elif kind < 0.92:
                    add(rng.choice(["<blockquote>", "<pre>", "<table><tr><td>", "<figure><figcaption>"]))
                    add(paragraph(), 1)
                    add("</blockquote></pre></table></figure>")
                else:
                    wrap(rng.choice(["advert", "share", "sidebar", "notice"]), rng.choice([blurb, links]))
            if rng.random() < 0.3:
                wrap("comment", remarks)
            if rng.random() < 0.15:
                wrap(rng.choice(["sidebar", "share", "form"]), rng.choice([links, blurb]))
            add(f"</{tag}>")

        add("<html><head><title>")
        add(sentence(), 0)
        add("</title></head><body>")
        for kind, inside, share in (("header", blurb, 0.4), ("notice", blurb, 0.3), ("menu", links, 0.8), ("form", blurb, 0.15), ("advert", blurb, 0.5), ("sidebar", links, 0.25)):
            if rng.random() < share:
                wrap(kind, inside)
        main()
        for kind, inside, share in (("comment", remarks, 0.4), ("share", links, 0.25), ("sidebar", rng.choice([links, blurb]), 0.4), ("advert", blurb, 0.3), ("notice", blurb, 0.2), ("footer", rng.choice([notes, notes, links]), 0.9)):
            if rng.random() < share:
                wrap(kind, inside)
        add("</body></html>")
        labels = {}
        page = []
        for k, (text, label) in enumerate(pieces):
            if label is None:
                page.append(text)
            else:  # a private mark tells which block the text came to
                labels[f"\ue000{k}\ue001"] = label
                page.append(f"\ue000{k}\ue001{text}")
        blocks = leaf_blocks("".join(page))
        own = [max((labels[m] for m in re.findall("\ue000\\d+\ue001", b.text)), default=0) for b in blocks]
        out.append((re.sub("\ue000\\d+\ue001", "", "".join(page)), own))
    return [(page, own) for page, own in out if len(leaf_blocks(page)) == len(own)]


def train(pages: list[tuple[str, list[int]]] | None = None, epochs: int = 6, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    chain = Chain()
    held = [(_features(leaf_blocks(page)), labels) for page, labels in (training_pages() if pages is None else pages)]
    held = [(f, labels) for f, labels in held if f]
    for k in range(epochs):
        for f, labels in held:
            chain.update(f, labels, rate / (1 + k), decay)
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join([b.text for b, label in zip(blocks, chain.decode(_features(blocks)), strict=True) if label])


def extract(pages: DataFrame, chain: Chain, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``page`` in ``out``."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # of fixed size

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in batches:
            yield pa.array([main_text(p.as_py(), shared.value) for p in held], pa.string())

    return pages.withColumn(out, text_of(F.col(f"`{page}`")))
