"""Main text of a page: the maximum-scoring contiguous region.

A page is a sequence of words and tags. Each word and each tag scores by its class: which tag it is,
whether a word is linked, and whether it stands within an article, within a main element, beside
one of these, or on a page without any. The scores are log ratios of how often the class occurs inside
and outside the main text of labelled pages, so words within an article score high and tags there cost
next to nothing, while words beside one score below zero. One linear scan finds the contiguous stretch of greatest
sum, and its blocks are the text. What stands within elements whose tag, role or names weigh against
main text, by the same labelled pages, is left out of it; where that would leave every article out, an article
counts by its own names alone.

A page is handled within one task by a tokeniser that reads it once; its time is linear in
the page, however deep the markup.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset(["article", "main"])
CLOSES_P = BLOCKS - frozenset(["body", "html", "head", "option"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes when it is the innermost open block (a p goes before any block).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_NAME_WORD = re.compile(r"[a-z]+")
_NEGATED = re.compile(r"\b(?:has|no|with|without)[-_]\w+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A quote begins a value only right after "="; a value without its end quote ends at ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_GAPS = re.compile(r"\s+")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    return out


def features(tag: str, raw: str, inside: bool) -> list[list[str]]:
    """What an element says of itself: its tag and role, and the words of each of its
    names; ``inside``: it stands within an article or main element."""
    at = "in:" if inside else ""
    out = [[f"{at}<{tag}>"]]
    if "=" not in raw and "hidden" not in raw:
        return out
    a = attributes(raw)
    style = a.get("style", "").replace(" ", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        out.append(["hidden"])
    if role := a.get("role", "").lower():
        out.append([f"role:{role}"])
    if tag not in ("body", "html", "main"):
        for name in f"{a.get('class', '')} {a.get('id', '')}".split():
            if words := _NAME_WORD.findall(_NEGATED.sub(" ", _CAMEL.sub(" ", name).lower())):
                out.append([at + w for w in words])
    return out


class Container:
    """An article or main element; what stands in an article within main stands in an article."""

    __slots__ = ("place",)

    def __init__(self, tag: str, around: "Container | None"):
        self.place = "@article" if tag == "article" or around is not None and around.place == "@article" else "@main"


class Block:
    __slots__ = ("parts", "out", "link", "words", "tag")

    def __init__(self, out: bool, tag: str):
        self.parts, self.out, self.link, self.words, self.tag = [], out, 0, 0, tag


class Open:
    """The open elements, innermost last: tag, left out, container within."""

    def __init__(self):
        self.stack: list[tuple[str, bool, Container | None]] = []
        self.places: dict[str, list[int]] = {}  # of a tag's open elements
        self.blocks: list[int] = []  # places of open blocks

    def out(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def within(self) -> Container | None:
        return self.stack[-1][2] if self.stack else None

    def place(self) -> str:
        return self.stack[-1][2].place if self.stack and self.stack[-1][2] else ""

    def block(self) -> str:
        return self.stack[self.blocks[-1]][0] if self.blocks else ""

    def push(self, tag: str, out: bool, within: Container | None) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, out, within))

    def pop_to(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.stack) > place:
            tag, _, _ = self.stack.pop()
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def end(self, tag: str) -> None:
        at = self.places.get(tag)
        # An inline end tag closes nothing beyond its block.
        if at and (tag in BLOCKS or not self.blocks or at[-1] > self.blocks[-1]):
            self.pop_to(at[-1])


def tokens(page: str, left_out: Callable[[str, str, bool], bool], own: bool = False) -> tuple[list[tuple[str, int, int]], list[Block]]:
    """(class, count, block) of each run of words and each tag, and the blocks. own: an article
    or main element is left out for its own names alone, not for those around it."""
    seq: list[tuple[str, int, int]] = []
    blocks: list[Block] = []
    open_, pending = Open(), True
    at, n = 0, len(page)

    def say(text: str) -> None:
        nonlocal pending
        count = len(text.split())
        if not count:
            if blocks and not pending and text:
                blocks[-1].parts.append(" ")
            return
        out, links = open_.out(), bool(open_.places.get("a"))
        if pending or blocks[-1].out != out:
            blocks.append(Block(out, open_.block()))
            pending = False
        blocks[-1].parts.append(text)
        blocks[-1].words += count
        blocks[-1].link += count * links
        seq.append((("word-out" if out else "word-link" if links else "word") + open_.place(), count, len(blocks) - 1))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(html.unescape(page[at:]))
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a bare < is text
            nxt = page.find("<", lt + 1)
            end = nxt if nxt >= 0 else n
            say(html.unescape(page[at:end]))
            at = end
            continue
        if lt > at:
            say(html.unescape(page[at:lt]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            pending |= tag in BLOCKS
            seq.append((("tag-out" if open_.out() else "/" + tag) + open_.place(), 1, len(blocks) - 1))
            open_.end(tag)
        elif m[2]:
            tag, raw = m[2].lower(), m[3] or ""
            if tag in CLOSES_P and open_.block() == "p":
                open_.pop_to(open_.blocks[-1])
            if open_.block() in CLOSES.get(tag, ()):
                open_.pop_to(open_.blocks[-1])
                if tag == "tr" and open_.block() == "tr":
                    open_.pop_to(open_.blocks[-1])
            if tag in BLOCKS:
                pending = True
            elif tag == "br" and blocks and not pending:
                blocks[-1].parts.append(" ")
            out, within = open_.out(), open_.within()
            seq.append((("tag-out" if out else tag) + open_.place(), 1, len(blocks) - 1))
            if tag in RAW and not raw.endswith("/"):
                end = _raw_end(tag).search(page, at)
                at = end.start() if end else n
                continue
            if tag not in VOID:
                out = out and tag != "main" and not (own and tag in CONTAINERS) or left_out(tag, raw, within is not None)
                open_.push(tag, out, Container(tag, within) if tag in CONTAINERS else within)
    if any(c in _HELD for c, _, _ in seq):
        seq = [(c if "@" in c else c + "@beside", n, b) for c, n, b in seq]
    return seq, blocks


_HELD = frozenset(w + p for w in ("word", "word-link") for p in ("@article", "@main"))


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}[\\s/>]", re.I)


OUT = 0.2

# --- weights -----------------------------------------------------------------------

_PROSE = "Long lines of plain words tell what happened and why it matters to those who read them today."
#: The labelled table's material (fixed values): names and roles of what is not main text, words that go
#: along with them, names of what is, and what an article's own parts are called within it.
NAMES = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc header masthead topbar footer bottombar sidebar side rail widget widgets aside related recommended recommendations share sharing social "
    "comment comments reply replies response responses discussion disqus outbrain taboola adsense respondform feedback search toolbar skip copyright legal disclaimer"
).split()
ALONG = "site page box block container wrapper wrap list inner outer section bar area button buttons link links item items row col column slot unit panel group module left right top bottom user reader form id js main global thread count root fb".split()
OWN = "header masthead banner toc legal copyright disclaimer search".split()
GOOD = "content article post entry story body text paragraph lead".split()
ROLES = "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split()
SKIPPED = "aside audio button canvas datalist dialog embed footer form head iframe input menu nav noembed noframes noscript object script search select style svg template textarea title video".split()


def labelled_pages() -> list[tuple[str, str]]:
    """The labelled table: pages and their main texts, made by rule."""
    menus = ["<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul></nav>", '<div class="menu"><a href="/">Start</a> <a href="/x">Shop</a></div>', "<header><h2>Daily site</h2><form><input name=q><button>Go</button></form></header>"]
    tails = ["<footer>All rights reserved. <a href=/t>Terms</a></footer>", '<div id="comments"><p>Nice piece!</p><p>I do not agree at all.</p></div><footer>Imprint</footer>', '<aside><h3>Related</h3><ul><li><a href=/1>One more</a></li><li><a href=/2>Another</a></li></ul></aside>']
    ads = ['<div class="ad">Buy two and pay for one.</div>', '<div class="cookie-notice">We use cookies. <button>Accept</button></div>', ""]
    wraps = [("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="content">', "</div>"), ("<td>", "</td>")]
    out = []
    for k in range(24):
        count = 1 + k % 5
        body = [f"<h1>A title of piece {k}</h1>"] + [f"<p>{_PROSE} Part {i}, <b>and</b> <a href=/r>a source</a>.</p>" for i in range(count)]
        if k % 3 == 0:
            body.insert(2, "<ul><li>first of the points made here</li><li>second of the points made here</li></ul>")
        if k % 2 == 0:  # things that stand within a main text and are none of it
            body.insert(1, ads[k % 3] + ads[(k + 1) % 3] + "<form><label>Your name</label><input></form>")
            body.append("<p>Fin.</p>")
        main = [re.sub(r"<[^>]*>", "", b.replace("</li>", "</li>\n")).strip() for b in body if b[:2] in ("<h", "<p", "<u")]
        a, b = wraps[k % 4]
        beside = '<div class="strip">Read our weekly edition too.</div>' if k % 4 < 2 else ""
        page = f"<html><head><title>t</title><script>var x=1;</script></head><body>{menus[k % 3]}{ads[k % 3]}{beside}{a}{''.join(body)}{b}{ads[(k + 1) % 3]}{tails[k // 3 % 3]}</body></html>"
        out.append((page, "\n".join(main)))
    return out


def labelled_elements() -> list[tuple[str, str, bool, bool]]:
    """Tag, attributes, whether within an article, and whether it belongs to the main text."""
    out = []
    for inside in (False, True):
        for tag in SKIPPED:
            out += [(tag, "", inside, False)] * 4
        for tag in sorted(BLOCKS - set(SKIPPED) - {"header"}):
            out += [(tag, "", inside, True)] * 4
        out += [("header", "", inside, inside)] * 4
        for n in NAMES:
            for along in ("", f"-{ALONG[len(n) % len(ALONG)]}"):
                out += [("div", f'class="{n}{along}"', inside, inside and n in OWN)] * 4
        for n in GOOD:
            out += [("div", f'class="{n}"', inside, True)] * 4
        for n in ALONG:
            out += [("div", f'class="{n}"', inside, True), ("div", f'class="{n}"', inside, False)]
        for r in ROLES:
            out += [("div", f'role="{r}"', inside, False)] * 4
        for hidden in ("hidden", 'aria-hidden="true"', 'style="display:none"'):
            out += [("div", hidden, inside, False)] * 4
    return out


@cache
def element_weights() -> dict[str, float]:
    """Log ratio of each feature among elements inside and outside the main texts. An
    element with attributes counts for them and not for its tag, and a name of several
    words for its first."""
    good, bad = Counter(), Counter()
    for tag, raw, inside, main in labelled_elements():
        for names in features(tag, raw, inside)[1 if raw else 0 :]:
            (good if main else bad)[names[0]] += 1
    return {f: log((good[f] + 0.5) / (bad[f] + 0.5)) for f in {*good, *bad}}


#: A feature of this weight, or less, leaves its element out.
AGAINST = -1.0
#: A word that no labelled page has speaks for an element as much, and within an article more.
UNKNOWN, UNKNOWN_WITHIN = 1.5, 2.0


def _told(words: list[str]) -> float:
    return sum(element_weights().get(x, UNKNOWN_WITHIN if x.startswith("in:") else UNKNOWN) for x in words)


def left_out(tag: str, raw: str, inside: bool) -> bool:
    """Whether an element's tag, role or one of its names weighs against main text."""
    return any(_told(f) <= AGAINST for f in features(tag, raw, inside))


@cache
def weights() -> dict[str, float]:
    """Log ratio of each class inside and outside of the main texts, scaled so that a plain word is
    worth 1. Words may speak for or against; a tag costs something everywhere, though next to nothing within
    an article. A word that is left out only separates, since it is never returned: it costs OUT at
    most, and within an article as little as a tag."""
    inside, outside = Counter(), Counter()
    for page, main in labelled_pages():
        lines = set(main.split("\n"))
        seq, blocks = tokens(page, left_out)
        good = {i for i, b in enumerate(blocks) if _text(b) in lines}
        edge = (min(good), max(good)) if good else (1, 0)
        for cls, n, b in seq:
            (inside if edge[0] <= b <= edge[1] and (cls[:4] != "word" or b in good) else outside)[cls] += n
    a, b = sum(inside.values()), sum(outside.values())
    ratio = {c: log((inside[c] + 0.5) / (a + 1)) - log((outside[c] + 0.5) / (b + 1)) for c in {*inside, *outside}}
    unit = max(ratio.get("word", 1.0), 0.5)
    out = {c: r / unit for c, r in ratio.items() if c in ("word", "word-link") or c.startswith(("word@", "word-link@"))}
    for c, r in ratio.items():
        if c not in out:
            least = LEAST.get(c.partition("@")[2], LEAST[""])
            out[c] = max(-OUT, r / unit) * (least / LEAST[""]) if c.startswith("word-out") else min(0.0, r / unit) * 0.5 * (least / LEAST[""]) - least
    return out


#: What a tag costs at least, by its place; and three times that if no labelled page has it there.
LEAST = {"": 0.1, "beside": 0.1, "main": 0.01, "article": 0.0003}


def score(cls: str) -> float:
    """A class that no labelled page has is a tag, or a word of a place that no page has."""
    if (known := weights().get(cls)) is not None:
        return known
    kind, _, place = cls.partition("@")
    if kind in ("word", "word-link"):
        return -1.0 if place == "beside" else 1.0
    return -3 * LEAST[place]


def _text(b: Block) -> str:
    return _GAPS.sub(" ", "".join(b.parts)).strip()


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous stretch of greatest positive sum; the
    earliest of equals; (0, -1) if no score is positive."""
    best, span, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i)
    return span


def main_text(page: str | None) -> str:
    seq, blocks = tokens(page or "", left_out)
    if not any(c in _HELD for c, _, _ in seq):
        # No word of an article is left in: then what is around an article has no say.
        other = tokens(page or "", left_out, own=True)
        if any(c in _HELD for c, _, _ in other[0]):
            seq, blocks = other
    held = any(c in _HELD for c, _, _ in seq)
    first, last = best_stretch([score(c) * n for c, n, _ in seq])
    hit = [b for c, _, b in seq[first : last + 1] if c.startswith(("word", "word-link")) and not blocks[b].out]
    if not hit:
        return ""
    lo, hi = min(hit), max(hit)
    while lo and blocks[lo - 1].tag in HEADINGS and not blocks[lo - 1].out and blocks[lo - 1].words:
        lo -= 1  # a heading, even a link, belongs to what follows it
    menu = lambda b: b.tag == "li" and b.words == b.link
    while not held and lo <= hi and (menu(blocks[lo]) or blocks[lo].out):
        lo += 1  # lists of links at the edges are menus
    while not held and lo <= hi and (menu(blocks[hi]) or blocks[hi].out):
        hi -= 1
    found = (_text(b) for b in blocks[lo : hi + 1] if not b.out)
    return "\n".join(t for t in found if t)


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars for every row.

    A null or empty page, or one without a word of main text, gives an empty text; pages
    of any length and depth are read whole; repeated rows give a row each; an empty table an empty result; other columns are
    not read."""
    small_batches(pages.sparkSession)
    rows = pages.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("_html"))
    kinds = dict(rows.dtypes)
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["_html"]]
            yield b[names].assign(_text=text, _n=np.array([len(t) for t in text], np.int64))

    out = rows.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", _text string, _n long")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
