"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A page becomes a tree of block elements.  Trees score each element by its tag,
attribute tokens, depth, subtree density and its standing among its siblings.
Decoding picks the most likely labelling in which whatever lies in a dropped
element is dropped too, and a kept element lies in kept ones only.  The trees
are trained on pages that this module composes itself, with known main parts.

Scripts, styles, form parts (buttons, selects, text areas) and what browsers show
only in place of something else (inside noscript, template, iframe, object,
canvas, audio, video) or draw (svg, math) is no text.  Such an element that closes
itself or has no end tag loses its tag alone; script, style, textarea and title
without an end tag hold the rest of the page, as in browsers.

Blocks of kept elements are joined in page order by one \\n; white space inside
a block is one space.  Null html counts as empty and gives an empty text; so do
pages without main text.  Repeated rows are treated alike; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.boosting import Boosted, boost
from skein.llm.common import bounded_batches
from skein.llm.textops import by_size

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math select button object canvas audio video".split())
WHOLE = frozenset("script style textarea title".split())  # without an end tag they hold the rest of the page
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# what a start tag closes while it is the nearest open one of these
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table article main section div body aside nav header footer form blockquote td th".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")  # one attribute; its name counts whole
_TOKEN = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")

TOKENS = {
    "main": "article content main post entry story body text prose single page blog".split(),
    "menu": "nav navigation menu breadcrumb breadcrumbs toolbar pagination pager tabs skip toc links tags".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner affiliate teaser".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay message privacy newsletter subscribe subscription signup paywall login search".split(),
    "comment": "comment comments reply replies respond discussion disqus reader feedback review reviews thread".split(),
    "side": "sidebar side aside related recommended widget share social rail more popular trending author bio meta byline".split(),
    "edge": "header footer head foot masthead copyright colophon site legal bottom top".split(),
}
_KIND = {w: k for k, (_, ws) in enumerate(TOKENS.items()) for w in ws}
_TAGS = {t: k for k, ts in enumerate(("article main", "nav menu", "header hgroup", "footer address", "aside", "form fieldset", "ul ol dl", "li dt dd", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "div section", "table tr td th tbody thead", "figure figcaption details dialog")) for t in ts.split()}
N_TAGS = 13
PROSE = 200  # characters of prose that make a page one with main text
NEVER = frozenset("nav header footer aside form fieldset address menu dialog".split())
FORCED = 30.0  # log odds of an element that has to be kept


class Page:
    """The block elements of a page and its text blocks."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.depth, self.kinds, self.hidden = ["html"], [-1], [0], [[0] * len(TOKENS)], [0]
        self.chars, self.linked, self.stops, self.tags = [0], [0], [0], [1]
        self.blocks: list[tuple[int, str]] = []
        self._parse(html)

    def _open(self, tag: str, attrs: str, up: int) -> int:
        kinds, hidden = [0] * len(TOKENS), 0
        for m in _ATTR.finditer(attrs):
            name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if tag == "body":  # what is said of the whole page tells no part from another
                continue
            if name in ("hidden", "aria-hidden") and value != "false" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = 1
            elif name in ("class", "id", "role", "aria-label"):
                for w in _TOKEN.findall(value):
                    if w in _KIND:
                        kinds[_KIND[w]] += 1
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.kinds.append(kinds)
        self.hidden.append(hidden)
        for column in (self.chars, self.linked, self.stops):
            column.append(0)
        self.tags.append(1)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        """One pass; every step costs the same whatever is open, so deep and unclosed markup stays linear."""
        stack: list[tuple[str, int] | None] = [("html", 0)]  # inline elements have node -1; None: closed out of turn
        open_at: dict[str, list[int]] = {}  # places in the stack by tag, the html element left out
        solid = [0]  # places of the block elements
        own: list[str] = []
        links = 0

        def flush() -> None:
            if own:
                text = _SPACES.sub(" ", unescape("".join(own))).strip()
                own.clear()
                if text:
                    self.blocks.append((stack[solid[-1]][1], text))

        def add(text: str) -> None:
            if text and not text.isspace():
                n = stack[solid[-1]][1]
                size = len(text)
                self.chars[n] += size
                self.stops[n] += text.count(".") + text.count(",")
                if links:
                    self.linked[n] += size
            own.append(text)

        def push(tag: str, node: int) -> None:
            open_at.setdefault(tag, []).append(len(stack))
            if node >= 0:
                solid.append(len(stack))
            stack.append((tag, node))

        def pop(k: int) -> None:
            nonlocal links
            if solid[-1] >= k:
                flush()
            while len(stack) > k:
                entry = stack.pop()
                if entry is not None:
                    open_at[entry[0]].pop()
                    links -= entry[0] == "a"
            while solid[-1] >= k:
                solid.pop()

        at, last = 0, html.rfind(">") + 1  # behind the last '>' no tag can end
        endless: set[str] = set()
        in_head = False
        while (m := _TAG.search(html, at, last)) is not None:
            if m.start() > at and not in_head:
                add(html[at : m.start()])
            at = m.end()
            name = (m.group(2) or m.group(5) or "").lower()
            if not name:
                continue
            closing = (m.group(1) or m.group(4)) == "/"
            if closing:
                if name == "head":
                    in_head = False
                    continue
                k = open_at[name][-1] if open_at.get(name) else 0
                if k and name in INLINE and solid[-1] > k:  # its block goes on
                    open_at[name].pop()
                    links -= name == "a"
                    stack[k] = None
                elif k:
                    pop(k)
                continue
            if name in RAW:
                own.append(" ")
                if name not in WHOLE and (name in endless or html.endswith("/>", 0, at)):
                    continue
                end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif name in WHOLE:
                    at = len(html)
                else:
                    endless.add(name)  # no end tag ahead: the tag alone is dropped
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                self.tags[stack[solid[-1]][1]] += 1
                own.append(" ")
                continue
            if name == "html":
                continue
            if name == "head":
                in_head = True
                continue
            if name in INLINE:
                self.tags[stack[solid[-1]][1]] += 1
                links += name == "a"
                push(name, -1)
                continue
            in_head = False
            flush()
            closes = ("p", *CLOSES.get(name, ()))
            k = max((open_at[t][-1] for t in (*closes, *BARRIER) if open_at.get(t)), default=0)
            if k and stack[k][0] in closes:
                pop(k)
            push(name, self._open(name, m.group(3) if m.group(2) else m.group(6) or "", stack[solid[-1]][1]))
        if not in_head:
            add(html[at:])
        flush()

    def features(self) -> np.ndarray:
        """One row of features for each element."""
        n = len(self.tag)
        parent = np.array(self.parent)
        chars, linked, stops, tags = (np.array(c, np.float64) for c in (self.chars, self.linked, self.stops, self.tags))
        own = chars.copy()
        paragraphs = np.array([t == "p" for t in self.tag], np.float64)
        for k in range(n - 1, 0, -1):
            up = parent[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            stops[up] += stops[k]
            tags[up] += tags[k]
            paragraphs[up] += paragraphs[k]
        children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        order, seen = np.zeros(n), {}
        before = np.zeros(n)  # share of the page's text in front of the element
        run = 0.0
        for k in range(n):
            order[k] = seen.get(parent[k], 0)
            seen[parent[k]] = order[k] + 1
            before[k] = run
            run += own[k]
        kinds = np.array(self.kinds, np.float64)
        above = np.zeros((n, kinds.shape[1] + N_TAGS))
        one_hot = np.zeros((n, N_TAGS))
        for k, t in enumerate(self.tag):
            if t in _TAGS:
                one_hot[k, _TAGS[t]] = 1
        both = np.concatenate([kinds, one_hot], 1)
        for k in range(1, n):
            above[k] = np.maximum(above[parent[k]], both[parent[k]])
        up = np.maximum(parent, 0)
        total = max(1.0, chars[0])
        spoken = np.array([t in ("article", "main") for t in self.tag])  # does the page say where its main part is?
        plain = chars - linked
        most = np.zeros(n)  # the most text outside links that a sibling holds
        second = np.zeros(n)
        for k in range(1, n):
            v = plain[k]
            if v > most[parent[k]]:
                most[parent[k]], second[parent[k]] = v, most[parent[k]]
            elif v > second[parent[k]]:
                second[parent[k]] = v
        rival = np.where(plain == most[up], second[up], most[up])
        alike = {}  # text outside links in elements of one tag under one parent
        for k in range(1, n):
            alike[parent[k], self.tag[k]] = alike.get((parent[k], self.tag[k]), 0.0) + plain[k]
        kin = np.array([alike.get((parent[k], self.tag[k]), 0.0) for k in range(n)])
        return np.column_stack([
            one_hot, np.minimum(kinds, 2), np.minimum(above[:, : kinds.shape[1]], 1), above[:, kinds.shape[1] : kinds.shape[1] + 6],
            np.array(self.depth), np.array(self.hidden), np.log1p(own), np.log1p(chars), linked / np.maximum(1, chars), stops / np.maximum(1, chars),
            np.log1p(chars / tags), np.log1p(paragraphs), children, order, children[up], before / total,
            chars / total, chars / np.maximum(1, chars[up]), plain / np.maximum(1, plain + rival), np.full(n, float(spoken.any())), np.full(n, np.log1p(total)), np.log1p(tags), children[up] - 1 - order, np.log1p(kin), kin / total,
        ])

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The most likely labelling in which a kept element's parent is kept.

        Where that keeps no text and the page has ``PROSE`` characters of prose,
        in blocks that aren't mostly links and stand in no element that is never
        main by its tag, the most likely labelling that keeps such a block.
        """
        label = self._decode(odds)
        if any(label[node] for node, _ in self.blocks):
            return label
        prose = self._prose()
        if sum(n for _, n in prose) < PROSE:
            return label
        cost = np.minimum(odds, 0)
        for k in range(1, len(cost)):
            cost[k] += cost[self.parent[k]]
        best = max((cost[node], n, -node) for node, n in prose)
        node = -best[2]
        forced = odds.copy()
        while node >= 0:
            forced[node] = max(forced[node], FORCED)
            node = self.parent[node]
        return self._decode(forced)

    def _prose(self) -> list[tuple[int, int]]:
        """(element, characters) of each that holds text of its own outside links, never-main tags and hidden parts."""
        out = [False] * len(self.tag)
        for k, tag in enumerate(self.tag):
            out[k] = tag in NEVER or bool(self.hidden[k]) or (k > 0 and out[self.parent[k]])
        size: dict[int, int] = {}
        for node, text in self.blocks:
            if not out[node] and self.linked[node] < 0.3 * self.chars[node]:
                size[node] = size.get(node, 0) + len(text)
        return list(size.items())

    def _decode(self, odds: np.ndarray) -> np.ndarray:
        n = len(odds)
        keep_gain = -np.logaddexp(0, -odds)
        drop_gain = -np.logaddexp(0, odds)
        kept, dropped = keep_gain.copy(), drop_gain.copy()
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            dropped[up] += dropped[k]
            kept[up] += max(kept[k], dropped[k])
        label = np.zeros(n, bool)
        for k in range(n):
            label[k] = (k == 0 or label[self.parent[k]]) and kept[k] > dropped[k]
        return label


def main_text(page: Page, odds: np.ndarray) -> str:
    """Kept blocks in page order."""
    label = page.decode(odds)
    return "\n".join(text for node, text in page.blocks if label[node])


# ---- training pages -------------------------------------------------------

_SYLLABLES = "ka lo mi ter an so ve ri du pel sha on ith gra ne bu col tas er il wen for mo das".split()


def _words(rng: np.random.Generator, n: int) -> str:
    sizes = rng.integers(1, 5, n).tolist()
    parts = iter([_SYLLABLES[k] for k in rng.integers(0, len(_SYLLABLES), sum(sizes)).tolist()])
    marks = ["." if x < 0.04 else "," if x < 0.08 else "" for x in rng.random(n).tolist()]
    return (" ".join("".join(islice(parts, k)) + mark for k, mark in zip(sizes, marks))).capitalize() + "."


#: Names of main parts in which words of other parts occur.
_ODD_NAMES = tuple("related-work|single-column comments-open|has-sidebar wide|story share-enabled|review-article|top-story|legal-text|more-info|message-body|thread-safe|popular-science|footer-less|forum-post reply-enabled|navigation-systems|bio-chemistry|advert-free|header-large|cookie-recipes".split("|"))


def compose_page(rng: np.random.Generator) -> str:
    """A page whose main text lies between the marks \\x01 and \\x02."""
    pick = lambda *a: a[rng.integers(len(a))]
    few = lambda lo, hi: int(rng.integers(lo, hi + 1))
    attr = lambda *names: pick("", *(f' class="{x}"' for x in names), *(f' id="{x}"' for x in names))
    marked = lambda *names: pick(*(f' class="{x}"' for x in names), *(f' id="{x}"' for x in names))

    def para(lo: int, hi: int) -> str:
        text = _words(rng, few(lo, hi))
        if rng.random() < 0.15:
            text += f' <a href="/{few(1, 99)}">{_words(rng, few(1, 4))}</a> ' + _words(rng, few(3, 12))
        return text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{_words(rng, few(1, 3))}</a></li>' for _ in range(n))

    def menu() -> str:
        inner = f"<ul>{links(few(3, 9))}</ul>" if rng.random() < 0.7 else " | ".join(f'<a href="/x">{_words(rng, 1)}</a>' for _ in range(few(3, 8)))
        return pick(f"<nav{attr('menu', 'site-nav')}>{inner}</nav>", f"<div{marked('nav', 'menu', 'navigation', 'breadcrumb')}>{inner}</div>", f"<ul{marked('menu', 'nav-links')}>{links(few(3, 8))}</ul>")

    def advert() -> str:
        body = pick(_words(rng, few(2, 25)), f"<p>{_words(rng, few(4, 30))}</p>", f'<a href="/buy">{_words(rng, few(2, 8))}</a>')
        return pick(f"<div{marked('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad banner', 'ad-slot')}>{body}</div>", f"<aside{marked('ad', 'advertisement', 'promo')}>{body}</aside>")

    def notice() -> str:
        body = pick(f"<p>{_words(rng, few(5, 35))}</p><button>ok</button>", _words(rng, few(5, 30)))
        return pick(f"<div{marked('cookie-notice', 'notice', 'consent', 'alert', 'newsletter', 'cookie-banner', 'popup', 'gdpr')}>{body}</div>", f"<section{marked('subscribe', 'notice', 'cookies')}>{body}</section>")

    def form() -> str:
        return f"<form{attr('search', 'login', 'subscribe')}><label>{_words(rng, few(1, 4))}</label><input name=q><p>{_words(rng, few(2, 18))}</p><button>go</button></form>"

    def header() -> str:
        return pick(f"<header{attr('site-header', 'masthead')}><h1>{_words(rng, few(1, 4))}</h1>{pick('', menu(), f'<p>{_words(rng, few(3, 12))}</p>')}</header>", f"<div{marked('header', 'site-header', 'masthead')}><p>{_words(rng, few(1, 8))}</p></div>")

    def side() -> str:
        inner = "".join(pick(f"<h3>{_words(rng, 2)}</h3><ul>{links(few(2, 6))}</ul>", f"<p>{_words(rng, few(4, 40))}</p>", f"<div class=widget>{_words(rng, few(3, 20))}</div>") for _ in range(few(1, 3)))
        return pick(f"<aside{attr('sidebar', 'related')}>{inner}</aside>", f"<div{marked('sidebar', 'related', 'share', 'side-rail', 'recommended')}>{inner}</div>")

    def comments() -> str:
        one = lambda: pick(f'<li class="comment"><b>{_words(rng, 1)}</b><p>{_words(rng, few(3, 60))}</p></li>', f'<div class="comment"><p>{_words(rng, few(3, 60))}</p></div>', f"<p>{_words(rng, few(3, 50))}</p>")
        inner = "".join(one() for _ in range(few(1, 6)))
        return pick(f"<section{marked('comments', 'reader-comments', 'discussion')}><h2>{_words(rng, 1)}</h2>{inner}</section>", f"<div{marked('comments', 'comment-list', 'responses comments')}>{inner}</div>", f'<ol class="comment-list comments">{inner}</ol>')

    def footer() -> str:
        inner = pick("&copy; " + _words(rng, few(2, 40)), "&copy; " + _words(rng, few(2, 20)), f"<p>&copy; {_words(rng, few(2, 25))}</p>", f"<ul>{links(few(2, 6))}</ul><p>{_words(rng, few(3, 15))}</p>")
        if rng.random() < 0.1:
            inner = "".join(f"<p>{_words(rng, few(5, 60))}</p>" for _ in range(few(1, 5)))
        return pick(f"<footer>{inner}</footer>", f"<footer{attr('site-footer')}>{inner}</footer>", f"<div{marked('footer', 'copyright', 'site-footer')}>{inner}</div>")

    blocks = [f"<h{few(1, 2)}>\x01{_words(rng, few(2, 9))}\x02</h1>"] if rng.random() < 0.8 else []
    for _ in range(few(1, 8) if rng.random() < 0.8 else 1):
        text = f"\x01{para(*pick((1, 12), (4, 110), (10, 110)))}\x02"
        blocks.append(pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}</p>", f"<div>{text}</div>", f"<blockquote><p>{text}</p></blockquote>"))
        if rng.random() < 0.12:
            blocks.append(f"<ul>{''.join(f'<li>{chr(1)}{para(2, 16)}{chr(2)}</li>' for _ in range(few(2, 5)))}</ul>")
        if rng.random() < 0.08:
            blocks.append(f"<h{few(2, 4)}>\x01{_words(rng, few(1, 6))}\x02</h3>")
        if rng.random() < 0.08:
            blocks.append(f"<table><tr><td>\x01{_words(rng, 2)}\x02</td><td>\x01{_words(rng, 2)}\x02</td></tr></table>")
        if rng.random() < 0.1:
            blocks.append(pick(advert, notice, form, side)())
    inside = "".join(blocks) + (pick(comments, side, form)() if rng.random() < 0.12 else "")
    lead = [f() for f in (header, menu, advert, notice, form) if rng.random() < 0.55]
    tail = [f() for f in (comments, side, advert, notice, form, footer) if rng.random() < 0.5]
    rng.shuffle(lead)
    plain = rng.random() < 0.5  # pages that name nothing, as many simple ones are
    if plain:
        lead = [f() for f in (header, menu) if rng.random() < 0.4]
        tail = [f() for f in (comments, footer, side) if rng.random() < 0.3]
        lead += [f"<div>{' '.join(f'<a href={chr(34)}/x{chr(34)}>{_words(rng, 1)}</a>' for _ in range(few(2, 6)))}</div>"] if rng.random() < 0.3 else []
        tag, names = pick(("div", ("",)), ("section", ("",)), ("", ("",)), ("", ("",)), ("td", ("",)), ("article", ("",)), ("div", _ODD_NAMES))
        if rng.random() < 0.1:
            inside = f"<p>\x01{para(20, 200)}\x02</p>"
    else:
        tag, names = pick(("article", ("", "post", "entry")), ("article", ("",)), ("article", _ODD_NAMES), ("main", ("", "content")), ("main", _ODD_NAMES), ("div", ("content", "post", "article-body", "entry-content", "main", "story")))
    if rng.random() < 0.06:  # nothing but other parts
        tag, names, inside = "", ("",), ""
    elif plain and rng.random() < 0.4:  # paragraphs alone, as many and as long as may be
        inside = "".join(f"<p>\x01{para(*pick((3, 20), (10, 40), (20, 110)))}\x02</p>" for _ in range(few(1, 12)))
        inside = inside.replace("<p>", "").replace("</p>", "") if rng.random() < 0.15 else pick("", f"<h{few(1, 2)}>\x01{_words(rng, few(2, 9))}\x02</h1>") + inside
    name = pick(*names)
    body = f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{inside}</{tag}>" if tag else inside
    if tag == "td":
        body = f"<table><tr>{body}</tr></table>"
    for _ in range(few(0, 3) if tag else 0):
        body = pick(f"<div>{body}</div>", f'<div class="wrapper">{body}</div>', f"<section>{body}</section>", f"<div>{body}</div>" if plain else f"<main>{body}</main>")
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 4)}</title><style>p{{}}</style></head><body>{''.join(lead)}{body}{''.join(tail)}" + pick("</body></html>", "")


@cache
def trained(pages: int = 1600, seed: int = 3) -> Boosted:
    """Trees trained on composed pages; an element is main when it holds main text."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        html = compose_page(rng)
        page = Page(html)
        label = np.zeros(len(page.tag), bool)
        for node, text in page.blocks:
            if "\x01" in text:
                while node >= 0 and not label[node]:
                    label[node] = True
                    node = page.parent[node]
        seen = np.zeros(len(page.tag), bool)
        for node, _ in page.blocks:
            while node >= 0 and not seen[node]:
                seen[node] = True
                node = page.parent[node]
        xs.append(page.features()[seen])
        ys.append(label[seen])
    return boost(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def _extract(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "html", 1 << 20):
            pages = [Page(h) for h in (x or "" for x in b.column(2).to_pylist())]
            rows = [p.features() for p in pages]
            odds = model.log_odds(np.concatenate(rows))
            ends = np.cumsum([len(r) for r in rows])
            texts = [main_text(p, odds[z - len(r) : z]) for p, r, z in zip(pages, rows, ends)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model or trained()), "page_id long, url string, text string, n_chars long")
