"""The blocks of text of an HTML page and the elements that hold them.

``read`` goes through a page once and keeps what a later choice needs: the elements with their tag,
their generalised path and whether they are page furniture, and the blocks of text with the element
that holds each. Inline markup does not end a block; a line break counts as white space.

A path names the tags and classes from the top down, with numbers in classes made equal and without
html and body, so that pages of one template agree: ``div.layout>article.post-#``.

Defined cases: unclosed and crossing tags end with their parent; p, li, cells and options end where
the next one begins; scripts, styles and the like are skipped up to their end tag, or to the end of
the page; a tag that is never closed by ">" is text; an empty page has no blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

# Fixed values of the markup language: elements without content, with raw content, inline ones.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby"
    " s samp small span strike strong sub sup time tt u var wbr img br input".split()
)
HEAD = set("base link meta noscript script style template title".split())
# elements that hold one piece of text, or rows and items: never the container of an article
PIECES = set(
    "p h1 h2 h3 h4 h5 h6 li pre dt dd td th tr table tbody thead tfoot ul ol dl blockquote figure"
    " figcaption address summary caption".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# an open element of the key ends where one of the values begins, up to the limits after it
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# Furniture: by tag wherever it stands; by role; by words of class and id.
ALWAYS = set(
    "head nav footer aside script style noscript template iframe button select textarea dialog menu"
    " svg canvas object audio video datalist noembed noframes title".split()
)
ROLES = set(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form"
    " toolbar status".split()
)
COMMENTS = set("comment comments disqus reply replies respond discussion commentlist".split())
WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar ad ads"
    " adv advert adverts advertisement advertising adsense adsbygoogle adslot banner promo"
    " promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended recommendations pagination pager toolbar widget".split()
)
# Words that speak for an element.
GOOD = set("article content entry main post story body text".split())

_token = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)"
    r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
_attribute = re.compile(
    r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S
)
_number = re.compile(r"\d+")
_cut = re.compile(r"[^a-z]+")
_camel = re.compile(r"([a-z])([A-Z])")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}

# kinds of elements
PLAIN, SOFT, HARD, HEADING_ONLY = range(4)


@dataclass
class Page:
    """Elements (parents before children; 0 is the page) and blocks of a page."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [0])
    kinds: list[int] = field(default_factory=lambda: [PLAIN])
    good: list[bool] = field(default_factory=lambda: [False])
    # (number of the path above, own part) -> number of a path
    known: dict[tuple[int, str], int] = field(default_factory=dict)
    parts: list[tuple[int, str]] = field(default_factory=lambda: [(0, "")])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path_name(self, number: int) -> str:
        names = []
        while number:
            number, part = self.parts[number]
            names.append(part)
        return ">".join(reversed(names))

    def path_number(self, name: str) -> int | None:
        number = 0
        for part in name.split(">") if name else ():
            number = self.known.get((number, part))
            if number is None:
                return None
        return number


def _words(names: str) -> set[str]:
    return set(_cut.split(_camel.sub(r"\1 \2", names).lower()))


def _element(tag: str, attributes: str) -> tuple[str, int, bool]:
    """Part of the path, kind, and whether its names speak for it."""
    if not attributes or attributes.isspace():
        kind = HARD if tag in ALWAYS else SOFT if tag == "form" else PLAIN
        return tag, kind, False
    got = {
        m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _attribute.finditer(attributes)
    }
    classes = got.get("class", "")
    part = ".".join([tag, *sorted({_number.sub("#", c).replace(">", "") for c in classes.split()})])
    if (
        tag in ALWAYS
        or "hidden" in got
        or got.get("aria-hidden", "").lower() == "true"
        or _hidden.search(got.get("style", ""))
    ):
        return part, HARD, False
    names = _words(f"{classes} {got.get('id', '')}")
    role = got.get("role", "").lower()
    if tag in ("article", "main"):
        kind = HARD if COMMENTS & set(classes.lower().split()) else PLAIN
        return part, kind, True
    if names & COMMENTS:
        return part, HARD, False
    if tag == "form" or role in ROLES or names & WORDS:
        return part, SOFT, False
    main = role == "main" or got.get("itemprop", "").lower() == "articlebody"
    return part, PLAIN, main or bool(names & GOOD)


def _marks(html: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Start and end of every mark, raw contents as part of their start tag's mark."""
    at = 0
    while True:
        m = _token.search(html, at)
        if m is None:
            return
        end = m.end()
        tag = (m[2] or "").lower()
        if tag in RAW and not m[1]:
            close = _raw_end[tag].search(html, end)
            yield m.start(), close.end() if close else len(html), None
            at = close.end() if close else len(html)
        else:
            yield m.start(), end, m
            at = end


def read(html: str) -> Page:
    page = Page()
    tags, parents, paths, kinds = page.tags, page.parents, page.paths, page.kinds
    # open elements: (tag, element); inline ones stand for the element around them
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    link_chars = 0

    def finish() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                page.blocks.append((stack[-1][1], text, min(link_chars, len(text))))
            pieces.clear()
        link_chars = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag, element = stack[-1]
            if element != stack[-2][1]:
                finish()
            opened[tag] -= 1
            stack.pop()

    def last(names: set[str], limits: set[str]) -> int | None:
        """Depth of the innermost open element of these names; None if there is a limit above it."""
        if not any(opened[name] for name in names):
            return None
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth][0]
            if tag in names:
                return depth
            if tag in limits:
                return None
        return None

    at = 0
    for start, end, mark in _marks(html):
        if start > at:
            pieces.append(html[at:start])
            if opened["a"]:
                link_chars += start - at
        at = end
        if mark is None or mark[2] is None:
            continue
        tag = mark[2].lower()
        if tag in ("html", "body"):
            if not mark[1] and tag == "body":
                close(1)
            finish()
            continue
        if mark[1]:
            depth = last({tag}, {"td", "th"} if tag in ("b", "i", "a", "span") else set())
            if depth is not None:
                close(depth)
            elif tag not in INLINE:
                finish()
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag not in INLINE:
                finish()
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        inline = tag in INLINE
        if not inline:
            if tag in ENDS:
                depth = last(*ENDS[tag])
                if depth is not None:
                    close(depth)
            depth = last({"p"}, {"td", "th", "li", "button", "object"} if tag == "p" else {"button"})
            if depth is not None:
                close(depth)
        part, kind, good = _element(tag, mark[3])
        if inline and kind == PLAIN:
            stack.append((tag, stack[-1][1]))
            opened[tag] += 1
            continue
        finish()
        above = stack[-1][1]
        key = (paths[above], part)
        number = page.known.get(key)
        if number is None:
            number = page.known[key] = len(page.parts)
            page.parts.append(key)
        tags.append(tag)
        parents.append(above)
        paths.append(number)
        kinds.append(kind)
        page.good.append(good)
        stack.append((tag, len(tags) - 1))
        opened[tag] += 1
    if at < len(html):
        pieces.append(html[at:])
        if opened["a"]:
            link_chars += len(html) - at
    close(1)
    finish()
    _settle(page)
    return page


def _settle(page: Page) -> None:
    """Turns the kinds into what is kept: furniture takes all below it along.

    What is furniture by its names alone stays when the article, the main part or a first heading
    stands in it (a class like "has-sidebar" of a frame). A header of the page is furniture, a
    header inside the article keeps its headings.
    """
    tags, parents, kinds = page.tags, page.parents, page.kinds
    count = len(tags)
    core = [tags[i] in ("article", "main", "h1") and kinds[i] == PLAIN for i in range(count)]
    for i in range(count - 1, 0, -1):
        if core[i] and kinds[i] != HARD:
            core[parents[i]] = True
    inside = [False] * count
    for i in range(1, count):
        above, tag = parents[i], tags[i]
        inside[i] = inside[above] or tag in ("article", "main")
        kind = kinds[i]
        if kind == SOFT:
            kind = PLAIN if core[i] else HARD
        if tag == "header" and kind == PLAIN:
            kind = HEADING_ONLY if inside[above] else HARD
        if kinds[above] == HARD:
            kind = HARD
        elif kinds[above] == HEADING_ONLY and kind == PLAIN and tag not in HEADINGS:
            kind = HEADING_ONLY
        kinds[i] = kind
    page.blocks = [b for b in page.blocks if kinds[b[0]] == PLAIN]
