"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path. Per path, text length and
punctuation are set against the number of nodes and links; both ratios are smoothed along the page,
fused, and weighted by what tags and class names say. The best path's container is the article; the
content nodes are those on paths whose ratio is high enough, in a named container too.

What a class name says is one weight among others: an element named like a sidebar or a notice is
left out unless it holds the page's article; one whose name only has such a word in it stays too if
it holds most of the text of a page without a named article.
Time and memory are linear in the page's length, however deep elements nest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what HTML says they hold.
RAW = "script style textarea title noscript template iframe noembed noframes xmp svg math".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILERPLATE = (
    "head nav footer aside form button select dialog menu noscript template iframe object "
    "fieldset label"
).split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small "
    "span strike strong sub sup time tt u var wbr"
).split()
CONTAINERS = ("article", "main")
# Elements that group blocks: only these can hold an article that nothing names.
HOLDERS = ("html", "body", "div", "section", "center", "table", "tbody")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Elements that an opening tag of the same group ends.
ENDS_PARAGRAPH = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
).split()
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_NAMES = (
    r"ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|"
    r"notice|notification|popup|modal|newsletter|subscribe|subscription|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|side-bar|widget|header|masthead|footer|comments?|disqus|replies|reply|"
    r"respond|share|sharing|social|related|recommended|pagination|pager|toolbar|skip|login|"
    r"copyright|legal|disclaimer"
)
# A name that is one of these, or that has one of them as a part.
NAMED = re.compile(rf"(?:^|\s)(?:{_NAMES})(?:$|\s)", re.I)
PARTLY = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:$|[\s_-])", re.I)
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛،¿¡]")
WHITE = re.compile(r"\s+")
# Names of reader comments, which no amount of text makes an article.
COMMENTS = re.compile(r"(?:^|\s)(?:disqus_thread|comments?[_-](?:list|area|section))(?:$|\s)", re.I)
_MARKUP = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_STOP = re.compile(r"[>\"']")
# Quoted values of one tag; a tag with more ends at its first ">".
_VALUES = 100
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

SMOOTH = (0.25, 0.5, 0.25)
# Share of the best path's fused ratio that makes a path content, where no container is named.
THRESHOLD = 0.1


@dataclass
class Path:
    """What one root-to-leaf tag path holds over the whole page."""

    nodes: int = 0
    length: int = 0
    marks: int = 0
    linked: int = 0
    order: int = 0
    score: float = 0.0


@dataclass
class Page:
    """Elements in page order, each after the one it stands in, and text nodes.

    Element 0 stands around the page. ``path`` numbers tag paths: elements of equal tags from the
    root on share one. ``texts`` has (element, block, text) in page order.
    """

    texts: list[tuple[int, int, str]] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    marked: list[str] = field(default_factory=lambda: [""])

    def inherited(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it is so."""
        found = list(own)
        for e in range(1, len(found)):
            found[e] = found[e] or found[self.above[e]]
        return found

    def summed(self, own: list[float]) -> list[float]:
        """Sums over each element and all inside it."""
        found = list(own)
        for e in range(len(found) - 1, 0, -1):
            found[self.above[e]] += found[e]
        return found


# What says that an element is not the article: its tag or state, its name, or a part of its name.
_SURE, _NAME, _PART = "sure", "name", "part"


def _mark(name: str, attributes: str, inside: bool) -> str:
    """How an element says that it is not the article, if so; ``inside``: it stands in one."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return _SURE
    if not attributes or name in CONTAINERS or name in ("html", "body"):
        return ""
    found = ""
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in ROLES:
            return _SURE
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return _SURE
        if key == "style" and HIDDEN.search(value):
            return _SURE
        if key in ("class", "id") and PARTLY.search(value):
            whole = NAMED.search(value) or COMMENTS.search(value) or found == _NAME
            found = _NAME if whole else _PART
    return found


def _tag_end(html: str, at: int) -> int:
    """Where the tag whose attributes begin at ``at`` ends; a ">" in a quoted value is none. -1
    where no ">" follows."""
    first = html.find(">", at)
    if first < 0:
        return -1
    place = at
    for _ in range(_VALUES):
        stop = _STOP.search(html, place)
        if stop is None:
            return first
        if stop[0] == ">":
            return stop.start()
        place = html.find(stop[0], stop.end()) + 1
        if not place:
            return first
    return first


def _tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of markup; comments and the like have no name."""
    at = 0
    while (found := _MARKUP.search(html, at)) is not None:
        start, (comment, closes, name) = found.start(), found.groups()
        if comment:
            end = html.find("-->", found.end())
            at = len(html) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        end = _tag_end(html, found.end()) if name else html.find(">", found.end())
        if end < 0:
            # No ">" is left: what remains is text, but for a comment that never ends.
            start = html.find("<!--", start)
            if start >= 0:
                yield start, len(html), "", False, ""
            return
        at, name = end + 1, (name or "").lower()
        if name in _RAW_END and not closes:
            close = _RAW_END[name].search(html, at)
            at = len(html) if close is None else close.end()
            name = ""
        yield start, at, name, bool(closes), html[found.end() : end]


def read(html: str) -> Page:
    """The page's elements and its text nodes in page order."""
    page = Page()
    # Open elements, and for each the nearest ones that are no inline elements: with it, and
    # leaving paragraphs out too.
    stack, block_at, group_at = [0], [0], [0]
    opened: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}
    block = at = containers = 0

    def text(until: int) -> None:
        if until > at:
            found = html[at:until]
            if found.strip():
                page.texts.append((stack[-1], block, unescape(found)))
            elif page.texts and page.texts[-1][1] == block:
                page.texts.append((stack[-1], block, " "))

    def close(depth: int) -> int:
        shut = 0
        for e in stack[depth:]:
            opened[page.names[e]] -= 1
            shut += page.names[e] in CONTAINERS
        del stack[depth:], block_at[depth:], group_at[depth:]
        return shut

    for start, end, name, closes, attributes in _tokens(html):
        text(start)
        at = end
        if not name:
            continue
        if name not in INLINE:
            block += 1
        if closes:
            if opened.get(name):
                depth = len(stack) - 1
                while page.names[stack[depth]] != name:
                    depth -= 1
                containers -= close(depth)
            continue
        if name in VOID or attributes.endswith("/") and name not in ("p", "div"):
            continue
        if name in ENDS_PARAGRAPH and page.names[stack[block_at[-1]]] == "p":
            containers -= close(block_at[-1])
        if page.names[stack[group_at[-1]]] in SIBLINGS.get(name, ()):
            containers -= close(group_at[-1])
        above = stack[-1]
        element = len(page.names)
        page.names.append(name)
        page.above.append(above)
        page.path.append(paths.setdefault((page.path[above], name), len(paths) + 1))
        page.marked.append(_mark(name, attributes, containers > 0))
        containers += name in CONTAINERS
        opened[name] = opened.get(name, 0) + 1
        stack.append(element)
        block_at.append(block_at[-1] if name in INLINE else len(stack) - 1)
        group_at.append(group_at[-1] if name in INLINE or name == "p" else len(stack) - 1)
    text(len(html))
    return page


def dropped(page: Page) -> list[bool]:
    """Which elements are not the article by tags and names, with all they hold."""
    size = [0.0] * len(page.names)
    sure = page.inherited([m == _SURE for m in page.marked])
    for e, _, text in page.texts:
        if not sure[e]:
            size[e] += len(text.strip())
    size = page.summed(size)
    articles = page.summed([
        float(n in CONTAINERS and size[e] > 0) for e, n in enumerate(page.names)
    ])
    most = size[0] / 2 if not articles[0] else float("inf")
    return page.inherited([
        m == _SURE
        or m == _NAME and not articles[e]
        or m == _PART and not articles[e] and size[e] <= most
        for e, m in enumerate(page.marked)
    ])


def ratios(page: Page) -> dict[int, Path]:
    """Paths with their fused scores: length and punctuation per node, smoothed along the page."""
    found: dict[int, Path] = {}
    linked = page.inherited([n == "a" for n in page.names])
    for element, _, text in page.texts:
        path = found.setdefault(page.path[element], Path(order=len(found)))
        path.nodes += 1
        path.length += len(text.strip())
        path.marks += len(PUNCTUATION.findall(text))
        if linked[element]:
            path.linked += len(text.strip())
    ordered = sorted(found.values(), key=lambda p: p.order)

    def smoothed(values: list[float]) -> list[float]:
        padded = [values[0], *values, values[-1]] if values else []
        return [
            sum(w * v for w, v in zip(SMOOTH, padded[i : i + 3])) for i in range(len(values))
        ]

    lengths = smoothed([p.length / p.nodes for p in ordered])
    marks = smoothed([p.marks / p.nodes for p in ordered])
    for p, length, mark in zip(ordered, lengths, marks):
        p.score = length * (1 + log1p(mark)) * (1 - p.linked / max(1, p.length))
    return found


def main_text(html: str | None) -> str:
    """The article's blocks joined by single spaces; empty for null, blank or menu-only pages."""
    page = read((html or "").replace("\x00", ""))
    scored, gone = ratios(page), dropped(page)
    kept = [x for x in page.texts if not gone[x[0]]]
    if not kept:
        return ""
    score = lambda element: scored[page.path[element]].score
    heading = page.inherited([n in HEADINGS for n in page.names])
    weight = [0.0] * len(page.names)
    for element, _, text in kept:
        weight[element] += score(element) + len(text.strip())
    weight = page.summed(weight)
    named = [n in CONTAINERS and weight[e] > 0 for e, n in enumerate(page.names)]
    if any(named):
        within = page.inherited(named)
        outermost = [e for e, n in enumerate(named) if n and not within[page.above[e]]]
        articles = [e for e in outermost if page.names[e] == "article"] or outermost
        best = max(articles, key=lambda e: (weight[e], -e))
        inside = page.inherited([e == best for e in range(len(page.names))])
        menus = _menus(page, kept)
        chosen = [(b, t) for e, b, t in kept if inside[e] and (heading[e] or not menus[e])]
    else:
        best_score = max(score(e) for e, _, _ in kept)
        good = {name for name, p in scored.items() if p.score >= THRESHOLD * best_score}
        holds = [0.0] * len(page.names)
        for e, _, _ in kept:
            holds[e] += page.path[e] in good and not heading[e]
        total = sum(holds)
        holds = page.summed(holds)
        # The smallest element that holds all content; headings may stand before it.
        inner = max(
            (e for e, n in enumerate(page.names) if total and holds[e] == total and n in HOLDERS),
            default=0,
        )
        inside = page.inherited([e == inner for e in range(len(page.names))])
        chosen, begun = [], False
        for e, b, t in kept:
            begun = begun or inside[e]
            if (inside[e] or not begun) and (heading[e] or page.path[e] in good):
                chosen.append((b, t))
    blocks: dict[int, list[str]] = {}
    for block, text in chosen:
        blocks.setdefault(block, []).append(text)
    joined = (WHITE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return " ".join(x for x in joined if x)


def _menus(page: Page, kept: list[tuple[int, int, str]]) -> list[bool]:
    """Elements on list paths whose ratio of text outside links is nothing: menus in an article.

    The ratio is taken per path of list items, over all their text, so that a link in prose or in a
    list with other words in it stays.
    """
    item = [0] * len(page.names)
    for e in range(1, len(item)):
        item[e] = page.path[e] if page.names[e] == "li" else item[page.above[e]]
    linked = page.inherited([n == "a" for n in page.names])
    outside: dict[int, int] = {}
    for e, _, text in kept:
        if not linked[e]:
            outside[item[e]] = outside.get(item[e], 0) + len(text.strip())
    return [bool(i) and not outside.get(i) for i in item]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array(map(len, texts), pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def extracted(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars; a scan without a shuffle.

    Defined cases: a null or empty html gives the empty text; repeated rows and equal ids are read
    one by one; other columns are ignored; an empty table gives an empty table; unclosed, crossed
    and unknown tags are read as far as they nest, in time and memory linear in the page; a quoted
    value that never ends makes its tag end at the next ">", and so does a tag with more than 100
    quoted values.
    """
    wanted = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    kind = wanted.schema["page_id"].dataType.simpleString()
    return wanted.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
