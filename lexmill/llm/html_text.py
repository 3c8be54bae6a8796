"""Main-text extraction by line-block distribution.

Markup is stripped in one scan: every block element (paragraph, heading, list item, ...)
becomes a line, with the count of its characters inside links.  Elements that never hold
an article (scripts, styles, menus, forms, asides, page headers and footers, and boxes
whose role or name says so) give no text; they leave an empty line, and page furniture
leaves a window of them, as does the border of an article or main element.

The lengths of the lines, without link text, are summed over sliding windows.  Where a
window sum surges over the page's level text begins; where it dives to nothing text ends.
The lines between a surge and its dive are the main text, with what stands in the same
element as they do: from its first to its last text, with the links between, and a link
or two at its ends (in an article or main element, all of it).  If elements of that kind
hold at least half of the text found, text outside them is left out.

A name (class, id, role or aria-label) marks a box only as a whole: each of its words must
be a box's word or one that says nothing, and one at least a box's ("site-nav", not
"related-work").  Words for boxes of links (``LINKED``) count inside an article only where
the element's text is links for the most part.

The scan takes time in proportion to the page, whatever the page: every search goes on
from where the last one ended, and what isn't found once isn't looked for again.

Defined cases: null or blank html gives an empty text; a page without tags is one line and
its own main text; unclosed tags end at the next block; a "<" that no ">" follows is text,
as is all after it; a quote that never closes doesn't hide the ">" after it; an unclosed
comment, script or style reaches to the end; a page whose boxes leave nothing is read again
by element names alone; equal rows give equal results; an empty table gives an empty
result; extra columns are ignored.  Only one page is held at a time, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import small_batches

WINDOW, SURGE = 3, 80

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　]+")
_WORD = re.compile(r"[A-Za-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")

# Element names by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
FURNITURE = {"nav", "footer", "header", "aside"}
NEVER = {"form", "template", "dialog", "menu", "head", "fieldset"}
#: Left out like NEVER, but standing inside a line: what is before and after belongs together.
INLINE = {"svg", "button", "select", "canvas", "audio", "video", "object", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "option", "legend"}
HOLDER = {"div", "section", "td", "details", "blockquote", "center"}
CONTAINER = {"article", "main"}
# Words in the names of boxes.
BOXES = set("nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar sidebars footer masthead topbar cookie cookies consent gdpr notice notices ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored promo promotion comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager skiplink copyright complementary contentinfo".split())
#: Boxes of links.
LINKED = set("related recommended recommendations share sharing social trending popular teaser teasers".split())
#: Boxes unless a word of TEXT stands beside, with which they name parts of an article.
PARTS = set("header banner foot side search form dialog widget widgets alert notification notifications skip aside".split())
TEXT = set("content article post entry body main story text".split())
#: Words that say nothing about what an element is.
PLAIN = set("google gpt dfp div cta site page pages posts articles stories blog home my new the js id user reader web section area box block container wrapper wrap inner outer holder list item items row col column panel region zone slot unit module group link links bar top bottom left right upper lower primary secondary global local mobile desktop small large big wide inline sticky fixed float dropdown toggle icon icons button buttons".split())
#: Words for readers' comments, which name an article element too.
COMMENTS = set("comment comments commentlist disqus respond".split())
#: Words that make a name a state of the page, such as has-sidebar or comments-open.
STATES = set("has have no with without is not open opened closed enabled disabled visible active layout".split())


@dataclass
class Line:
    text: str
    linked: int
    container: int  # number of the innermost article or main element, or 0
    holder: int  # number of the innermost element that holds blocks, or 0
    maybe: int = 0  # the outermost element around it that is a box if its text is links, or 0

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - self.linked)


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    gaps: list[int] = field(default_factory=list)  # empty lines before each line
    outer: dict[int, int] = field(default_factory=dict)  # container -> the container around it


def box_kind(name: str, attrs: str, inside_article: bool) -> str:
    """box, furniture, inline, linked (a box if its text is links), or nothing.

    Inside an article the id of a section is the anchor of its heading, and names of article
    elements say what they are about: of both only the words for comments count.
    """
    if name in NEVER:
        return "box"
    if name in FURNITURE:
        return "" if name == "header" and inside_article else "furniture"
    if name in INLINE:
        return "inline"
    if not attrs or name in ("main", "body", "html") or name[0] == "h" and name[1:].isdigit():
        return ""
    if _HIDDEN.search(attrs):
        return "box"
    found = ""
    for m in _HINT.finditer(attrs):
        anchor = name == "article" or name == "section" and inside_article and m[0].lstrip()[:2].lower() == "id"
        for said in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORD.findall(_HUMP.sub(r"\1 \2", said)) if len(w) > 1]
            if not words or words[0] in STATES or words[-1] in STATES:
                continue
            sure, linked, part = BOXES.intersection(words), LINKED.intersection(words), PARTS.intersection(words)
            if anchor and not COMMENTS.intersection(words):
                continue
            if not (sure or linked or part) or set(words) - BOXES - LINKED - PARTS - TEXT - PLAIN:
                continue
            if sure or part and not TEXT.intersection(words):
                return "box"
            if linked:
                found = "linked" if inside_article else "box"
    return found


class _Tags:
    """Finds the ends of tags and raw elements; time in proportion to the page over all calls."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.quotes = True
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """Where the ">" of a tag is whose name ends at ``at``; -1 if there is none."""
        at_first, html = at, self.html
        while self.quotes:
            m = _STOP.search(html, at)
            if not m:
                self.quotes = False  # from here on a quote hides nothing, or this would be looked for again
                break
            if m[0] == ">":
                return m.start()
            close = -1 if m[0] in self.unclosed else html.find(m[0], m.end())
            if close < 0:
                self.unclosed.add(m[0])
            at = max(close + 1, m.end())
        return html.find(">", at_first)

    def raw_end(self, name: str, at: int) -> int:
        """After the closing tag of a raw element; -1 if there is none."""
        if name not in self.unclosed:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.html, at)
            close = self.html.find(">", m.end()) if m else -1
            if close >= 0:
                return close + 1
            self.unclosed.add(name)
        return -1


def read_page(html: str, hints: bool = True) -> Page:
    """The lines of a page in order.  Without ``hints`` only element names tell what is left out."""
    page, tags = Page(), _Tags(html)
    parts: list[str] = []
    linked = links = gap = n_containers = n_holders = 0
    skip: list[str] = []  # open elements from the first box on
    skipped: Counter[str] = Counter()
    leaves = 0  # empty lines that the box leaves
    containers: list[int] = []
    holders: list[tuple[str, int, int]] = []  # name, number, outermost box of links so far or 0
    held: Counter[str] = Counter()
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked, gap
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                page.lines.append(Line(text, min(linked, len(text)), containers[-1] if containers else 0, *(holders[-1][1:] if holders else (0, 0))))
                page.gaps.append(gap)
                gap = 0
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not skip:
            parts.append(text)
            if links:
                linked += len(text)

    while at < n:
        start = html.find("<", at)
        if start < 0:
            take(html[at:])
            break
        take(html[at:start])
        if html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            at = close + 3 if close >= 0 else n
            continue
        if html.startswith("<![CDATA[", start):
            close = html.find("]]>", start)
            at = close + 3 if close >= 0 else n
            continue
        m = _NAME.match(html, start + 1)
        if not m and html[start + 1 : start + 2] not in ("!", "?"):
            take("<")
            at = start + 1
            continue
        close = tags.end(m.end()) if m else html.find(">", start)
        if close < 0:
            take(html[start:])
            break
        at = close + 1
        if not m:
            continue
        closing = m[0][0] == "/"
        name, attrs = m[0].lstrip("/").lower(), html[m.end() : close]
        if not closing and name in RAW:
            if attrs.rstrip().endswith("/"):
                continue
            end = tags.raw_end(name, at)
            at = end if end >= 0 else (n if name in ("script", "style") else at)
            if name == "title":
                flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                take(" ")
            continue
        if skip:
            if closing:
                if skipped[name]:  # an unclosed element inside ends with its box
                    while True:
                        gone = skip.pop()
                        skipped[gone] -= 1
                        if gone == name:
                            break
                    if not skip:
                        gap = max(gap, leaves)
            elif not attrs.endswith("/"):
                skip.append(name)
                skipped[name] += 1
            continue
        if name in BLOCK:
            flush()
        if closing:
            if name in CONTAINER and containers:
                containers.pop()
                if not containers:
                    gap = WINDOW
            elif name == "a":
                links = max(0, links - 1)
            elif held[name]:
                while True:
                    gone = holders.pop()[0]
                    held[gone] -= 1
                    if gone == name:
                        break
            continue
        kind = box_kind(name, attrs if hints else "", bool(containers))
        if kind in ("box", "furniture", "inline"):
            if not attrs.endswith("/"):
                if kind != "inline":
                    flush()
                skip.append(name)
                skipped[name] += 1
                leaves = {"furniture": WINDOW, "box": 1, "inline": 0}[kind]
            continue
        if name in CONTAINER:
            if not containers:
                gap = WINDOW
            n_containers += 1
            page.outer[n_containers] = containers[-1] if containers else 0
            containers.append(n_containers)
        elif name in HOLDER:
            n_holders += 1
            around = holders[-1][2] if holders else 0
            holders.append((name, n_holders, around or (n_holders if kind == "linked" else 0)))
            held[name] += 1
        elif name == "a" and "href" in attrs.lower():
            links += 1
    flush()
    return page


def _without_link_boxes(page: Page) -> Page:
    """The page without those boxes of links whose text is links for the most part."""
    size, linked = Counter(), Counter()
    for x in page.lines:
        size[x.maybe] += len(x.text)
        linked[x.maybe] += x.linked
    boxes = {b for b in size if b and 2 * linked[b] >= size[b]}
    if not boxes:
        return page
    out = Page(outer=page.outer)
    more = 0
    for x, gap in zip(page.lines, page.gaps, strict=True):
        if x.maybe in boxes:
            more = max(more, gap, 1)
        else:
            out.lines.append(x)
            out.gaps.append(max(gap, more))
            more = 0
    return out


def body_spans(lengths: list[int], window: int = WINDOW, surge: int | None = None) -> list[tuple[int, int]]:
    """[start, stop) spans of lines from a surge to its dive.

    A window sum over ``surge`` makes a span, unless the windows after it fall to nothing at
    once and the line alone isn't twice as long; the span reaches from the last empty window
    before to the first after.  ``surge`` is by default a quarter of the window sum that half
    of the text reaches, SURGE at most.
    """
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    level = surge
    if level is None:
        half, level = sum(sums) / 2, 0
        for x in sorted(sums, reverse=True):
            half -= x
            if half <= 0:
                level = min(SURGE, x // 4)
                break
    spans, i, past = [], 0, 0
    while i < n:
        if sums[i] > level and lengths[i] and (lengths[i] > 2 * level or all(s > 0 for s in sums[i : min(n, i + window)])):
            stop = i + 1
            while stop < n and sums[stop] > 0:
                stop += 1
            while i > past and sums[i - 1] > 0:
                i -= 1
            spans.append((i, stop))
            i = past = stop
        else:
            i += 1
    return spans


def main_text(html: str | None, window: int = WINDOW) -> str:
    if not html:
        return ""
    page = _without_link_boxes(read_page(html))
    if not page.lines:
        page = read_page(html, hints=False)
    lines = page.lines
    if not lines:
        return ""
    lengths: list[int] = []
    at: list[int] = []  # line -> its place among all lines, empty ones too
    for x, gap in zip(lines, page.gaps, strict=True):
        lengths += [0] * min(gap, window)
        at.append(len(lengths))
        lengths.append(x.plain)
    spanned = [False] * len(lengths)
    for start, stop in body_spans(lengths, window) or [(0, len(lengths))]:
        spanned[start:stop] = [True] * (stop - start)
    keep = [spanned[p] for p in at]

    # Elements that hold text of a span: (is an article or main, number) -> [lines].
    home = [(True, x.container) if x.container else (False, x.holder) for x in lines]
    members: dict[tuple[bool, int], list[int]] = {}
    for i, h in enumerate(home):
        members.setdefault(h, []).append(i)
    for (article, number), own in members.items():
        if not number or not any(keep[i] and lines[i].plain for i in own):
            continue
        text = [k for k, i in enumerate(own) if lines[i].plain]
        first, last = text[0], text[-1]
        if article:
            first, last = 0, len(own) - 1
        else:
            before, after = first, len(own) - 1 - last
            first, last = first - before * (before < window), last + after * (after < window)
        for i in own[first : last + 1]:
            keep[i] = True
    inside = sum(x.plain for x, k in zip(lines, keep, strict=True) if k and x.container)
    if 2 * inside >= sum(x.plain for x, k in zip(lines, keep, strict=True) if k) and inside:
        keep = [k and bool(x.container) for k, x in zip(keep, lines, strict=True)]
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def _extract(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, window) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return run


def extract_main_text(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``; no shuffle."""
    small_batches(pages.sparkSession, 500)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(window), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
