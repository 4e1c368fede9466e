"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element; a line inside a menu, header, footer, sidebar, notice, advert, form,
script, style or reader comment is left out, link text has no length.  The lengths are summed over a sliding window of
``WINDOW`` lines; text starts at a surge of the sums (``SURGE`` characters or more) and stops where they dive (below ``DIVE``).
The stretch between is cut to its long lines, headings before it and sentences beside it belong to it, and no line of it is
dropped.  Lines within a marked article all count, however short.

What lies outside the stretches and marks is dropped only as a menu: lines of nothing but links, two of which share a window
whose own text is below a dive (or one line of several links), unless text of the same element stands before and after them.
With a menu go short lines between its links, the short line right before it (its label) and, if less than a window stands
between the last menu and the page's end, short lines there; sentences and what ``CONTENT`` elements say outside links never
go.  A page on which nothing surges and nothing is marked is one stretch.

Where the marked lines surge by themselves and hold half of the page's own text or more, the page says where its article is:
outside it ``CONTENT`` elements, headings right before a line kept and stretches of several long lines are text, what else stands
there is the page's header, footer or advert and dropped too.

Rows: a null or empty html gives an empty text of 0 characters; a page cut short anywhere is read as far as it goes;
repeated rows and null ids or urls are carried; an empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WINDOW = 3
SURGE, DIVE, LONG = 80, 20, 40  # characters of a window, of a window, of a line

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)

RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "title", "tr", "ul",
}
BOILERPLATE = {"nav", "menu", "header", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "svg", "canvas", "object", "audio", "video", "head", "search"}
# Words of class, id and role that mark what is not the article.
MARKS = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
    "complementary", "discussion",
}
CONTENT = {"h1", "p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption"}  # their own words are no label of a menu
HOLDERS = {"article", "body", "center", "details", "div", "main", "section", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE_MARKS = {"article", "articlebody", "main", "story", "entry", "post"}
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
PAIRED = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "li", "option", "body", "html", "head", "caption", "tbody", "thead", "tfoot", "dt", "dd"}
_long_reference = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_zeros = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])")
SENTENCE_ENDS = tuple(".!?…。！？؟।")
_href = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_cut = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


class Line:
    __slots__ = ("anchor", "article", "content", "heading", "holder", "links", "own", "parts", "useful")

    def __init__(self, useful: bool, article: bool):
        self.parts, self.own, self.useful, self.article, self.heading = [], [], useful, article, False
        self.links, self.anchor, self.content, self.holder = 0, 0, False, None  # links, the last one's number, in a CONTENT element, the HOLDERS element around


def marks(attributes: str) -> tuple[set[str], bool]:
    """(words of class, id, role and itemprop; whether the element is hidden)."""
    words, hidden = set(), False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            words |= {w.lower() for w in _cut.split(value) if w}
    return words, hidden


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; what is outside any block belongs to the line it falls in."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool, int, bool]] = []  # name, link, useful, article, number of the HOLDERS element, in a CONTENT element of it
    useful, article, anchors, headings, at = True, False, 0, 0, 0
    holder, content, anchor, number = 0, False, 0, 0
    line = Line(True, False)

    def fresh() -> None:
        nonlocal line
        if line.parts:
            out.append(line)
        line = Line(useful, article)

    def text(s: str) -> None:
        nonlocal line
        if line.useful != useful or line.article != article:
            fresh()
        if s.strip():
            if line.holder is None:
                line.holder, line.content = holder, content
            if anchors and line.anchor != anchor:
                line.links, line.anchor = line.links + 1, anchor
        line.parts.append(s)
        line.own.append(" " if anchors else s)
        line.heading = line.heading or headings > 0

    def pop(k: int) -> None:
        nonlocal useful, article, holder, content, anchors, headings
        for name, link, *_ in stack[k:]:
            anchors -= link
            headings -= name in HEADINGS
        del stack[k:]
        useful, article, holder, content = stack[-1][2:] if stack else (True, False, 0, False)

    def last(names: tuple[str, ...], walls: set[str]) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in walls:
                return None
        return None

    n = len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, open_)
        if not m:
            text(page[at : open_ + 1])
            at = open_ + 1
            continue
        if open_ > at:
            text(page[at:open_])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and stack:
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        block = name in BLOCKS
        if m[1] or m[4]:
            k = last((name,), {"article", "body"} - {name} if name not in ("html", "body", "article") else set())
            if k is not None:
                pop(k)
            if block:
                fresh()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            if block:
                fresh()
            continue
        if name in ENDS_PARAGRAPH and (k := last(("p",), BLOCKS - {"p"})) is not None:
            pop(k)
        if name in CLOSES_ITSELF and (k := last(PAIRED.get(name, (name,)), CLOSES_ITSELF[name])) is not None:
            pop(k)
        if name == "a" and anchors and (k := last(("a",), BLOCKS)) is not None:
            pop(k)
        if name in VOID:
            if block:
                fresh()
            elif name == "br":
                text(" ")
            continue
        words, hidden = marks(m[3] or m[6] or "")
        whole = name in ("html", "body", "article", "main")
        inside = article and name == "header"  # an article's own header holds its title
        useful_now = useful and not hidden and (whole or inside or (name not in BOILERPLATE and not words & MARKS))
        article_now = article or name in ("article", "main") or bool(words & ARTICLE_MARKS and not whole and useful_now)
        if not (m[3] or "").rstrip().endswith("/") or block:
            link = name == "a" and _href.search(m[3] or m[6] or "") is not None
            number += 1
            if name in HOLDERS:
                holder, content = number, False
            content = content or name in CONTENT
            useful, article = useful_now, article_now
            stack.append((name, link, useful, article, holder, content))
            if link:
                anchors, anchor = anchors + 1, number
            headings += name in HEADINGS
        if block:
            fresh()
    fresh()
    return out


def decoded(s: str) -> str:
    """Character references decoded; those of more digits than any code point has are the replacement character."""
    return entities.unescape(_long_reference.sub("\ufffd", _zeros.sub(r"\1", s)) if "&#" in s else s)


def stretches(lengths: list[int], surge: int, dive: int) -> list[tuple[int, int]]:
    """Runs (first line, line behind the last) of the distribution: from a window sum of ``surge`` to one below ``dive``."""
    sums = [sum(lengths[k : k + WINDOW]) for k in range(len(lengths))]
    out, start = [], None
    for k, s in enumerate([*sums, 0]):
        if start is None and s >= surge:
            start = k
        elif start is not None and s < dive:
            out.append((start, min(k + WINDOW - 1, len(lengths))))
            start = None
    return [x for k, x in enumerate(out) if x[0] < x[1]]


def closed(text: str) -> bool:
    """Whether a line ends as a sentence does."""
    return text.rstrip("\"'»”’)」』").endswith(SENTENCE_ENDS)


def own_text(text: str, line: Line) -> str:
    """What of a line's text stands outside links."""
    return " ".join(decoded("".join(line.own)).split()) if line.links else text


def surging(lines: list[tuple[str, Line]], lengths: list[int]) -> set[int]:
    """The lines of the stretches, from the first long one to the last with what stands beside them."""
    keep: set[int] = set()
    for a, b in stretches(lengths, SURGE, DIVE):
        long = [k for k in range(a, b) if lengths[k] >= LONG]
        if not long:
            keep.update(range(a, b))
            continue
        first, last = long[0], long[-1]
        beside = lambda k: lengths[k] > 0 and (lines[k][1].heading or lines[k][0].rstrip("\"'»”’)")[-1:] in ".!?…:")
        while first > 0 and beside(first - 1):
            first -= 1
        while last + 1 < len(lines) and beside(last + 1) and not lines[last + 1][1].heading:
            last += 1
        keep.update(range(first, last + 1))
    return keep


def menus(lines: list[tuple[str, Line]], lengths: list[int], bare: list[bool], short: list[bool], text: set[int]) -> set[int]:
    """The lines outside ``text`` that are menus, their labels and what follows the last of them."""
    spans: dict[int, tuple[int, int]] = {}  # of each element, the first and last line of text
    for k in sorted(text):
        h = lines[k][1].holder
        spans[h] = (spans.get(h, (k, k))[0], k)
    link = [bare[k] and k not in text and not ((s := spans.get(x.holder)) and s[0] < k < s[1]) for k, (_, x) in enumerate(lines)]
    small = lambda k: k not in text and not bare[k] and short[k]
    out: set[int] = set()
    for i, (_, x) in enumerate(lines):
        if not link[i]:
            continue
        if x.links > 1:
            out.add(i)
        for j in range(i + 1, min(i + WINDOW, len(lines))):
            if link[j] and lines[j][1].anchor != x.anchor and sum(lengths[i : j + 1]) < DIVE:
                out |= {i, j, *filter(small, range(i + 1, j))}
    if not out:
        return out
    tail = max(out) + 1
    out |= {k - 1 for k in out if k > 0 and bare[k] and small(k - 1)}
    if len(lines) - tail < WINDOW and all(map(small, range(tail, len(lines)))):
        out.update(range(tail, len(lines)))
    return out


def paragraphs(lengths: list[int], marked: set[int]) -> set[int]:
    """The lines outside the marks that stand in a stretch from one long line to another."""
    keep: set[int] = set()
    edges = [-1, *sorted(marked), len(lengths)]
    for before, behind in zip(edges, edges[1:]):
        for a, b in stretches(lengths[before + 1 : behind], SURGE, DIVE):
            long = [k for k in range(before + 1 + a, before + 1 + b) if lengths[k] >= LONG]
            if len(long) > 1:
                keep.update(range(long[0], long[-1] + 1))
    return keep


def chosen(lines: list[tuple[str, Line]]) -> list[str]:
    """The texts of the lines, without menus and, outside an article that holds most of the page, without pieces of boxes."""
    lines = [(t, x) for t, x in lines if x.useful and t]
    own = [own_text(t, x) for t, x in lines]
    lengths = list(map(len, own))
    marked = {k for k, (_, x) in enumerate(lines) if x.article}
    text = marked | surging(lines, lengths)
    if not text:
        return [t for t, _ in lines]
    bare = [x.links > 0 and not any(map(str.isalnum, o)) for (_, x), o in zip(lines, own)]
    short = [n < LONG and not x.content and (b or not closed(t)) for (t, x), n, b in zip(lines, lengths, bare)]
    out = menus(lines, lengths, bare, short, text)
    if 2 * sum(lengths[k] for k in marked) >= sum(lengths) and stretches([n if k in marked else 0 for k, n in enumerate(lengths)], SURGE, DIVE):
        keep = marked | {k for k, (_, x) in enumerate(lines) if x.content} | paragraphs(lengths, marked)
        for k in range(len(lines) - 2, -1, -1):
            if lines[k][1].heading and k + 1 in keep and k + 1 not in out:
                keep.add(k)
        out |= set(range(len(lines))) - keep
    return [t for k, (t, _) in enumerate(lines) if k not in out]


def main_text(page: str | None) -> str:
    """The main text, its lines joined by line ends."""
    return "\n".join(chosen([(" ".join(decoded("".join(x.parts)).split()), x) for x in lines_of(page or "")]))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def make():
        def read(c: dict[str, list]) -> dict[str, list]:
            text = [main_text(h) for h in c["html"]]
            return {"page_id": c["page_id"], "url": c["url"], "text": text, "n_chars": list(map(len, text))}

        return read

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, "page_id long, url string, text string, n_chars long")
