"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element, in page order. Lines of
structural boilerplate (menus, headers and footers of the page, sidebars,
notices, adverts, forms, reader comments) weigh nothing. Over windows of
neighbouring lines the text lengths are summed; the sum surges where the article
begins and dives where it ends, and all lines in between are kept, short ones
too. Lines count without their link text and a surge needs ``SURGE`` characters. A
run of lines that weigh nothing is no dive if the text before and after it stands
in one element; lines next to a span that stand in its element belong to it; and
every surge is kept unless it stands elsewhere than the heaviest and is mostly
links. A page marks its article (<article> or <main>) if a span outside has no
more than ``TAG_WEIGHT`` times the text of the largest mark; then lines outside
weigh nothing, lines inside weigh all their text, and the marks are one element:
all they hold but boilerplate is kept.

A class or id names boilerplate if it ends in a word for it, numbers and words for
boxes aside ("ad-slot-2", not "comments-open"). Names decide nothing on a page
that would have no article otherwise.

Defined cases: null or empty html gives an empty text; markup that is cut off or
never closed is read as far as it goes; a page without any surge gives its
heaviest short text; repeated rows are each extracted; other columns do not
matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table
from .words import map_arrow

WINDOW = 3
SURGE = 80
#: A character in the largest <article> or <main> counts as so many outside.
TAG_WEIGHT = 3

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
}
BOILERPLATE = {"nav", "footer", "aside", "form", "svg", "canvas", "object", "select", "button", "menu", "dialog", "head", "audio", "video", "math", "fieldset"}
MARKED = {"article", "main"}
#: The number of the element that a page's marks make up.
ARTICLE = -1
#: A start of one of these ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Words that a class or an id ends in if it names boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos promotion promotions "
    "sidebar sidebars widget widgets navbar navigation nav navs menu menus breadcrumb breadcrumbs footer topbar cookie cookies consent gdpr notice notices "
    "alert alerts popup popups modal modals overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies "
    "share sharing social related recommend recommended recommendation recommendations pagination pager toolbar search searchform copyright disclaimer legal "
    "skip tag tags metadata".split())
#: Words for boxes, which may follow.
BOXES = frozenset(
    "area bar block box body bottom btn button buttons col column container content count author field form footer group header headline icon icons inner input "
    "item items label left link links list message meta outer panel posts right row section slot text this title top unit widget wrap wrapper wrapping zone cloud".split())
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Elements that divide a page; others only shape the text inside.
HOLDERS = {"div", "article", "main", "td", "center"}
#: Inside an article a header holds its title.
PAGE_HEADER = re.compile(r"(?:^|[_-])(?:header|masthead)(?:$|[_-]|\d)", re.I)
#: Wrappers that say what else is on the page.
ABOUT_LAYOUT = re.compile(r"(?:has|with|without|no|is)[_-]", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    text: str
    linked: int
    boiler: bool
    marked: bool
    holders: frozenset[int]
    mark: int


def _attributes(inside: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(inside)}


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id does: its last word that is not for a box."""
    for part in reversed(PARTS.findall(name)):
        if part.lower() in NAMES:
            return True
        if part.lower() not in BOXES:
            return False
    return False


def _is_boilerplate(name: str, inside: str, in_marked: bool, by_names: bool = True) -> bool:
    if name in BOILERPLATE or name == "header" and not in_marked:
        return True
    if not inside.strip() or name in ("html", "body"):
        return False
    a = _attributes(inside)
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")) or a.get("role", "").lower() in ROLES:
        return True
    if not by_names:
        return False
    if name in MARKED and not re.search(r"comment|teaser|related|promo|\bads?\b|sponsor", a.get("class", "") + " " + a.get("id", ""), re.I):
        return False
    names = [n for k in ("class", "id") for n in a.get(k, "").split() if not ABOUT_LAYOUT.match(n)]
    return any(_names_boilerplate(n) or not in_marked and PAGE_HEADER.search(n) for n in names)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("open", name, attributes) and ("close", name, "") in page order."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG_NAME.match(html, lt + 1)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = TAG_END.match(html, m.end())
        stop = end.end() if end else html.find(">", m.end()) + 1 or n
        name, inside = m[0].lower(), html[m.end() : stop - 1]
        at = stop
        if name[0] == "/":
            yield "close", name[1:], ""
        elif name in RAW:
            close = re.compile(rf"</{name}\s*[^>]*>?", re.I).search(html, stop)
            at = close.end() if close else n
            yield "raw", name, ""
        else:
            yield "open", name, inside


def lines_of(html: str, by_names: bool = True) -> list[Line]:
    """The page's blocks, each with what it stands in."""
    # name, boilerplate, marked, and the numbers of the nearest holder, the one around it and the outermost mark
    stack: list[tuple[str, bool, bool, int, int, int]] = [("", False, False, 0, 0, 0)]
    lines: list[Line] = []
    held: list[str] = []
    linked = links = opened = 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                name, boiler, marked, holder, outer, mark = stack[-1]
                # a text that stands in its holder itself may be one block of the holder around
                lines.append(Line(text, linked, boiler, marked, frozenset((holder, outer) if name in HOLDERS else (holder,)), mark))
        held, linked = [], 0

    for kind, name, inside in tokens(html):
        if kind == "text":
            held.append(name)
            if links:
                linked += len(name)
        elif kind == "open":
            if name in INLINE:
                hide = inside and _is_boilerplate(name, inside, stack[-1][2], by_names)
                if hide and name not in VOID:
                    flush()
                    stack.append((name, True, *stack[-1][2:]))
                links += name == "a"
                continue
            if name == "br":
                held.append(" ")
                continue
            flush()
            if name in VOID:
                continue
            if name in ENDS_P and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
                stack.pop()
            _, boiler, marked, holder, outer, mark = stack[-1]
            if name in MARKED and boiler and not any(x[2] for x in stack):
                boiler = False  # a menu or header that was never closed
            own = _is_boilerplate(name, inside, marked, by_names)
            if name in HOLDERS:
                opened += 1
                holder, outer = opened, holder
            if name in MARKED and not own and not marked:
                mark = opened
            stack.append((name, boiler or own, marked or name in MARKED and not own, holder, outer, mark))
        elif kind == "close":
            links -= name == "a" and links > 0
            if name in INLINE and not (stack[-1][0] == name):
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in MARKED and name in ("p", "li", "b", "span"):
                    break
        elif name == "title":
            flush()
    flush()
    return lines


def line_blocks(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans [first, stop) of lines from a surge of the window sums to their dive.

    A surge is a line of text whose window, from it on, sums to ``surge`` or
    more; the span goes on until a whole window sums to nothing, or ends.
    """
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    spans, at = [], 0
    while at < n:
        if not lengths[at] or sums[at] < surge:
            at += 1
            continue
        stop = at
        while stop < n and sums[stop]:
            stop += 1
        while not lengths[stop - 1]:
            stop -= 1
        spans.append((at, stop))
        at = stop
    return spans


def bridged(lines: list[Line], lengths: list[int]) -> list[int]:
    """The places of the lines without the gaps inside one holder.

    A gap is a run of lines that weigh nothing. Where the text before and the
    text after it stand in one holder, it is an insertion and no dive.
    """
    out: list[int] = []
    gap: list[int] = []
    for i, n in enumerate(lengths):
        if not n:
            gap.append(i)
            continue
        if not (out and lengths[out[-1]] and lines[out[-1]].holders & lines[i].holders):
            out += gap
        gap = []
        out.append(i)
    return out + gap


def widened(lines: list[Line], at: list[int], weights: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of places with the lines of text next to them that stand in their element."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a > (out[-1][1] if out else 0) and weights[a - 1] and lines[at[a - 1]].holders & lines[at[a]].holders:
            a -= 1
        while b < len(at) and weights[b] and lines[at[b]].holders & lines[at[b - 1]].holders:
            b += 1
        out.append((a, b))
    return out


def article_spans(lines: list[Line], lengths: list[int], surge: int = SURGE) -> list[tuple[int, int]]:
    """Spans of lines [first, stop) that are the page's article."""
    at = bridged(lines, lengths)
    weights = [lengths[i] for i in at]
    spans = line_blocks(weights, surge)
    short = not spans
    if short and surge > 1:  # no surge: the whole article is short
        spans = line_blocks(weights, 1)
    if not spans:
        return []
    found = [(at[a], at[b - 1] + 1) for a, b in widened(lines, at, weights, spans)]
    first, stop = max(found, key=lambda s: sum(lengths[s[0] : s[1]]))
    holders = frozenset().union(*(x.holders for x in lines[first:stop]))

    def other(a: int, b: int) -> bool:
        """Whether a span is not the article: it stands elsewhere, and is mostly links or the only text is short."""
        own = [x for x in lines[a:b] if not x.boiler]
        if (a, b) == (first, stop) or any(x.holders & holders for x in own):
            return False
        return short or 2 * sum(x.linked for x in own) > sum(len(x.text) for x in own)

    return [s for s in found if not other(*s)]


def declares_article(lines: list[Line], lengths: list[int]) -> bool:
    """Whether the page's marks hold its article, and not teasers beside it.

    The largest marked element is weighed against the heaviest span outside.
    """
    marks: dict[int, int] = {}
    for x in lines:
        if x.marked and not x.boiler:
            marks[x.mark] = marks.get(x.mark, 0) + len(x.text)
    if not marks:
        return False
    outside = [0 if x.marked else n for x, n in zip(lines, lengths)]
    at = bridged(lines, outside)
    spans = line_blocks([outside[i] for i in at], SURGE)
    heaviest = max((sum(outside[i] for i in at[a:b]) for a, b in spans), default=0)
    return TAG_WEIGHT * max(marks.values()) >= heaviest


def main_text(html: str | None) -> str:
    lines = lines_of(html or "")
    text = article_of(lines)
    if not text and any(x.boiler for x in lines):  # is all of it boilerplate by its name only?
        lines = lines_of(html or "", by_names=False)
        if line_blocks(_plain_lengths(lines), SURGE):
            text = article_of(lines)
    return text


def _plain_lengths(lines: list[Line]) -> list[int]:
    return [max(0, len(x.text) - 2 * x.linked) if not x.boiler else 0 for x in lines]


def article_of(lines: list[Line]) -> str:
    lengths = _plain_lengths(lines)
    declared = declares_article(lines, lengths)
    if declared:  # what is inside the marks stands in one element; nothing else weighs
        lengths = [len(x.text) if x.marked and not x.boiler else 0 for x in lines]
        for x in lines:
            x.holders = frozenset((ARTICLE,)) if x.marked else frozenset()
    return " ".join(x.text for a, b in article_spans(lines, lengths) for x in lines[a:b] if not x.boiler and (x.marked or not declared))


def visible_text(html: str | None) -> str:
    """All blocks of a page, one a line; scripts, styles and comments are gone."""
    return "\n".join(x.text for x in lines_of(html or ""))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def rows(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            text = main_text(r["html"])
            yield {"page_id": r["page_id"], "url": r["url"], "text": text, "n_chars": len(text)}

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(narrow, rows, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
