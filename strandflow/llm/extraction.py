"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block element; boilerplate elements
(menus, forms, notices, ...) leave no line, so that they end nothing. A line weighs
as much as its text is long. Lines outside articles weigh nothing on a page that
has an article (or main) element, nor do lines of containers (the nearest div,
section, table cell, ..., or the page) whose text is for the larger part in links.
A weightless line takes a place for each of its links, one at least. WINDOW empty
places stand where articles begin or end, and between two lines if neither one's
container holds the other's (cells, quotes and figures pass for what is around them).

The weights are summed over windows of WINDOW places that slide by one. A surge is
where the sum rises from nothing, a dive where it falls back to nothing. The text
from the first line that weighs after the surge to the dive is kept, on every page:
the sums bridge fewer than WINDOW links within a text (a linked cell, caption, quote)
and fall to nothing over a menu. Inside articles every line weighs, so that there a
dive only comes with the article's end.

A boilerplate element ends at its own end tag, with its parent's or, where HTML
lets it be left out (p, li, td, ...), at the next sibling; one that is never closed
ends with the page. Outside articles, an element that holds an article or main
element is not boilerplate, unless it is a nav, menu, footer, aside, ... by its tag.

Null html counts as empty; a page without text gives ''. Repeated rows are each
extracted. An empty table gives an empty result. A page of any length is read
whole, and nothing inside the kept lines is dropped or cut. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import in_parts, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WHOLE = re.compile(r"<(?:article|main)\b", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "desc"}
WINDOW = 3
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOILER = set("nav menu footer aside form button select dialog head".split()) | _RAW
#: Elements whose lines are judged together.
_CONTAINERS = set("article aside blockquote body center details div fieldset figure footer form header main nav section table td th".split())
#: Containers that stand within a text.
_SOFT = set("blockquote details figure table td th".split())
#: Start tags that end an open element whose end tag may be left out.
_ENDS_P = _BLOCK - set("body caption dd dt head html legend li option summary tbody td tfoot th thead tr".split())
_SIBLINGS = {"p": _ENDS_P, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "li": {"li"}}
_SIBLINGS |= dict.fromkeys(("dt", "dd"), {"dt", "dd"}) | dict.fromkeys(("td", "th"), {"td", "th", "tr", "tbody", "tfoot", "thead"}) | dict.fromkeys(("tbody", "tfoot", "thead"), {"tbody", "tfoot", "thead"})
#: Elements that such a start tag does not look past.
_SCOPES = (_CONTAINERS - {"div"}) | set("ul ol menu dl select button caption".split())
#: Elements that are boilerplate with the articles (teasers) in them.
_ASIDE = set("nav menu footer aside button select dialog head".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that name boilerplate.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:igation|bar)?|menu|breadcrumbs?|sidebar|side-?bar|aside|complementary|contentinfo"
    r"|footer|cookies?|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|respond|replies|disqus|share|sharing|social|related|recommended"
    r"|toolbar|pagination|pager|skip-?link|copyright|search|masthead|site-header|page-header|topbar)(?:$|[\s_-])",
    re.I,
)


def _named_boilerplate(attributes: str) -> bool:
    return any(_NAMES.search(value.strip("\"'")) for _, value in _ATTRIBUTE.findall(attributes))


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    links: int
    inside: bool  # an article
    container: int
    joined: bool  # its container holds the one of the line before, or the other way round


def lines_of(page: str) -> list[Line]:
    """The lines outside boilerplate."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = links = link = article = at = made = 0
    containers = [("", 0)]
    depths = [0]  # of each container made: where it stands or, within a text, the one around it
    depth, lowest = -1, 0  # of the line before; fewest containers open since then
    open_elements: list[str] = []  # of a skipped element, itself first
    wholes = _wholes(page)

    def end() -> None:
        nonlocal linked, links, link, depth, lowest
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            before, depth = depth, depths[containers[-1][1]]
            lines.append(Line(text, linked, links, article > 0, containers[-1][1], lowest > min(before, depth)))
            lowest = len(containers)
        parts.clear()
        linked = links = 0
        link = min(link, 1)

    def feed(piece: str) -> None:
        nonlocal linked, links, link
        if piece and not open_elements:
            parts.append(piece)
            if link and piece.strip():
                linked += len(piece.strip())
                links += link == 1
                link = 2  # counted in this line

    raw = ""
    for m in _TOKEN.finditer(page):
        if raw:  # inside a raw element only its end tag counts
            if m[1] and m[2].lower() == raw:
                raw, at = "", m.end()
            continue
        feed(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        close, name = bool(m[1]), m[2].lower()
        empty = name in _VOID or m[3].endswith("/")
        if name in _RAW and not close and not empty:
            raw = name
            continue
        if open_elements and _inside(open_elements, name, close, empty, containers):
            continue
        if name == "a":
            link = 0 if close else 1
        if name == "br":
            parts.append(" ")
        if name in _BLOCK:
            end()
        if name in _CONTAINERS and not empty:
            if not close:
                made += 1
                depths.append(depths[containers[-1][1]] if name in _SOFT else len(containers))
                containers.append((name, made))
            elif any(n == name for n, _ in containers):
                while containers.pop()[0] != name:
                    pass
                lowest = min(lowest, len(containers))
        if name in ("article", "main"):
            article = max(0, article - 1) if close else article + 1
            continue
        outside_header = name == "header" and not article
        if not close and not empty and name not in ("html", "body") and (name in _BOILER or outside_header or _named_boilerplate(m[3])):
            outer = containers[:-1] if name in _CONTAINERS else containers
            if name not in _ASIDE and not article and _holds(page, m.end(), name, wholes, outer):
                continue
            end()
            containers = list(outer)
            lowest = min(lowest, len(containers))
            open_elements.append(name)
    if not raw:
        feed(page[at:].split("<")[0] if re.match(r"[^<]*<[a-zA-Z/!][^>]*$", page[at:]) else page[at:])
    end()
    return lines


def _inside(stack: list[str], name: str, close: bool, empty: bool, outer: list[tuple[str, int]]) -> bool:
    """Moves the stack of a skipped element past a tag; false if the element ended before it, with a parent or at a sibling."""
    if close:
        if name in stack:
            while stack.pop() != name:
                pass
        elif name in _BLOCK and (any(n == name for n, _ in outer) or all(x in _SIBLINGS or x not in _BLOCK for x in stack)):
            stack.clear()
            return False
        return True
    k = len(stack) - 1
    while k >= 0:
        if name in _SIBLINGS.get(stack[k], ()):
            del stack[k:]
        elif stack[k] in _SCOPES:
            break
        k -= 1
    if not stack:
        return False
    if not empty:
        stack.append(name)
    return True


def _wholes(page: str) -> list[int]:
    """Where article and main elements start."""
    found, raw = [], ""
    for m in _TOKEN.finditer(page) if _WHOLE.search(page) else ():
        name = (m[2] or "").lower()
        if raw:
            raw = "" if m[1] and name == raw else raw
        elif name in ("article", "main") and not m[1]:
            found.append(m.start())
        elif name in _RAW and not m[1] and not m[3].endswith("/"):
            raw = name
    return found


def _holds(page: str, at: int, name: str, wholes: list[int], outer: list[tuple[str, int]]) -> bool:
    """Whether the element whose start tag ends here still is open where the next article or main element starts."""
    k = bisect.bisect_left(wholes, at)
    if k == len(wholes):
        return False
    stack, raw = [name], ""
    for m in _TOKEN.finditer(page, at, wholes[k]):
        tag, empty = (m[2] or "").lower(), (m[2] or "").lower() in _VOID or (m[3] or "").endswith("/")
        if raw:
            raw = "" if m[1] and tag == raw else raw
        elif tag in _RAW and not m[1] and not empty:
            raw = tag
        elif tag and (not _inside(stack, tag, bool(m[1]), empty, outer) or not stack):
            return False
    return _inside(stack, "article", False, False, outer)


def weights_of(lines: list[Line]) -> list[int]:
    if any(x.inside for x in lines):
        return [len(x.text) if x.inside else 0 for x in lines]
    sizes, linked = Counter(), Counter()
    for x in lines:
        sizes[x.container] += len(x.text)
        linked[x.container] += x.linked
    return [len(x.text) if 2 * linked[x.container] <= sizes[x.container] else 0 for x in lines]


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) of the sums over WINDOW lines: where they rise from nothing and fall back to it."""
    out, total, start = [], sum(weights[: WINDOW - 1]), None
    for i in range(len(weights)):  # total: of the window that starts here
        total += weights[i + WINDOW - 1] if i + WINDOW - 1 < len(weights) else 0
        if total and start is None:
            start = i
        elif not total and start is not None:
            out.append((start, i))
            start = None
        total -= weights[i]
    return out if start is None else [*out, (start, len(weights))]


def main_text(page: str | None) -> str:
    """Windows, surges and dives over the page's lines."""
    lines = lines_of(page or "")
    weights: list[int] = []
    texts: list[str] = []
    before = False
    for line, weight in zip(lines, weights_of(lines), strict=True):
        empty = 0 if line.joined and line.inside == before else WINDOW
        more = 0 if weight else max(0, line.links - 1)
        weights += [0] * empty + [weight] + [0] * more
        texts += [""] * empty + [line.text] + [""] * more
        before = line.inside
    kept: list[str] = []
    for surge, dive in regions(weights):
        first = next(i for i in range(surge, dive) if weights[i])
        kept += filter(None, texts[first:dive])
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in in_parts(batch, ["html"], 1000, 4 << 20):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.record_batch(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
