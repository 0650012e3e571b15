"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches

#: Elements whose content is never text of the page (fixed values): those whose content is not markup, and those that hold elements.
RAW = "script style iframe noscript textarea title head".split()
HIDDEN = "template svg object canvas audio video".split()
#: Elements beside the article (fixed values).
BESIDE = "nav header footer aside form menu dialog button select".split()
#: Elements that start and end a block (fixed values).
BLOCK = set(
    "address article aside blockquote body br-not caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
) - {"br-not"}
#: Elements without an end (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that name something beside the article; in an article all words of a name must be among them.
NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination pager popup promo promoted promotion related replies respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Roles that do so (fixed values).
ROLES = set("navigation banner contentinfo complementary search dialog alert".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)",
    re.S,
)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for n in RAW}
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[a-z]+")


def _beside(name: str, rest: str, inside: bool) -> bool:
    if name in BESIDE or name in HIDDEN or name in RAW:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id"):
            names = [set(_WORD.findall(x)) for x in value.split()]
            if any(x and x <= NAMES if inside else x & NAMES for x in names):
                return True
    return False


class Line:
    """One block: its text and the number of the outermost article that holds it (0: none); ``own`` counts its characters outside links."""

    __slots__ = ("inside", "own", "text")

    def __init__(self, text: str, own: int, inside: int):
        self.text, self.own, self.inside = text, own, inside


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, without what lies beside an article."""
    out: list[Line] = []
    text: list[str] = []
    linked = articles = numbered = beside = links = at = 0
    stack: list[tuple[str, bool]] = []

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not beside:
            text.append(raw)
            if links:
                linked += len(html.unescape(raw).strip())

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Line(joined, max(0, len(joined) - linked), numbered if articles else 0))
            text.clear()
        linked = 0

    def leave(name: str) -> None:
        nonlocal articles, beside, links
        if not any(n == name for n, _ in stack):
            return
        while stack:
            n, side = stack.pop()
            beside -= side
            articles -= n in ("article", "main")
            links -= n == "a"
            if n == name:
                return

    while True:
        m = _TOKEN.search(page, at)
        put(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m["data"] is not None:
            put(html.escape(m["data"]))
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in BLOCK:
                flush()
            if name == "a" and links or name != "a":
                leave(name)
            continue
        if name == "br":
            put(" ")
            continue
        if name in BLOCK:
            flush()
        if name in _RAW:
            if closed := _RAW[name].search(page, at):
                at = closed.end()
                continue
            if name in ("script", "style"):
                break
            # What is never closed must not swallow the page: a head or title is no element then, others end with the element around them.
            if name in ("head", "title"):
                continue
        if name in VOID or m["rest"].endswith("/") and name not in BLOCK:
            continue
        if name == "a" and links:
            leave("a")
        heads = name == "h1" and articles and stack and stack[-1][0] == "header" and beside == 1
        side = not heads and _beside(name, m["rest"], articles > 0)
        if heads:
            beside -= 1
            stack[-1] = ("header", False)
        stack.append((name, side))
        beside += side
        if name in ("article", "main"):
            numbered += not articles
            articles += 1
        links += name == "a"
    flush()
    return out


def main_text(page: str | None, *, window: int = 3, surge: int = 80) -> str:
    """Text between the points where line lengths surge and dive.

    ``own`` lengths are summed over ``window`` lines from each line on. A region
    begins at the first line with text of its own whose sum reaches ``surge``
    and ends where a whole window holds no text of its own; all regions stay.
    Article elements weigh nothing: one whose text surges brings its other
    lines, one that does not is no region. If nothing surges, the lines of
    articles stay, or those with text of their own if there are none.
    """
    lines = lines_of(page or "")
    if not lines:
        return ""
    own = np.array([x.own for x in lines])
    sums = np.convolve(np.r_[own, np.zeros(window - 1, int)], np.ones(window, int), "valid")
    regions, begin = [], None
    for i in range(len(lines)):
        if begin is None and own[i] and sums[i] >= surge:
            begin = i
        elif begin is not None and not sums[i]:
            regions.append((begin, i))
            begin = None
    if begin is not None:
        regions.append((begin, len(lines)))
    kept = set()
    for s, e in regions:
        while not own[e - 1]:
            e -= 1
        kept.update(range(s, e))
    inside = np.array([x.inside for x in lines])
    # Of an article that a region only runs into, no line surges.
    surging = set(inside[[i for i in kept if own[i] and own[i : i + window][inside[i : i + window] == inside[i]].sum() >= surge]].tolist()) - {0}
    kept.update(i for i, x in enumerate(lines) if x.inside in surging or not regions and (x.inside if inside.any() else x.own))
    return "\n".join(lines[i].text for i in sorted(kept))


def _extracted(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of each page: page_id, url, text.

    ``pages`` has page_id, url and html; other columns are ignored. Whole pages
    are read, one row at a time, with no shuffle. A null or empty page, or one
    without text, gives an empty string. Blocks are joined by one line feed in
    page order; white space in a block (line breaks too) becomes one space and
    character references are decoded. Repeated rows each give a row.
    """
    small_batches(pages.sparkSession)
    source = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(_extracted, f"page_id {kind}, url string, text string")
