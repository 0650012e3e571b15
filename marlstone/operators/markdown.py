"""Markdown to chunks: sections by headings, fenced code apart, the title in each chunk (B2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$", re.S)
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", re.S)


def scanned(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """Of each line the number of the fenced block that it belongs to (0: none), its heading level (0: none) and name."""
    fence, block = "", 0
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            yield block, 0, ""
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence, block = m[1], block + 1
            yield block, 0, ""
        else:
            h = _HEADING.match(line)
            yield 0, len(h[1]) if h else 0, (h[2] or "").strip() if h else ""


def chunks_of(text: str | None, split_above: int) -> list[tuple]:
    """(kind, section, first line, last line, text) of each chunk, in the order of first lines."""
    lines = (text or "").split("\n")
    told = list(scanned(lines))
    title = next((name for _, level, name in told if level == 1 and name), "")
    top = 2 if any(level == 2 for _, level, _ in told) else 3
    starts = [0] + [i for i, (_, level, _) in enumerate(told) if level == top and i]
    pieces = []
    for first, last in zip(starts, [*starts[1:], len(lines)], strict=True):
        name = told[first][2] if told[first][1] == top else ""
        cuts = [first]
        if top == 2 and sum(len(lines[i]) + 1 for i in range(first, last) if not told[i][0]) > split_above:
            cuts += [i for i in range(first + 1, last) if told[i][1] == 3]
        for a, b in zip(cuts, [*cuts[1:], last], strict=True):
            pieces.append((a, b, [title, name, told[a][2] if a != first else ""]))
    out = []
    for first, last, names in pieces:
        section = " > ".join(n for n in names if n)
        groups: dict[int, list[int]] = {}
        for i in range(first, last):
            groups.setdefault(told[i][0], []).append(i)
        for block, own in groups.items():
            body = "\n".join(lines[i] for i in own)
            if block or body.strip():
                headed = not title or any(told[i][1] == 1 and told[i][2] == title for i in own)
                out.append(("code" if block else "doc", section, own[0], own[-1], body if headed else f"# {title}\n\n{body}"))
    return sorted(out, key=lambda c: (c[2], c[0]))


def markdown_chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", split_above: int = 2000) -> DataFrame:
    """Chunks of each Markdown text: key, chunk (from 0), kind, section, first_line, last_line, text.

    Sections begin at ``##`` headings if the text has any, else at ``###``; what
    stands before the first is one too. A section of more than ``split_above``
    characters of prose is cut again at its ``###`` headings. A fenced block is a chunk of
    its own (kind code), the rest of the section one of kind doc, unless it is
    blank. In fences, also unclosed ones, no line is a heading, and only a fence
    of the same sign, at least as long and without a name, ends one. The first H1
    stands above every chunk that does not hold it, and leads the breadcrumb
    ``Title > Section > Subsection``. Null and blank texts have no chunks. Lines
    count from 0. Each text is cut where it lies; nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, *c) for k, t in zip(pdf["key"], pdf["text"], strict=True) for n, c in enumerate(chunks_of(t, split_above))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "kind", "section", "first_line", "last_line", "text"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, chunk bigint, kind string, section string, first_line bigint, last_line bigint, text string")
