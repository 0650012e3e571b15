"""Markdown chunks against a plain reading, character by character where it matters."""

import random

from marlstone.operators.markdown import markdown_chunks


def fence_of(line):
    rest = line.lstrip(" ")
    if len(line) - len(rest) > 3 or rest[:1] not in ("`", "~"):
        return None
    n = len(rest) - len(rest.lstrip(rest[0]))
    return (rest[0], n, rest[n:]) if n >= 3 else None


def heading_of(line):
    rest = line.lstrip(" ")
    n = len(rest) - len(rest.lstrip("#"))
    if len(line) - len(rest) > 3 or not 1 <= n <= 6 or rest[n:] and rest[n] not in " \t":
        return 0, ""
    name = rest[n:].strip(" \t")
    bare = name.rstrip("#")
    if bare != name and (not bare or bare[-1] in " \t"):
        name = bare.strip(" \t")
    return n, name


def brute(text, split_above):
    if text is None:
        return []
    lines = text.split("\n")
    code, heads, open_, n = [], [], None, 0
    for line in lines:
        f = fence_of(line)
        if open_ is None and f and not (f[0] == "`" and "`" in f[2]):
            open_, n = f, n + 1
            code.append(n), heads.append((0, ""))
        elif open_ is not None:
            code.append(n), heads.append((0, ""))
            if f and f[0] == open_[0] and f[1] >= open_[1] and not f[2].strip():
                open_ = None
        else:
            code.append(0), heads.append(heading_of(line))
    titles = [name for level, name in heads if level == 1 and name]
    title = titles[0] if titles else ""
    top = 2 if (2 in [level for level, _ in heads]) else 3
    # Each line's section and subsection: the line that begins it.
    section, sections = 0, []
    for i, (level, _) in enumerate(heads):
        section = i if level == top else section
        sections.append(section)
    prose = {s: sum(len(lines[i]) + 1 for i in range(len(lines)) if sections[i] == s and not code[i]) for s in sections}
    sub, subs = 0, []
    for i, (level, _) in enumerate(heads):
        if i and sections[i] != sections[i - 1] or i == 0:
            sub = i
        elif top == 2 and level == 3 and prose[sections[i]] > split_above:
            sub = i
        subs.append(sub)
    out = []
    for key in dict.fromkeys(zip(sections, subs, code, strict=True)):
        s, b, c = key
        own = [i for i in range(len(lines)) if (sections[i], subs[i], code[i]) == key]
        body = "\n".join(lines[i] for i in own)
        if not c and not body.strip():
            continue
        crumbs = [title, heads[s][1] if heads[s][0] == top else "", heads[b][1] if b != s else ""]
        has = any(heads[i][0] == 1 and heads[i][1] == title for i in own)
        out.append((own[0], "code" if c else "doc", " > ".join(x for x in crumbs if x), own[-1], body if has or not title else f"# {title}\n\n{body}"))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(12)
    pool = ["# Title", "# Other #", "## One", "## Two ##", "### Sub", "###", "#### Deep", "####### no", "#no", "    # no", "  ## Three", "```", "```py", "````", "~~~", "~~~~ x", "``` a`b", "text " * 9, "short", "", "  ", "a # b", "\t## no"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(300)] + [None, "", "\n\n", "# T", "```\n# no\n## no", "### a\nx\n### b", "## " + "x" * 5000 + "\n### y\nz"]
    table = spark.createDataFrame([(i, t, "k", 9) for i, t in enumerate(texts)], "doc_id bigint, text string, kind string, chunk int").repartition(3)
    for split_above in (60, 2000):
        got = {}
        for r in markdown_chunks(table, split_above=split_above).orderBy("doc_id", "chunk").collect():
            own = got.setdefault(r.doc_id, [])
            assert r.chunk == len(own)
            own.append((r.first_line, r.kind, r.section, r.last_line, r.text))
        assert got == {i: sorted(b, key=lambda c: (c[0], c[1])) for i, t in enumerate(texts) if (b := brute(t, split_above))}


def test_one_document(spark):
    text = "# Guide\nintro\n## Install\nsteps\n```sh\n## not a heading\n```\nmore\n## Use\nrun"
    rows = markdown_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk").collect()
    assert [(r.kind, r.section, r.first_line, r.last_line) for r in rows] == [("doc", "Guide", 0, 1), ("doc", "Guide > Install", 2, 7), ("code", "Guide > Install", 4, 6), ("doc", "Guide > Use", 8, 9)]
    assert rows[1].text == "# Guide\n\n## Install\nsteps\nmore" and rows[2].text == "# Guide\n\n```sh\n## not a heading\n```"
