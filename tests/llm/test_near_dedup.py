import random

import numpy as np
import pytest

from marlstone.llm import near_dedup
from marlstone.llm.near_dedup import BANDS, ROWS, bags, components, near_duplicates, overlap, signatures


def expected(rows):
    found = bags([t.encode() if t is not None else None for _, t in rows], 5)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(found[i][0]) and overlap(found[i], found[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    classes = {}
    for n, (i, _) in enumerate(rows):
        classes.setdefault(root(n), []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    return sorted(repr((i, least[root(n)], len(classes[root(n)]))) for n, (i, _) in enumerate(rows))


def held(df, rows):
    assert sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in df.collect()) == expected(rows)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = (np.sort(keys[:200]), rng.integers(1, 9, 200))
    b = (np.sort(keys[100:]), rng.integers(1, 9, 200))
    wide = signatures([a, b], registers=8192)
    assert abs((wide[0] == wide[1]).mean() - overlap(a, b)) < 0.02
    assert (signatures([a, b]) == signatures([a, b])).all() and signatures([a]).shape == (1, BANDS * ROWS)


def test_near_copies(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() + "!")
    texts += [None, "", "...", "two words", "Two, words", "four words are here", texts[0], texts[0]]
    rows = list(enumerate(texts)) + [(3, texts[9]), (3, texts[9]), (None, texts[9]), (None, "alone text of five words")]
    held(near_duplicates(docs([t for _, t in rows], [i for i, _ in rows])), rows)


def test_large_buckets_block_by_block(docs):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):
        copy = list(base)
        for k in range(rng.randint(0, 6)):
            copy[rng.randrange(90)] = f"x{i}{k}"
        rows.append((i, " ".join(copy)))
    held(near_duplicates(docs([t for _, t in rows]), few_rows=1, block_rows=7), rows)


def test_repeats_count(docs):
    rows = [(0, "a b c d e " * 40), (1, "a b c d e " * 38), (2, "a b c d e " * 20), (3, "q " * 100_000), (4, "q " * 99_000)]
    held(near_duplicates(docs([t for _, t in rows])), rows)


def test_empty(docs):
    assert near_duplicates(docs([])).count() == 0


def test_components(spark):
    pairs = [(b"a", b"b"), (b"c", b"b"), (b"d", b"c"), (b"x", b"y"), (b"d", b"d")]
    got = {bytes(r.bag): bytes(r.root) for r in components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert got == {b"b": b"a", b"c": b"a", b"d": b"a", b"y": b"x"}


@pytest.mark.parametrize("one_id", [None, 5])
def test_rows_of_one_id_bring_each_text_once(spark, monkeypatch, one_id):
    """Near copies in 2,000 rows of one doc_id, or without one: as many texts are read again as there are rows, not their square."""
    words = [[f"w{i}_{k}" for k in range(30)] for i in range(1000)]
    texts = [" ".join(w) for w in words] + [" ".join([*w, "end"]) for w in words]
    read = []

    def counted(source, chosen):
        out = spark.createDataFrame(original(source, chosen).collect(), "bag binary, text binary")
        read.append(out.count())
        return out

    original = near_dedup.text_rows
    monkeypatch.setattr(near_dedup, "text_rows", counted)
    table = spark.createDataFrame([(one_id, t) for t in texts], "doc_id bigint, text string").repartition(3)
    got = near_duplicates(table).groupBy("class_size").count().collect()
    assert read and read[0] <= 2000
    assert {r.class_size: r["count"] for r in got} == {2: 2000}
