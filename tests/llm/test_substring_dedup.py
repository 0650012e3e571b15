import random
import re

import numpy as np

from marlstone.llm.substring_dedup import longest_matches, parse, part_of, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(rows, window):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i, key=lambda x: (x is None, x))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            f = first[tuple(w[k : k + window])]
            if f is not None and (i is None or f < i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(map(repr, out))


def held(df, rows, window):
    got = [(r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in df.collect()]
    assert sorted(map(repr, got)) == expected(rows, window)


def test_random_copies(docs):
    rng = random.Random(1)
    passages = [[rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [w for _ in range(rng.randint(0, 5)) for w in rng.choice(passages)[rng.randint(0, 4) :]]
        rows.append((i, "\n".join(words) if i % 2 else "  ".join(words)))
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (100, None), (101, ""), (102, "one")]
    table = docs([t for _, t in rows], [i for i, _ in rows])
    held(substring_dedup(table, part_bytes=500), rows, 13)
    held(substring_dedup(table, window=8, anchor=3, part_bytes=700), rows, 8)
    held(substring_dedup(table, part_bytes=500, hot=1), rows, 13)


def test_long_text_and_empty(docs):
    text = " ".join(f"w{i % 700}" for i in range(100_000))
    rows = [(2, text), (1, text[:50_000])]
    held(substring_dedup(docs([t for _, t in rows], [2, 1])), rows, 13)
    assert substring_dedup(docs([])).count() == 0


def test_table(spark, sf001):
    table = spark.read.parquet(f"{sf001}/documents.parquet")
    held(substring_dedup(table), [(r.doc_id, r.text) for r in table.collect()], 13)


def test_factors_name_an_earlier_source(docs):
    rng = random.Random(4)
    base = [f"b{rng.randrange(60)}" for _ in range(400)]
    rows = [(i, " ".join(base[a : a + 60] + [f"u{i}"] + base[b : b + 30])) for i, (a, b) in enumerate((rng.randrange(340), rng.randrange(370)) for _ in range(40))]
    words = {i: t.split() for i, t in rows}
    seen = 0
    for r in substring_dedup(docs([t for _, t in rows]), part_bytes=600).collect():
        covered = set()
        for f in r.factors:
            assert f.length >= 13 and f.source < r.doc_id
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.source][f.word : f.word + f.length]
            covered.update(range(f.start, f.start + f.length))
            seen = max(seen, f.length)
        assert covered == {w for s in r.spans for w in range(s.start, s.stop)}
    assert seen >= 50


def test_longest_matches_and_parse():
    rng = random.Random(5)
    segments = [[rng.randrange(3) for _ in range(rng.randint(4, 7))] for _ in range(60)]
    docs = sorted(rng.randrange(20) for _ in segments)
    sizes = np.array([len(s) for s in segments])
    length, source = longest_matches(np.array([w for s in segments for w in s], np.uint64), sizes, np.array(docs), 4)
    first, flat = np.cumsum(sizes) - sizes, [w for s in segments for w in s]
    begins = set(parse(length, sizes).tolist())
    for s, d, at in zip(segments, docs, first.tolist(), strict=True):
        covered, windows = set(), set()
        for i in range(len(s)):
            own = [n for n in range(4, len(s) - i + 1) if any(o[j : j + n] == s[i : i + n] for o, e in zip(segments, docs, strict=True) if e < d for j in range(len(o)))]
            assert length[at + i] == max(own, default=0)
            if own:
                assert flat[source[at + i] : source[at + i] + length[at + i]] == s[i : i + max(own)]
                windows.update(range(i, i + max(own)))
            if at + i in begins:
                covered.update(range(i, i + int(length[at + i])))
        assert covered == windows


def test_equal_rows_are_dealt(spark):
    from pyspark.sql import functions as F

    table = spark.range(200_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("x").alias("text"))
    sizes = [r["count"] for r in table.groupBy(part_of(64).alias("part")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 4 * 200_000 / 64


def test_equal_rows_keep_their_results(docs):
    rows = [(3, " ".join(f"w{i}" for i in range(40)))] * 700 + [(1, " ".join(f"w{i}" for i in range(10, 30))), (None, " ".join(f"w{i}" for i in range(5, 35)))] * 2
    held(substring_dedup(docs([t for _, t in rows], [i for i, _ in rows]), part_bytes=2000), rows, 13)


def test_texts_are_dealt_once(spark, sf001):
    df = substring_dedup(spark.read.parquet(f"{sf001}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("ReusedExchange") >= 2
