"""Collapse of near-duplicate candidates against all pairs."""

import random
import re
from collections import defaultdict

from marlstone.operators.collapse import collapsed

SCHEMA = "qid int, id bigint, file string, first bigint, last bigint, symbol string, text string, source string, rank bigint"


def runs(text, size=5):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def one(a, b):
    if a[5] is not None and a[5] == b[5]:
        return True
    if a[2] is not None and a[2] == b[2] and None not in (a[3], b[3], a[4], b[4]) and a[3] <= a[4] and b[3] <= b[4] and a[3] <= b[4] and b[3] <= a[4]:
        return True
    x, y = runs(a[6]), runs(b[6])
    return bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def brute(rows):
    out = []
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for qid, own in by.items():
        left = list(own)
        while left:
            group, front = [], [left.pop()]
            while front:
                r = front.pop()
                group.append(r)
                more = [x for x in left if one(r, x)]
                left = [x for x in left if x not in more]
                front += more
            rank, best = min((r[8], r[1]) for r in group)
            out.append((qid, best, rank, tuple(sorted({r[7] for r in group})), len(group)))
    return sorted(out)


def found(spark, rows):
    got = collapsed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted((r.qid, r.id, r.rank, tuple(r.sources), r.n) for r in got)


def test_against_all_pairs(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(12)]

    def text():
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 20])):
            words[rng.randrange(60)] = "changed"
        return rng.choice([" ".join(words), " ".join(words).upper() + "!", None, "", "...", "two words", f"own text {rng.random()}"])

    rows = []
    for i in range(220):
        first = rng.choice([None, rng.randrange(400)])
        rows.append((i % 3, i, rng.choice([None, "a.py", "b.py"]), first, None if first is None else first + rng.choice([-1, 0, 3, 12]), rng.choice([None] * 12 + ["f", "g"]), text(), rng.choice(["vector", "lexical", "graph"]), rng.randrange(50)))
    assert found(spark, rows) == brute(rows)


def test_chains_and_hot_groups(spark):
    chain = [(1, i, "a", 10 * i, 10 * i + 10, None, f"t{i} x{i}", f"s{i % 3}", 30 - i) for i in range(20)]
    apart = [(2, 100 + i, "a", 20 * i, 20 * i + 10, None, f"u{i} y{i}", "s", i) for i in range(5)]
    hot = [(3, 1000 + i, "b", 5, 9, None, f"v{i}", "s", i) for i in range(400)]
    rows = chain + apart + hot
    assert found(spark, rows) == brute(rows)
    assert sorted(n for *_, n in found(spark, rows)) == [1] * 5 + [20, 400]


def test_no_rows(spark):
    assert collapsed(spark.createDataFrame([], SCHEMA)).count() == 0
