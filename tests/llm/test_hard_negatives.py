import math
import random

import numpy as np
import pytest

from marlstone.llm.hard_negatives import HIGH, LOW, Best, Tree, exact, hard_negatives, interval, scaled, search


def expected(rows, scale=256):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for a, label, v in kept:
        if a % 50 == 0:
            s = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in kept if len(w) == len(v)]
            for p, i, _ in sorted(x for x in s if x[2] == label and x[1] != a)[:5]:
                near = sorted(x for x in s if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
                out += [(a, i, rank, n, -p, -t) for rank, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def found(df, **sizes):
    return sorted(tuple(r) for r in hard_negatives(scaled(df), **sizes).collect())


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id bigint, embedding array<double>, label int, row int, score double").repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 20, "block_rows": 25, "anchor_rows": 3, "sampled": 60}])
def test_against_brute_force(spark, sizes):
    rng = random.Random(2)
    middle = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in middle[i % 7]], rng.choice([i % 7, i % 3, -1])) for i in range(400)]
    hot = rows[0][1]
    # A third of all rows are one vector; ties, other lengths, repeated ids and rows, nulls and odd numbers.
    rows += [(1000 + i, hot, i % 4) for i in range(200)] + [(2000 + i, [rng.random() for _ in range(3)], i % 2) for i in range(60)]
    rows += [(50, hot, 1), (50, hot, 1), (50, middle[1], 2), (100, middle[2], 2), (7, hot, 1), (7, hot, 1)]
    rows += [(3000, [], 1), (3001, [], 2), (3050, [], 1), (3100, [0.0] * 6, 1), (3150, [-x for x in hot], 5)]
    rows += [(None, hot, 1), (4000, None, 1), (4050, hot, None), (4100, [math.nan] * 6, 1), (4150, [math.inf] * 6, 1), (4200, [None] + hot[1:], 1)]
    assert found(make(spark, rows), **sizes) == expected(rows)


def test_empty_and_small(spark):
    assert found(make(spark, [(1, [1.0], 1)]).where("false")) == []
    assert found(make(spark, [(50, [1.0], 1)])) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2), (4, [0.96, 0.0], 3), (5, [0.5, 9.0], 3)]
    assert found(make(spark, rows)) == expected(rows)


def test_long_numbers_are_exact():
    a = np.array([[2.0**40, -(2.0**41) + 1, 3.0]])
    b = np.array([[2.0**21 + 1, 5.0, 2.0**52], [2.0**60, 0.0, 0.0]])
    whole = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert exact(a, b).tolist() == [[min(HIGH, max(LOW, x)) for x in r] for r in whole]


def test_intervals_hold_and_groups_are_dropped():
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 100, (8, 16))
    a, c = (np.floor(middle[rng.integers(0, 8, n)] + rng.normal(0, 5, (n, 16))) for n in (300, 3000))
    tree_a, tree_c = Tree(a, 16), Tree(c, 32)
    for p in range(len(tree_a.first)):
        for q in range(0, len(tree_c.first), 5):
            s = a[tree_a.order[tree_a.first[p] : tree_a.last[p]]] @ c[tree_c.order[tree_c.first[q] : tree_c.last[q]]].T
            least, most = interval(tree_a.centre[p], tree_a.norm[p], tree_a.radius[p], tree_c.centre[q], tree_c.norm[q], tree_c.radius[q])
            assert least <= s.min() and s.max() <= most
    scored = []

    def skip(x, y):
        scored.append(len(x) * len(y))
        return np.zeros((len(x), len(y)), bool)

    best = Best(np.full((300, 1), LOW), np.full((300, 1), HIGH), np.full((300, 1), LOW), 3)
    search(a, c, np.arange(3000), best, np.arange(300), skip)
    s = (a @ c.T).astype(np.int64)
    for i in range(300):
        assert best.found[i][0][1].tolist() == np.lexsort((np.arange(3000), -s[i]))[:3].tolist()
    # Clustered vectors: most pairs are never scored.
    assert sum(scored) < 0.5 * s.size
