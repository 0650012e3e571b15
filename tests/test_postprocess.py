"""Post-processing of communities against plain loops."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from marlstone.operators.postprocess import absorbed, joined_stems, remapped


def frame(spark, told):
    return spark.createDataFrame(sorted(told.items()), "node string, community string").repartition(3)


def read(df):
    rows = [(r.node, r.community) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def greedy(new, old):
    shared = Counter((c, old[n]) for n, c in new.items() if n in old)
    names = {}
    for (c, was), _ in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
        if c not in names and was not in names.values():
            names[c] = was
    taken = set(names.values())
    return {n: names.get(c, c + "~" if c in taken else c) for n, c in new.items()}


def swallow(communities, pairs, least):
    now = dict(communities)
    while True:
        sizes = Counter(now.values())
        ties = defaultdict(int)
        for a, b, w in pairs:
            if now[a] != now[b]:
                ties[now[a], now[b]] += w
                ties[now[b], now[a]] += w
        chosen = {}
        for (c, to), w in ties.items():
            if sizes[c] < least:
                chosen[c] = min(chosen.get(c, (-w, to)), (-w, to))
        if not chosen:
            return now
        group = {c: {c} for c in sizes}
        for c, (_, to) in chosen.items():
            both = group[c] | group[to]
            for x in both:
                group[x] = both
        now = {n: min((-sizes[x], x) for x in group[c])[1] for n, c in now.items()}


def test_names_stay_over_builds(spark):
    rng = random.Random(2)
    old = {f"n{i:03d}": f"c{i // 20}" for i in range(200)}
    new = {n: (f"c{(int(c[1:]) + 3) % 10}" if rng.random() < 0.9 else f"c{rng.randrange(14)}") for n, c in old.items()} | {"x": "c3", "y": "y"}
    del new["n000"], old["n199"]
    assert read(remapped(frame(spark, new), frame(spark, old))) == greedy(new, old)
    # The same communities under other names get their old ones back.
    again = {n: "other" + c for n, c in old.items()}
    assert read(remapped(frame(spark, again), frame(spark, old))) == old
    assert read(remapped(frame(spark, {"q": "q"}), frame(spark, old))) == {"q": "q"}


def test_small_ones_are_absorbed(spark):
    rng = random.Random(5)
    communities = {f"n{i:03d}": f"c{min(i // 15, 6 + i % 11):02d}" for i in range(160)} | {"alone": "alone"}
    nodes = sorted(set(communities) - {"alone"})
    pairs = [(*rng.sample(nodes, 2), rng.randrange(1, 4)) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string, weight bigint")
    got = read(absorbed(frame(spark, communities), df))
    assert got == swallow(communities, pairs, 12) and got["alone"] == "alone"
    assert all(n >= 12 for c, n in Counter(got.values()).items() if c != "alone" and any(communities[x] != communities[y] for x, y, _ in pairs if got[x] == c))
    assert read(absorbed(frame(spark, communities), df.where("false"))) == communities


def test_stems(spark):
    communities = {"a": "1", "b": "1", "c": "2", "d": "3", "e": "3", "f": "4"}
    stems = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "y")], "node string, stem string")
    assert read(joined_stems(frame(spark, communities), stems)) == {"a": "1", "b": "1", "c": "1", "d": "3", "e": "3", "f": "4"}


def test_without_small_communities_no_edge_is_read(spark):
    """edges are looked at where a small community's nodes are."""
    nodes = spark.createDataFrame([(f"n{i}", f"c{i % 2}") for i in range(30)], "node string, community string")
    bad = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("a"), F.lit("n1").alias("b"), F.lit(1).alias("weight"))
    assert {tuple(r) for r in absorbed(nodes, bad).collect()} == {(f"n{i}", f"c{i % 2}") for i in range(30)}
