"""Modularity clustering against brute force and label propagation."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from marlstone.operators import communities
from marlstone.operators.communities import cluster, modularity
from marlstone.operators.graph import key_of, label_propagation


def brute(pairs, community):
    """Modularity by its definition, over ordered pairs of nodes."""
    weight, degree = {}, {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            weight[x, y] = weight.get((x, y), 0) + w
            degree[x] = degree.get(x, 0) + w
    m2 = sum(degree.values())
    return sum(weight.get((x, y), 0) / m2 - degree[x] * degree[y] / m2**2 for x in degree for y in degree if community[x] == community[y])


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string, weight bigint").repartition(3)


def found(spark, pairs):
    df = cluster(frame(spark, pairs))
    return df, {r.node: r.community for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_small_graphs_reach_the_best_partition(spark, seed):
    rng = random.Random(seed)
    groups = ["abc", "defg"] if seed == 1 else ["abcd", "efgh"]
    pairs = [(x, y, 3) for g in groups for x, y in combinations(g, 2)] + [(rng.choice(groups[0]), rng.choice(groups[1]), 1) for _ in range(2)]
    pairs += [pairs[0], (pairs[1][1], pairs[1][0], 2), ("a", "a", 1)]
    df, got = found(spark, pairs)
    most = max(brute(pairs, {x: i for i, c in enumerate(p) for x in c}) for p in partitions(sorted("".join(groups))))
    assert brute(pairs, got) == pytest.approx(most)
    assert modularity(frame(spark, pairs), df) == pytest.approx(most)
    assert all(c == min(n for n, other in got.items() if other == c) for c in got.values())


def test_planted_communities_and_label_propagation(spark):
    rng = random.Random(7)
    pairs = []
    for g in range(12):
        members = [f"n{g:02d}{i:02d}" for i in range(14)]
        pairs += [(x, y, 1) for x, y in combinations(members, 2) if rng.random() < 0.5]
    pairs += [(f"n{rng.randrange(12):02d}{rng.randrange(14):02d}", f"n{rng.randrange(12):02d}{rng.randrange(14):02d}", 1) for _ in range(90)]
    # A hub that touches everything, and a pair on its own.
    pairs += [("hub", f"n{g:02d}{i:02d}", 1) for g in range(12) for i in range(0, 14, 5)] + [("x", "y", 1)]
    df, got = found(spark, pairs)
    spread = label_propagation(frame(spark, pairs).where("a != b").groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    assert modularity(frame(spark, pairs), df) >= modularity(frame(spark, pairs), spread) - 1e-9
    assert len({got[f"n{g:02d}{i:02d}"] for g in range(12) for i in range(14)}) <= 14
    assert max(len({got[f"n{g:02d}{i:02d}"] for i in range(14)}) for g in range(12)) <= 2
    assert got["x"] == got["y"] == "x" and set(got) == {x for a, b, _ in pairs for x in (a, b)}


def test_edges(spark):
    assert found(spark, [("a", "b", 1)])[1] == {"a": "a", "b": "a"}
    assert found(spark, [("a", "a", 2)])[1] == {"a": "a"}
    assert cluster(frame(spark, []).where("false")).count() == 0


@pytest.fixture
def steps(monkeypatch):
    """Nodes and rows of edges of each half-sweep, and what label propagation found on the folded graph."""
    seen, moved, spread = {"moved": [], "spread": []}, communities._moved, communities._propagated
    monkeypatch.setattr(communities, "_moved", lambda *a: (seen["moved"].append(a[4]), moved(*a))[1])
    monkeypatch.setattr(communities, "_propagated", lambda places, *a: (seen["spread"].append((places, out := spread(places, *a))), out)[1])
    return seen


def test_nodes_with_one_edge_are_folded_and_sweeps_are_brief(spark, steps):
    """leaves stay out of the sweeps and out of label propagation, whose labels are the same; a level has two sweeps, not up to 20."""
    rng = random.Random(3)
    pairs = [(f"n{i:02d}", f"n{j:02d}", rng.randint(1, 3)) for i, j in combinations(range(24), 2) if rng.random() < (0.7 if i % 3 == j % 3 else 0.1)]
    pairs += [(f"leaf{i:02d}", f"n{i % 7:02d}", 1 + i % 4) for i in range(40)] + [("x", "y", 2), ("loop", "loop", 1), ("held", "held", 1), ("held", "n03", 2)]
    df, got = found(spark, pairs)
    assert set(got) == {x for a, b, _ in pairs for x in (a, b)}
    assert all(got[f"leaf{i:02d}"] == got[f"n{i % 7:02d}"] for i in range(40)) and got["x"] == got["y"]
    # The nodes left are the 24, x for y, and the two with loops.
    assert max(steps["moved"]) == 27 and steps["moved"].count(27) <= 8
    plain = {r.node: r.community for r in label_propagation(frame(spark, pairs).where("a != b")).collect()} | {"loop": "loop"}
    places, spread = steps["spread"][0]
    label = F.when(F.col("node") == F.col("at"), F.col("label")).otherwise(F.col("before"))
    names = {r.key: r.n for r in spark.createDataFrame([(n,) for n in got], "n string").withColumn("key", key_of(F.col("n"), 0)).collect()}
    folded = {names[r.node]: r.label for r in places.join(spread.withColumnRenamed("a", "at"), "at").select("node", label.alias("label")).collect()}
    assert len({(plain[n], folded[n]) for n in got}) == len(set(plain.values())) == len(set(folded.values()))
    assert brute(pairs, got) >= brute(pairs, plain) - 1e-9
