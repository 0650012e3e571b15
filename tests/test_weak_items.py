"""Graph merge, lifecycle ids and chains against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.operators import graph_merge as M
from marlstone.operators.lifecycle import A_DAY, OFFSET, minted


def full(definitions, references):
    nodes = defaultdict(set)
    for f, s, n in definitions:
        if None not in (f, s, n):
            nodes[s].add(n)
    out = set()
    for f, s in references:
        if None not in (f, s):
            own = nodes[s]
            out.add((f, s, *((min(own), "RESOLVED") if len(own) == 1 else (None, "AMBIGUOUS" if own else "EXTRACTED"))))
    return out


def frames(spark, definitions, references):
    return spark.createDataFrame(definitions, "file string, symbol string, node bigint"), spark.createDataFrame(references, "file string, symbol string")


def edges_of(df):
    rows = [tuple(r) for r in df.select("file", "symbol", "target", "confidence").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_added_renamed_and_ambiguous_symbols(spark):
    before = ([("a", "f", 1), ("a", "g", 2), ("b", "h", 3), ("c", "k", 4)], [("x", "f"), ("x", "g"), ("y", "h"), ("y", "new"), ("z", "k"), ("z", "k"), ("a", "h")])
    # a renames f to f2, adds new and a second h; b goes; x has other references.
    fresh = ([("a", "f2", 1), ("a", "g", 2), ("a", "new", 5), ("a", "h", 6)], [("a", "h"), ("x", "g")])
    stored = M.build(*frames(spark, *before))
    graph_, dependent = M.merge(stored, spark.createDataFrame([("a",), ("b",), ("x",)], "file string"), *frames(spark, *fresh))
    now = ([r for r in before[0] if r[0] not in "abx"] + fresh[0], [r for r in before[1] if r[0] not in "abx"] + fresh[1])
    assert edges_of(graph_.edges) == full(*now)
    # Only references to f, f2, h and new are looked at again; k and g are not.
    assert {tuple(r) for r in dependent.collect()} == {("y", "h"), ("y", "new")}
    assert {tuple(r) for r in graph_.definitions.select("file", "symbol", "node").collect()} == set(now[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_full_builds(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice([None, *[f"s{i}" for i in range(25)]])
    fragment = lambda f: ([(f, name(), rng.randrange(40)) for _ in range(rng.randint(0, 4))], [(f, name()) for _ in range(rng.randint(0, 6))])
    files = {f"f{i}": fragment(f"f{i}") for i in range(20)}
    flat = lambda k: [r for v in files.values() for r in v[k]]
    stored = M.build(*frames(spark, flat(0), flat(1)))
    for _ in range(2):
        changed = rng.sample(sorted(files), 4) + ["never there"]
        for f in changed[:3]:
            files[f] = fragment(f)
        files.pop(changed[3])
        new = [files[f] for f in changed if f in files]
        told = frames(spark, [r for v in new for r in v[0]], [r for v in new for r in v[1]])
        stored, _ = M.merge(stored, spark.createDataFrame([(f,) for f in changed], "file string"), *told)
        assert edges_of(stored.edges) == full(flat(0), flat(1))


def probed(rows):
    """Linear probing in the order of own number and key."""
    out, taken = [], set()
    for own, key in sorted((OFFSET + day * A_DAY + h, key) for key, day, h in rows):
        while own in taken:
            own += 1
        taken.add(own)
        out.append((key, own))
    return sorted(out)


def test_no_id_twice(spark):
    """A day with 10,000 keys runs over into the next days."""
    rng = random.Random(9)
    rows = [(i, 100, rng.randrange(A_DAY)) for i in range(10_000)] + [(20_000 + i, 101 + i % 4, rng.randrange(A_DAY)) for i in range(900)] + [(5, 100, 7)]
    df = spark.createDataFrame(rows, "id bigint, n int, h bigint").withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("n"))).repartition(5)
    for block in (1 << 16, 300):
        got = sorted((r.id, r.number) for r in minted(df, key="id", day="day", hashed=F.col("h"), block=block).collect())
        assert got == probed(rows) and len({n for _, n in got}) == len(rows)
    told = minted(df.where("n != 100"), key="id", day="day").collect()
    assert len({r.lifecycle_id for r in told}) == len(told) and all(int(r.lifecycle_id, 36) == r.number for r in told)
    assert minted(df.where("false"), key="id", day="day").count() == 0
    assert minted(df.limit(3).withColumn("day", F.lit(None).cast("date")), key="id", day="day").count() == 0


def test_long_chains_and_cycles(spark):
    rows = [(i, i + 1) for i in range(100)] + [(200, None), (201, 200), (300, 301)]
    assert {r.id: r.terminal for r in graph.terminals(spark.createDataFrame(rows, "id bigint, at bigint")).collect()} == {**dict.fromkeys(range(100), 100), 200: 200, 201: 200, 300: 301}
    with pytest.raises(ValueError, match="cycle"):
        graph.terminals(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id bigint, at bigint"))


def test_running_totals(spark):
    """A hot group, a null one, null values, ties of the order; blocks smaller than a group."""
    from marlstone.operators.lookup import running_total

    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else rng.choice([None, "a"]), rng.choice([None, 1, 5])) for i in range(600)]
    df = spark.createDataFrame(rows, "i bigint, g string, v bigint").repartition(4)
    for block in (1 << 16, 37):
        sums, want = defaultdict(int), {}
        for i, g, v in rows:
            sums[g] += v or 0
            want[i] = sums[g]
        assert {r.i: r.upto for r in running_total(df, "v", F.col("i"), within=("g",), block=block).collect()} == want
    assert [r.upto for r in running_total(df.where("g = 'a'"), "v", F.col("i")).orderBy("i").collect()][-1] == sum(v or 0 for _, g, v in rows if g == "a")
    assert running_total(df.where("false"), "v", F.col("i"), within=("g",)).count() == 0
