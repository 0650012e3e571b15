
from collections import defaultdict
from heapq import heappop, heappush

import pytest

from marlstone import registry
from marlstone.operators import graph

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def edges(spark):
    """(source, target): cost."""
    rows = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    out = {}
    for s, p, flag in rows("lineitem", "l_suppkey", "l_partkey", "l_returnflag"):
        out[f"s{s}", f"p{p}"] = min(out.get((f"s{s}", f"p{p}"), 2), 1 if flag == "A" else 2)
    for a, b, name, *c in (("o", "c", "orders", "o_orderkey", "o_custkey"), ("c", "n", "customer", "c_custkey", "c_nationkey"), ("s", "n", "supplier", "s_suppkey", "s_nationkey"), ("n", "r", "nation", "n_nationkey", "n_regionkey")):
        out |= {(f"{a}{x}", f"{b}{y}"): 100 for x, y in rows(name, *c)}
    return out


def around(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


def reached(near, start, without=None, most=10**9):
    seen, front = {start}, {start}
    while front and most:
        front = {w for v in front for w in near[v]} - seen - {without}
        seen |= front
        most -= 1
    return seen


def test_callgraph_holds_calls(spark, edges):
    pairs = [p for p, cost in edges.items() if cost < 100]
    near = around(pairs)
    seeds = {a for a, _ in edges if a[0] == "s" and int(a[1:]) % 25 == 1}
    want = [(s, a, b) for s in seeds for inside in [reached(near, s, most=2)] for a, b in pairs if a in inside and b in inside]
    assert want and sorted((r.seed, r.source, r.target) for r in run(spark, "g6_callgraph_calls")) == sorted(want)


def test_cheapest_paths_cross_calls(spark, edges):
    out = defaultdict(list)
    for (a, b), cost in edges.items():
        out[a].append((b, cost))
    want = {}
    for seed in {a for a, _ in edges if a[0] == "s"}:
        heap = [(0, seed, seed)]
        while heap:
            cost, path, node = heappop(heap)
            if (seed, node) not in want:
                want[seed, node] = (cost, path)
                for b, c in out[node]:
                    heappush(heap, (cost + c, f"{path}>{b}", b))
    assert {(r.seed, r.node): (r.cost, r.path) for r in run(spark, "g8_cheapest_path_calls")} == want


def test_cheapest_paths_end_at_a_fixpoint_only(spark):
    rows = [(i, i + 1, 1) for i in range(9)] + [(0, 9, 50)]
    found = graph.cheapest_paths(spark.createDataFrame(rows, "source int, target int, cost bigint"), spark.createDataFrame([(0,)], "seed int"))
    assert {r.node: r.cost for r in found.collect()} == {i: i for i in range(10)}
    with pytest.raises(ValueError, match="above 0"):
        graph.cheapest_paths(spark.createDataFrame([(0, 1, 0)], "source int, target int, cost bigint"), spark.createDataFrame([(0,)], "seed int"))


def test_articulation_points_of_calls(spark, edges):
    near = around(p for p, cost in edges.items() if cost < 100)
    want = set()
    for v in list(near):
        rest = near[v]
        want |= {v} if rest and not rest <= reached(near, min(rest), v) else set()
    assert {r.node for r in run(spark, "g13_articulation")} == want


def test_components_span_all_tables(spark, edges):
    near = around(edges)
    want = {n: min(reached(near, n)) for n in near}
    assert {r.node: r.component for r in run(spark, "g20_components_whole")} == want
