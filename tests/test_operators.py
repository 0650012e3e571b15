"""Properties of operators that a single comparison does not show."""

import random
import re

from pyspark.sql import functions as F

from marlstone.operators import graph, incremental, retrieval, scanning


def test_bm25_ignores_documents_without_the_words(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, None), (4, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "nothing here")], "qid int, text string")
    assert [(r.qid, r.doc_id) for r in retrieval.bm25(docs, asked).collect()] == [(1, 1)]


def test_fusion_adds_weights(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid int, doc_id bigint, rank bigint")
    got = {r.doc_id: r.score for r in retrieval.fuse([(a, 1.0), (a.where("doc_id = 8"), 1.5)]).collect()}
    assert abs(got[8] - (1 / 62 + 1.5 / 62)) < 1e-12 and got[7] == 1 / 61


def test_traverse_grows_with_hops_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "source int, target int")
    seeds = spark.createDataFrame([(1,)], "seed int")
    near = [{r.node for r in graph.traverse(edges, seeds, hops=h).collect()} for h in (1, 2, 9)]
    assert near == [{1, 2}, {1, 2, 3}, {1, 2, 3, 4}]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert found == {n: root(n) for p in pairs for n in p}


def test_incremental_graph_equals_full_build(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(50)) for _ in range(200)]
    full = spark.createDataFrame(rows, "owner int, target int").distinct()
    stale = full.withColumn("target", F.when(F.col("owner") < 5, F.col("target") + 1).otherwise(F.col("target")))
    changed = full.where("owner < 5")
    merged = incremental.merged_edges(stale, changed, changed, owner="owner")
    assert incremental.fingerprint(merged.select("owner", "target")).first() == incremental.fingerprint(full).first()


def test_betweenness_of_a_path(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert {r.node: r.score for r in graph.betweenness(pairs).collect()} == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}
    assert {r.node for r in graph.articulation_points(pairs).collect()} == {2, 3}
    assert {r.mode for r in graph.betweenness(pairs, most_edges=1).collect()} == {"degree"}


def test_greedy_budget_skips_what_does_not_fit(spark):
    ranked = spark.createDataFrame([(1, 1, 1, 9), (1, 2, 2, 50), (1, 3, 3, 2)], "qid int, doc_id bigint, rank bigint, size bigint")
    assert sorted(r.doc_id for r in retrieval.greedy_budget(ranked, budget=12, key="doc_id", size="size").collect()) == [1, 3]


def test_label_propagation_goes_on_for_24_rounds(spark):
    pairs = [(i, i + 1, 100 - i) for i in range(40)]
    near = {n: {} for n in range(41)}
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    rounds = [{n: n for n in near}]
    for _ in range(24):
        votes = {n: [(sum(w for b, w in near[n].items() if rounds[-1][b] == x), -x) for x in {rounds[-1][b] for b in near[n]}] for n in near}
        rounds.append({n: -max(v)[1] for n, v in votes.items()})
    assert rounds[8] != rounds[24] != rounds[23]
    table = spark.createDataFrame(pairs, "a int, b int, weight int")
    assert {r.node: r.community for r in graph.label_propagation(table).collect()} == rounds[24]


def test_scan_places_every_match(spark):
    texts = [None, "", "a@b.c and a@b.c, xa@b.c a@b.c\n1.2.3.4 11.2.3.4 1.2.3.4", 'token = "x" my_token = "x" token = "x"', "é@b.c a@b.c é a@b.c" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.line_no, r.ord, r.start, r.stop, r.matched) for r in scanning.scan(docs).collect())
    want = sorted(
        (i, at, n, m.start() + 1, m.end() + 1, m.group())
        for i, text in enumerate(texts)
        for at, line in enumerate((text or "").split("\n"))
        for _, n, word, pattern in scanning.RULES
        if word in line
        for m in re.finditer(pattern, line)
    )
    assert got == want and len({x[:4] for x in got}) == len(got)


def test_overlaps_hang_on_true_places(spark):
    rules = (("pair", 1, "ab", "ab!"), ("letters", 2, "ab", "ab"))
    docs = spark.createDataFrame([(1, "ab ab!")], "doc_id bigint, text string")
    kept = scanning.without_overlaps(scanning.scan(docs, rules=rules)).collect()
    assert sorted((r.rule, r.start) for r in kept) == [("letters", 1), ("pair", 4)]
