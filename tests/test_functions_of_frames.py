"""Lookup, ledger, binding and freshness operators on small tables with nulls, ties, repeats and no rows."""

from pyspark.sql import functions as F

from marlstone.operators import accounts as A
from marlstone.operators import bindings as B
from marlstone.operators import freshness as R
from marlstone.operators import lookup as L


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lookup(spark):
    docs = spark.createDataFrame([(1, 'a = "1"\nb = "2" a = "3"'), (1, "b(x)\n\nb"), (2, None), (3, ""), (None, "import b")], "id int, text string")
    lines = L.text_lines(docs, "id")
    assert rows(L.keyword(lines, ["b", "a"], "id")) == [(1, 0, "a"), (1, 0, "b"), (1, 1, "b"), (1, 2, "b"), (None, 0, "b")]
    got = L.pattern(lines, "B", "id", cap=2).collect()
    assert [tuple(r) for r in got] == [(None, 0, 4, True), (1, 0, 4, True)]
    assert rows(L.pattern(lines, "B", "id", ignore_case=False)) == []
    found = L.constants(docs, "id")
    assert rows(found) == [(1, 0, "a", "1"), (1, 1, "b", "2"), (1, 2, "a", "3")]
    assert rows(L.constants_by_name(found, ["a", "z"])) == [("a", "1", 2), ("z", None, 0)]
    buckets = L.reference_buckets(lines, ["b", "zz"], in_tests=F.lit(False), in_docs=F.col("line") == "b", exclude=("doc",))
    assert rows(buckets) == [("b", "call", 1, 0), ("b", "definition", 1, 0), ("b", "doc", 0, 1), ("b", "import", 1, 0)]
    nodes = spark.createDataFrame([(1, "ring"), (2, "ring"), (3, "a ring"), (4, None), (5, "rings of x")], "k int, n string")
    assert rows(L.definitions(nodes, ["ring", "rings", "no"], key="k", name="n")) == [("ring", 1, "exact"), ("ring", 2, "exact"), ("rings", 5, "substring")]
    assert rows(L.by_prefix(nodes, ["ring", "rings "], key="k", name="n")) == [("ring", 1, "exact"), ("ring", 2, "exact"), ("rings ", 5, "prefix")]
    assert rows(L.hover(lines.where("id = 3"), "id", F.length("line") > 0)) == []


def test_places_and_pages(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), "id").repartition(13)
    want = sorted((r.g, r.id) for r in df.collect())
    got = {(r.g, r.id): r.place for r in L.ranked(df, F.col("g"), F.col("id")).collect()}
    assert [got[x] for x in want] == list(range(1, 1001))
    assert L.ranked(df.where("false"), F.col("g")).count() == 0
    assert L.ranked(df.where("false"), F.col("id"), within=("g",)).count() == 0
    hot = df.select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") < 400, F.lit("")).otherwise(F.lit("hot")).alias("g"), "id")
    want, seen = set(), {}
    for r in sorted(hot.collect(), key=lambda r: -r.id):
        seen[r.g] = seen.get(r.g, 0) + 1
        want.add((r.g, r.id, seen[r.g]))
    assert {(r.g, r.id, r.place) for r in L.ranked(hot, F.col("id").desc(), within=("g",)).collect()} == want
    assert [tuple(r) for r in L.page(df, F.col("id").desc(), columns=["id"], size=2).collect()] == [(999, 1000, True), (998, 1000, True)]


def test_accounts(spark):
    e = spark.createDataFrame([("a", 5, 0), ("a", 0, 9), ("b", 7, 2), ("b", None, None), (None, 1, 0)], "w string, c int, d int")
    assert rows(A.closed_ledger(e, "w", credit=F.col("c"), debit=F.col("d"))) == sorted([("a", 5, 9, 0), ("b", 7, 2, 5), (None, 1, 0, 1), (None, 13, 11, 2)], key=repr)
    assert A.closed_ledger(e.where("false"), "w", credit=F.col("c"), debit=F.col("d")).where("saved > 0").count() == 0
    assert rows(A.credit_cap(e, "w", "c", "d", cap=1)) == sorted([("a", 1, 1), ("b", 1, 1), (None, 1, 0)], key=repr)
    s = spark.createDataFrame([(1, 1, "open"), (1, 2, "x"), (1, 3, "open"), (1, 4, "plan"), (1, 5, "x"), (2, 1, None)], "u int, t int, k string")
    got = A.attributed(s, "u", "t", focus=F.when(F.col("k") == "plan", "plan"), opens=F.col("k") == "open", closes=F.lit(False))
    assert [r.stage for r in got.orderBy("u", "t").collect()] == ["open wave", "open wave", "general", "plan", "plan", "general"]
    x = spark.createDataFrame([("o", 10.0, True, False), ("o", 10.0, False, True), ("p", 8.0, True, True), ("q", None, True, False)], "o string, cost double, s boolean, c boolean")
    assert rows(A.exploration_credit(x, "o", cost=F.col("cost"), surfaced=F.col("s"), cited=F.col("c")))[:2] == [("o", 12.5), ("p", 6.0)]


def test_bindings(spark):
    inherits = spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "M"), ("A", "C"), ("X", "X")], "sub string, super string")
    methods = spark.createDataFrame([("A", "run"), ("A", "run"), ("B", "stop"), ("M", "stop"), ("C", "run")], "owner string, method string")
    assert rows(B.inherited(methods, inherits)) == [("A", "stop", None), ("B", "run", "A"), ("C", "stop", None)]
    assert ("A", "run", "C") in rows(B.dispatch(methods, inherits)) and not any(s == a for s, _, a in rows(B.dispatch(methods, inherits)))
    binds = spark.createDataFrame([("P", "i"), ("P", "i"), ("Q", "j"), ("Q", "k")], "port string, impl string")
    injects = spark.createDataFrame([("c", "P"), ("c", "Q"), ("d", None)], "consumer string, port string")
    assert rows(B.injected(binds, injects)) == sorted([("c", "i"), ("c", "external::Q"), ("d", None)], key=repr)
    docs = spark.createDataFrame([(1, "see `helper_one` and `pkg.run` or `run`"), (2, None)], "id int, text string")
    labels = spark.createDataFrame([("helper_one",), ("run",), ("run",), (None,)], "label string")
    assert rows(B.doc_references(docs, labels, key="id", text="text", label="label")) == [(1, "helper_one", "EXTRACTED"), (1, "run", "AMBIGUOUS")]


def test_freshness(spark):
    c = spark.sql("SELECT f, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(d) AS at, k FROM VALUES ('a', 0, 'x'), ('a', 1, 'y'), ('a', 2, 'c'), ('a', 3, 'c'), ('a', 9, 'c'), ('b', 1, 'x'), ('b', 1, 'c') AS t(f, d, k)")
    at = lambda k: F.when(F.col("k") == k, F.col("at"))
    assert rows(R.drift(c, "f", "at", anchors=[at("x"), at("y")], historical=F.lit(False))) == [("a", 3, True), ("b", 0, False)]
    assert rows(R.half_life(c, "f", "at", times=40.0)) == [("a", 40.0), ("b", 30.0)]
    assert rows(R.churn(c, "f", "at", since=F.expr("timestamp_ntz '2024-01-02 00:00:00'")).select("f", "churn")) == [("a", 1.0), ("b", 0.5)]
    d = spark.createDataFrame([(1, "A b", ["r"]), (2, "a, B", None), (3, "z", ["r", "r"]), (4, None, [])], "k int, s string, e array<string>")
    assert rows(R.duplicates(d, "k", summary="s", groups=[], evidence="e")) == [(2, 1, "equal summary"), (3, 1, "shared evidence")]
