"""Graph queries and their SQL.

import customers, suppliers and customers are defined by nations, nations by
regions. Queries with EDGES_SQL see suppliers, parts, nations and regions only.
A second graph with cycles ties supplier numbers to part numbers modulo 100.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import bindings as B
from marlstone.operators import graph as G
from marlstone.operators.communities import cluster
from marlstone.operators.postprocess import absorbed, remapped
from marlstone.registry import portable, query, table

EDGES_SQL = """edges AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'calls' AS relation, CASE WHEN max(l_returnflag = 'A') THEN 'RESOLVED' ELSE 'EXTRACTED' END AS confidence FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'imports', 'RESOLVED' FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'defines', 'RESOLVED' FROM nation)"""
LOOP_SQL = "e AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 100 AS target FROM lineitem)"
CTE = "WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS flag FROM {lineitem})"


def edges(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).agg(
        F.lit("calls").alias("relation"), F.when(F.max(F.col("l_returnflag") == "A"), "RESOLVED").otherwise("EXTRACTED").alias("confidence")
    )
    part = lambda t, a, x, b, y, r: table(spark, d, t).select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit(r).alias("relation"), F.lit("RESOLVED").alias("confidence"))
    return items.unionByName(part("supplier", "s", "s_suppkey", "n", "s_nationkey", "imports")).unionByName(part("nation", "n", "n_nationkey", "r", "n_regionkey", "defines"))


def whole_edges(spark, d):
    part = lambda t, a, x, b, y, r: table(spark, d, t).select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit(r).alias("relation"), F.lit("RESOLVED").alias("confidence"))
    out = edges(spark, d).where("relation = 'calls'").unionByName(part("orders", "o", "o_orderkey", "c", "o_custkey", "imports"))
    for t, a, x, b, y in (("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")):
        out = out.unionByName(part(t, a, x, b, y, "defines"))
    return out


def calls(spark, d):
    return whole_edges(spark, d).where("relation = 'calls'")


def loops(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100).alias("target")).distinct()


def nations(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("seed"))


SOURCES = [
    ("a.py", "import os\nfrom b import helper\n\ndef main(path):\n    '''Run.'''\n    return helper(os.path.join(path, 'x'))\n\nclass Box:\n    def get(self):\n        return main('.')\n"),
    ("b.py", "def helper(x):\n    return inner(x)\n\ndef inner(x):\n    return str(x)\n"),
    ("c.py", "def broken(:\n"),
]


def sources(spark):
    return spark.createDataFrame(SOURCES, "path string, text string")


portable(
    "g1_resolve_symbol",
    """WITH q AS (SELECT * FROM (VALUES ('Supplier#000000001'), ('0000000012'), ('red widget'), ('nothing')) AS q(asked)),
    x AS (SELECT asked, min(s_name) AS hit FROM q JOIN {supplier} ON s_name = asked GROUP BY asked),
    s AS (SELECT asked, min(s_name) AS hit FROM q JOIN {supplier} ON s_name LIKE concat('%', asked) GROUP BY asked),
    l AS (SELECT asked, CASE WHEN count(*) = 1 THEN min(p_name) END AS hit FROM q JOIN {part} ON p_name = asked GROUP BY asked)
    SELECT q.asked, coalesce(x.hit, s.hit, l.hit) AS resolved FROM q LEFT JOIN x ON q.asked = x.asked LEFT JOIN s ON q.asked = s.asked LEFT JOIN l ON q.asked = l.asked""",
)


@query("g2_traverse", f"WITH RECURSIVE {LOOP_SQL}, r(seed, node, hop) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION SELECT seed, target, hop + 1 FROM r JOIN e ON node = source WHERE hop < 3) SELECT seed, node, min(hop)::INT AS hop FROM r GROUP BY seed, node")
def _(spark, d):
    return G.traverse(loops(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed")), hops=3)


portable("g3_neighbours", "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem}) SELECT 'out' AS side, s AS node, count(*) AS n FROM e GROUP BY s UNION ALL SELECT 'in' AS side, p AS node, count(*) AS n FROM e GROUP BY p")


@query("g4_impact", f"WITH RECURSIVE {EDGES_SQL}, w AS (SELECT source, target, CASE confidence WHEN 'RESOLVED' THEN 1.0 ELSE 0.25 END::DOUBLE AS w FROM edges), r(seed, node, weight, hop) AS (SELECT DISTINCT 'p' || l_partkey, 'p' || l_partkey, 1.0::DOUBLE, 0 FROM lineitem UNION SELECT seed, source, least(weight, w), hop + 1 FROM r JOIN w ON node = target WHERE hop < 3) SELECT seed, node, max(weight) AS weight FROM r WHERE node <> seed GROUP BY seed, node")
def _(spark, d):
    seeds = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("seed")).distinct()
    return G.impact(edges(spark, d), seeds)


#: Types in SQL: a brand inherits its maker (the first digit), a maker all brands. A brand defines the types of its parts, a maker those of its small ones.
TYPES_SQL = """i(sub, super) AS (SELECT DISTINCT p_brand, substr(p_brand, 1, 7) FROM part WHERE length(p_brand) > 7 UNION SELECT DISTINCT substr(p_brand, 1, 7), 'Brand' FROM part),
    m(owner, method) AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 45 UNION SELECT DISTINCT substr(p_brand, 1, 7), p_type FROM part WHERE p_size < 6 UNION SELECT DISTINCT 'Brand', p_type FROM part WHERE p_size = 10),
    c(sub, super, hop) AS (SELECT sub, super, 1 FROM i UNION SELECT a.sub, b.super, 2 FROM i a JOIN i b ON a.super = b.sub)"""


def inheritance(spark, d):
    part = table(spark, d, "part").select("p_brand", F.substring("p_brand", 1, 7).alias("maker"))
    return part.select(F.col("p_brand").alias("sub"), F.col("maker").alias("super")).unionByName(part.select(F.col("maker").alias("sub"), F.lit("Brand").alias("super"))).distinct()


def methods(spark, d):
    part = table(spark, d, "part").select("p_brand", F.substring("p_brand", 1, 7).alias("maker"), F.col("p_type").alias("method"), "p_size")
    own = part.where("p_size > 45").select(F.col("p_brand").alias("owner"), "method")
    maker = part.where("p_size < 6").select(F.col("maker").alias("owner"), "method")
    return own.unionByName(maker).unionByName(part.where("p_size = 10").select(F.lit("Brand").alias("owner"), "method"))


@query("g5_dispatch", f"WITH {TYPES_SQL} SELECT m.owner AS seed, m.method, n.owner AS also FROM m JOIN c ON c.super = m.owner JOIN m n ON n.owner = c.sub AND n.method = m.method")
def _(spark, d):
    return B.dispatch(methods(spark, d), inheritance(spark, d))


@query("g6_callgraph", f"WITH RECURSIVE {EDGES_SQL}, r(seed, node, hop) AS (SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0 FROM nation UNION SELECT seed, CASE WHEN source = node THEN target ELSE source END, hop + 1 FROM r JOIN (SELECT * FROM edges WHERE relation <> 'calls') x ON node IN (source, target) WHERE hop < 2), n AS (SELECT DISTINCT seed, node FROM r) SELECT a.seed, e.source, e.target FROM edges e JOIN n a ON a.node = e.source JOIN n b ON b.node = e.target AND a.seed = b.seed WHERE relation <> 'calls'")
def _(spark, d):
    return G.induced(edges(spark, d).where("relation != 'calls'"), nations(spark, d), hops=2)


@query("g6_callgraph_calls")
def _(spark, d):
    """Two calls around every 25th supplier; brute force in the tests, as recursion over all calls is too slow in SQL."""
    seeds = table(spark, d, "supplier").where("s_suppkey % 25 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("seed"))
    return G.induced(calls(spark, d), seeds, hops=2)


portable("g7_callhierarchy", "SELECT l_suppkey AS node, l_returnflag AS file, count(DISTINCT l_partkey) AS callees, count(*) AS calls FROM {lineitem} GROUP BY l_suppkey, l_returnflag")


@query("g8_cheapest_path", f"WITH RECURSIVE {EDGES_SQL}, c AS (SELECT source, target, CASE relation WHEN 'imports' THEN 2 ELSE 100 END AS cost FROM edges WHERE relation <> 'calls'), r(seed, node, cost, path, hop) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0, 's' || s_suppkey, 0 FROM supplier UNION ALL SELECT seed, target, r.cost + c.cost, path || '>' || target, hop + 1 FROM r JOIN c ON node = source WHERE hop < 4) SELECT seed, node, min(cost)::BIGINT AS cost, arg_min(path, cost) AS path FROM r GROUP BY seed, node")
def _(spark, d):
    costs = edges(spark, d).where("relation != 'calls'").withColumn("cost", F.when(F.col("relation") == "imports", 2).otherwise(100).cast("bigint"))
    return G.cheapest_paths(costs, table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("seed")))


@query("g8_cheapest_path_calls")
def _(spark, d):
    cost = F.when(F.col("relation") != "calls", 100).when(F.col("confidence") == "RESOLVED", 1).otherwise(2).cast("bigint")
    return G.cheapest_paths(whole_edges(spark, d).withColumn("cost", cost), table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("seed")))


portable("g9_fan_in_out", CTE + ", i AS (SELECT target AS node, count(*) AS fan_in FROM e GROUP BY target) SELECT node, fan_in FROM i ORDER BY fan_in DESC, node LIMIT 20")
portable("g10_chokepoints", CTE + " SELECT source AS node, count(DISTINCT target) AS fan_out FROM e GROUP BY source HAVING count(DISTINCT target) >= 20")
portable("g11_orphan_docs", "SELECT d.doc_id FROM {documents} d [[anti]] {labels} l ON d.doc_id = l.doc_id", anti="LEFT ANTI JOIN ~~ ANTI JOIN")


def containment(spark, d):
    return edges(spark, d).where("relation != 'calls'").select(F.col("source").alias("a"), F.col("target").alias("b"))


@query("g12_betweenness")
def _(spark, d):
    return G.betweenness(containment(spark, d)).withColumn("score", F.round("score", 6))


@query("g12_betweenness_calls")
def _(spark, d):
    """Over all calls; tests hold it against brute force."""
    near = calls(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"))
    return G.betweenness(near).withColumn("score", F.round("score", 6))


portable("g12_degree_fallback", "WITH e AS (SELECT s_suppkey AS a, s_nationkey AS b FROM {supplier}) SELECT node, count(*) AS degree FROM (SELECT concat('s', a) AS node FROM e UNION ALL SELECT concat('n', b) AS node FROM e) AS x GROUP BY node")


@query("g13_articulation")
def _(spark, d):
    """Over all calls; suppliers have even numbers, parts odd ones, so that no edge carries text."""
    near = table(spark, d, "lineitem").select((F.col("l_suppkey").cast("bigint") * 2).alias("a"), (F.col("l_partkey").cast("bigint") * 2 + 1).alias("b"))
    kind = F.when(F.col("node") % 2 == 0, "s").otherwise("p")
    return G.articulation_points(near).select(F.concat(kind, F.shiftright("node", 1)).alias("node"))


portable(
    "g14_entry_points",
    CTE + ", n AS (SELECT source % 50 AS a, target % 70 AS b FROM e), o AS (SELECT DISTINCT a FROM n), i AS (SELECT DISTINCT b FROM n WHERE a <> b) SELECT o.a AS node, i.b IS NULL AS is_entry_point FROM o LEFT JOIN i ON o.a = i.b",
)


@query("g15_projection", f"WITH {EDGES_SQL} SELECT least(source, target) AS a, greatest(source, target) AS b, sum(CASE relation WHEN 'calls' THEN 3 WHEN 'imports' THEN 2 ELSE 1 END)::BIGINT AS weight FROM edges GROUP BY 1, 2")
def _(spark, d):
    return G.weighted_pairs(edges(spark, d))


portable("g16_fixed_communities", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'tests' WHEN lang = 'en' THEN 'docs' WHEN n_chars > 5000 THEN 'long' ELSE 'other' END AS community FROM {documents}")


@query("g17_clustering")
def _(spark, d):
    return G.label_propagation(G.weighted_pairs(edges(spark, d)))


@query("g17_modularity")
def _(spark, d):
    """Communities of the whole edge list, calls, orders and customers with it."""
    return cluster(G.weighted_pairs(whole_edges(spark, d)))


portable(
    "g18_post_processing",
    """WITH c AS (SELECT l_suppkey % 30 AS community, l_partkey % 500 AS node FROM {lineitem} GROUP BY l_suppkey % 30, l_partkey % 500),
    p AS (SELECT l_suppkey % 25 AS was, l_partkey % 500 AS node FROM {lineitem} GROUP BY l_suppkey % 25, l_partkey % 500),
    o AS (SELECT community, was, count(*) AS shared, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, was) AS n FROM c JOIN p ON c.node = p.node GROUP BY community, was)
    SELECT community, was, shared FROM o WHERE n = 1""",
)


@query("g18_stable_communities")
def _(spark, d):
    """Communities of two builds, the earlier without every seventh part's calls: small ones absorbed, then under the earlier names."""
    late = F.pmod(F.xxhash64("target"), F.lit(7)) == 0
    every = G.stored(edges(spark, d))
    builds = []
    for rows in (every.where(~late), every):
        pairs = G.stored(G.weighted_pairs(rows))
        builds.append(absorbed(G.label_propagation(pairs), pairs))
    return remapped(builds[1], builds[0])


@query("g19_split", f"WITH RECURSIVE {EDGES_SQL}, e AS (SELECT source AS a, target AS b FROM edges WHERE relation = 'defines' UNION SELECT target, source FROM edges WHERE relation = 'defines'), r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def _(spark, d):
    strong = edges(spark, d).where("relation = 'defines'")
    return G.components(strong.select(F.col("source").alias("a"), F.col("target").alias("b")))


@query("g20_components", f"WITH RECURSIVE {EDGES_SQL}, e AS (SELECT source AS a, target AS b FROM edges WHERE relation <> 'calls' UNION SELECT target, source FROM edges WHERE relation <> 'calls'), r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def _(spark, d):
    return G.components(containment(spark, d))


@query("g20_components_whole")
def _(spark, d):
    """Every line of an order stands for its call: equal edges need not be told apart here."""
    near = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return G.components(near.unionByName(whole_edges(spark, d).where("relation != 'calls'").select(F.col("source").alias("a"), F.col("target").alias("b"))))


@query("g21_risk", f"WITH {EDGES_SQL}, w AS (SELECT target AS seed, source AS node, max(CASE confidence WHEN 'RESOLVED' THEN 1.0 ELSE 0.25 END) AS w FROM edges WHERE relation = 'calls' GROUP BY 1, 2) SELECT seed, round(sum(w) * ln(1 + count(*)), 6)::DOUBLE AS risk FROM w GROUP BY seed")
def _(spark, d):
    calls = edges(spark, d).where("relation = 'calls'")
    reach = G.impact(calls, calls.select(F.col("target").alias("seed")).distinct(), hops=1)
    fan_in = calls.groupBy(F.col("target").alias("seed")).agg(F.countDistinct("source").alias("fan_in"))
    return G.risk(reach, fan_in).withColumn("risk", F.round("risk", 6))


@query("g22_edge_resolution", """WITH d AS (SELECT p_name, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY p_name)
    SELECT q.name, CASE WHEN d.n = 1 THEN concat('p', d.id) ELSE concat('external::', q.name) END AS target FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'unknown') AS q LEFT JOIN d ON d.p_name = q.name""")
def _(spark, d):
    part = table(spark, d, "part")
    asked = part.select(F.col("p_name").alias("name")).unionByName(spark.createDataFrame([("unknown",)], "name string"))
    return B.resolved(asked, part, name="name", label="p_name", key="p_partkey", prefix="p")


@query("g23_di_binding", """WITH b AS (SELECT p_type AS port, min(p_brand) AS impl FROM part WHERE p_size = 7 GROUP BY p_type HAVING count(DISTINCT p_brand) = 1)
    SELECT p_name AS consumer, coalesce(b.impl, concat('external::', p_type)) AS target FROM part LEFT JOIN b ON b.port = p_type""")
def _(spark, d):
    """A part's type is the port it needs; types that one brand alone has in size 7 are bound to it."""
    part = table(spark, d, "part")
    binds = part.where("p_size = 7").select(F.col("p_type").alias("port"), F.col("p_brand").alias("impl"))
    return B.injected(binds, part.select(F.col("p_name").alias("consumer"), F.col("p_type").alias("port")))


@query("g24_sql_references")
def _(spark, d):
    from marlstone.operators.sql_refs import table_references

    rows = [(1, "select a.x from t1 a join t2 on a.k = t2.k"), (2, "with c as (select * from t3) insert into t4 select * from c"), (3, "not sql at all")]
    return table_references(spark, spark.createDataFrame(rows, "id int, statement string"))


@query("g25_doc_references", """WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+ = "[^"]*"|[A-Za-z]+\\.[A-Za-z]+|[A-Za-z]{6,}')) AS span FROM documents WHERE lang = 'en'),
    t AS (SELECT DISTINCT doc_id, CASE WHEN contains(span, '.') THEN regexp_extract(span, '[^.]*$') ELSE span END AS term FROM s WHERE length(span) >= 6 OR contains(span, '.')),
    w AS (SELECT word AS term, count(*) AS n FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark) GROUP BY word)
    SELECT doc_id, t.term, CASE WHEN n = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence FROM t JOIN w ON w.term = t.term""")
def _(spark, d):
    """Words and dotted terms of English documents stand for code spans, the words of a benchmark item for its symbols."""
    labels = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    english = table(spark, d, "documents").where("lang = 'en'")
    return B.doc_references(english, labels, key="doc_id", text="text", label="word", span='([A-Za-z]+ = "[^"]*"|[A-Za-z]+\\.[A-Za-z]+|[A-Za-z]{6,})')


portable("g26_hot_data", CTE + " SELECT target AS node, count(*) AS writes FROM e WHERE flag = 'R' GROUP BY target HAVING count(*) >= 8")
portable(
    "g27_community_lookup",
    CTE + ", m AS (SELECT target % 20 AS community, target AS node, count(*) AS degree FROM e GROUP BY target % 20, target), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS n FROM m) SELECT community, node, degree FROM r WHERE n <= 5",
)
portable("g28_codebase_map", "SELECT source AS directory, count(*) AS files, min(lang) AS layer, CAST(sum(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS entry_points FROM {documents} GROUP BY source")


@query("g29_inherited_bind", f"""WITH {TYPES_SQL}, f AS (SELECT c.sub, m.method, hop, count(*) AS n, min(c.super) AS super FROM c JOIN m ON m.owner = c.super WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.owner = c.sub AND x.method = m.method) GROUP BY c.sub, m.method, hop),
    r AS (SELECT *, row_number() OVER (PARTITION BY sub, method ORDER BY hop) AS place FROM f)
    SELECT sub, method, CASE WHEN n = 1 THEN super END AS bound FROM r WHERE place = 1""")
def _(spark, d):
    return B.inherited(methods(spark, d), inheritance(spark, d))


@query("g30_call_edges")
def _(spark, d):
    from marlstone.operators.code import python_calls

    return python_calls(sources(spark))


_PY = "(VALUES ('a.py', 'import os'), ('a.py', 'from b import helper'), ('b.py', 'x = 1'), ('c.py', 'import b'))"


#: Files made of tables: each nation's imports its region's, some by a form that is no import.
FILES_SQL = """f AS (SELECT concat('n', n_nationkey, '.', CASE n_nationkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'java' ELSE 'js' END) AS path,
      CASE n_nationkey % 3 WHEN 0 THEN concat('from r', n_regionkey, ' import x') WHEN 1 THEN concat('import static r', n_regionkey, ';') ELSE concat('import y from "r', n_regionkey, '"') END AS line FROM nation
    UNION ALL SELECT concat('r', r_regionkey, '.py'), concat('# import n', r_regionkey) FROM region)"""


def files(spark, d):
    kind = F.col("n_nationkey") % 3
    suffix = F.when(kind == 0, "py").when(kind == 1, "java").otherwise("js")
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    line = F.when(kind == 0, F.concat(F.lit("from "), region, F.lit(" import x"))).when(kind == 1, F.concat(F.lit("import static "), region, F.lit(";"))).otherwise(F.concat(F.lit('import y from "'), region, F.lit('"')))
    own = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("."), suffix).alias("path"), line.alias("line"))
    key = F.col("r_regionkey").cast("string")
    return own.unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), key, F.lit(".py")).alias("path"), F.concat(F.lit("# import n"), key).alias("line")))


@query("g31_import_edges", f"WITH {FILES_SQL} SELECT path, regexp_extract(line, 'r[0-9]+') AS module FROM f WHERE path LIKE 'n%'")
def _(spark, d):
    return B.import_edges(files(spark, d))


portable("g32_dependencies", "SELECT o_custkey AS target, count(*) AS importers FROM {orders} GROUP BY o_custkey")


@query("g33_reverse_imports", f"WITH {FILES_SQL} SELECT path, concat(regexp_extract(line, 'r[0-9]+'), '.py') AS imports FROM f WHERE path LIKE 'n%.py'")
def _(spark, d):
    return B.reverse_imports(B.import_edges(files(spark, d)), files(spark, d))


@query("g34_error_recovery", """SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN concat('t', n_nationkey) WHEN 1 THEN concat('a', n_nationkey, ',b', n_nationkey) ELSE '' END AS tables, 'recovered' AS provenance, CASE WHEN n_nationkey % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS unrecovered
    FROM nation WHERE n_nationkey % 4 <> 2""")
def _(spark, d):
    """Broken statements made of nations: one table, two, none in a comment and a string, a name that is missing."""
    key, kind = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit("garbage (\nCREATE TABLE t"), key, F.lit(" (x int")))
        .when(kind == 1, F.concat(F.lit("create table if not exists b"), key, F.lit(" (y\n)) oops\n  create table a"), key, F.lit(" (")))
        .when(kind == 2, F.concat(F.lit("-- create table c"), key, F.lit("\nselect 'create table d' /*\ncreate table e */")))
        .otherwise(F.lit("create table (x int)"))
    )
    return B.recovered_tables(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), body.alias("body")), key="id", body="body")


@query("g35_embedded_sql")
def _(spark, d):
    from marlstone.operators.sql_refs import embedded_references

    rows = [("a.py", 'db.execute("select x from t1")'), ("b.py", 'print("select the best from all")'), ("c.py", "db.execute(f\"select * from {name}\")")]
    return embedded_references(spark, spark.createDataFrame(rows, "path string, text string"))


@query("g36_entity_tables", """WITH e AS (SELECT DISTINCT substr(s_name, 1, 8) AS entity FROM supplier UNION SELECT n_name FROM nation UNION SELECT 'NOPE'), t AS (SELECT n_name AS name, count(*) AS n, min(n_nationkey) AS id FROM (SELECT n_name, n_nationkey FROM nation UNION ALL SELECT n_name, n_nationkey + 100 FROM nation WHERE n_regionkey = 2) GROUP BY n_name)
    SELECT entity, CASE WHEN t.n = 1 THEN concat('table::', t.id) ELSE concat('external::', entity) END AS target FROM e LEFT JOIN t ON t.name = entity""")
def _(spark, d):
    """Nations declare tables, those of one region twice; suppliers' name stems declare none."""
    nation = table(spark, d, "nation")
    twice = nation.unionByName(nation.where("n_regionkey = 2").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    entities = nation.select(F.col("n_name").alias("entity")).unionByName(table(spark, d, "supplier").select(F.substring("s_name", 1, 8).alias("entity")))
    entities = entities.unionByName(spark.createDataFrame([("NOPE",)], "entity string"))
    return B.resolved(entities, twice, name="entity", label="n_name", key="n_nationkey", prefix="table::")


portable("g37_line_scan", "SELECT doc_id, [[n]] AS definitions FROM {documents} WHERE n_chars > 10000", n=r"CAST(size(regexp_extract_all(text, '(?m)^[A-Z][a-z]+', 0)) AS BIGINT) ~~ CAST(len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+')) AS BIGINT)")
portable("g38_near_symbols", "SELECT p_name, min(levenshtein(p_name, 'red wigdet')) AS distance FROM {part} WHERE levenshtein(p_name, 'red wigdet') <= 5 GROUP BY p_name")
portable(
    "g39_memory_edges",
    "WITH t AS (SELECT m.id, m.target FROM (VALUES ('m1', 'red widget'), ('m2', 'small ring'), ('m3', 'no such')) AS m(id, target)) SELECT t.id, t.target, count(p.p_partkey) AS nodes FROM t LEFT JOIN {part} p ON p.p_name = t.target GROUP BY t.id, t.target",
)
portable(
    "g40_honesty",
    "SELECT l_suppkey AS source, l_partkey AS target, CASE WHEN min(l_returnflag) = 'A' AND max(p.p_partkey) IS NULL THEN 'EXTRACTED' WHEN min(l_returnflag) = 'A' THEN 'RESOLVED' ELSE 'EXTRACTED' END AS confidence FROM {lineitem} LEFT JOIN (SELECT p_partkey FROM {part} WHERE p_size < 40) p ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey",
)
portable(
    "g41_impacted_docs",
    "SELECT d.doc_id FROM {documents} d WHERE EXISTS (SELECT 1 FROM (VALUES ('license'), ('token'), ('mail')) AS c(symbol) WHERE contains(d.text, c.symbol))",
)


@query("g42_scope_binding", """WITH u AS (SELECT DISTINCT p_name AS name, p_brand AS scope FROM part WHERE p_size > 20), d AS (SELECT p_name AS name, p_brand AS scope, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_size <= 40 GROUP BY p_name, p_brand)
    SELECT u.name, u.scope, CASE WHEN d.n = 1 THEN d.id END AS bound FROM u LEFT JOIN d ON d.name = u.name AND d.scope = u.scope""")
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("scope"), F.col("p_partkey").alias("id"), "p_size")
    return B.scoped(part.where("p_size <= 40"), part.where("p_size > 20"))


@query("h13_supersession", "WITH RECURSIVE l AS (SELECT n AS id, CASE WHEN n % 5 <> 0 THEN n + 1 END AS next FROM (SELECT DISTINCT user_id AS n FROM events)), r(id, cur, hop) AS (SELECT id, id, 0 FROM l UNION ALL SELECT r.id, l.next, hop + 1 FROM r JOIN l ON r.cur = l.id WHERE l.next IS NOT NULL) SELECT id, arg_max(cur, hop) AS terminal FROM r GROUP BY id")
def _(spark, d):
    links = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumn("at", F.when(F.col("id") % 5 != 0, F.col("id") + 1).otherwise(F.col("id")))
    return G.terminals(links)
