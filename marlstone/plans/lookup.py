"""Exact search, filters and lookups: operators over the driver's tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import lookup as L
from marlstone.registry import portable, query, table

#: Lines of documents in SQL.
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
CONSTANTS = """(SELECT doc_id, generate_subscripts(f, 1) - 1 AS position, unnest(f) AS found FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_]+ = "[^"]*"') AS f FROM documents))"""
SYMBOLS = ["token", "the", "License", "Apache", "import"]


def lines(spark, d):
    return L.text_lines(table(spark, d, "documents"), "doc_id")


@query("e1_keyword", f"""WITH h AS (SELECT doc_id, pos, q.ord, q.word, row_number() OVER (PARTITION BY doc_id, pos ORDER BY q.ord) AS n FROM {LINES} l, (VALUES (1, 'license'), (2, 'token'), (3, '@mail')) AS q(ord, word) WHERE contains(line, q.word))
    SELECT doc_id, CAST(pos AS BIGINT) AS line_no, word AS matched_query FROM h WHERE n = 1""")
def _(spark, d):
    return L.keyword(lines(spark, d), ["license", "token", "@mail"], "doc_id")


@query("e2_pattern", f"""WITH h AS (SELECT doc_id, pos, count(*) OVER () AS total, row_number() OVER (ORDER BY doc_id, pos) AS n FROM {LINES} l WHERE regexp_matches(line, '(?i)licen[sc]e|[0-9][0-9][0-9]-[0-9][0-9][0-9][0-9]'))
    SELECT doc_id, CAST(pos AS BIGINT) AS line_no, total AS total_matches_found, total > 50 AS truncated FROM h WHERE n <= 50""")
def _(spark, d):
    return L.pattern(lines(spark, d), "licen[sc]e|[0-9][0-9][0-9]-[0-9][0-9][0-9][0-9]", "doc_id")


@query("e3_constants", f"""SELECT r.name, min(c.value) AS value, count(c.value) AS n FROM (VALUES ('token'), ('secret'), ('missing')) AS r(name)
    LEFT JOIN (SELECT split_part(found, ' = ', 1) AS name, regexp_extract(found, '"([^"]*)"', 1) AS value FROM {CONSTANTS}) c ON c.name = r.name GROUP BY r.name""")
def _(spark, d):
    return L.constants_by_name(L.constants(table(spark, d, "documents"), "doc_id"), ["token", "secret", "missing"])


portable(
    "e4_kind_filter",
    "SELECT d.doc_id, c.category FROM {documents} d JOIN (VALUES ('germanic', 'en'), ('germanic', 'de'), ('romance', 'fr'), ('romance', 'es')) AS c(category, lang) ON d.lang = c.lang WHERE c.category = 'romance'",
)


@query("e5_per_file_cap", """WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE lang = 'en')
    SELECT doc_id, source, n_chars FROM r WHERE n <= 3 ORDER BY n_chars DESC, doc_id LIMIT 40""")
def _(spark, d):
    english = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    return L.per_group_cap(english, "source", F.col("n_chars").desc(), F.col("doc_id"), cap=3, limit=40)


portable("e6_limit_clamp", "SELECT event_id, CAST(greatest(1, least(event_id, 20)) AS BIGINT) AS small, CAST(greatest(1, least(event_id, 200)) AS BIGINT) AS large FROM {events}")


@query("e7_paging", """WITH o AS (SELECT o_orderkey, count(*) OVER () AS total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
    SELECT o_orderkey, total, total > 100 AS has_more FROM o WHERE n <= 100""")
def _(spark, d):
    final = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return L.page(final, F.col("o_totalprice").desc(), F.col("o_orderkey"), columns=["o_orderkey"], size=100)


@query("e8_hover", f"""WITH l AS (SELECT doc_id, pos, line, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM {LINES} x),
    s AS (SELECT doc_id, pos AS first_line, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n_lines) - 1 AS last_line, line AS name FROM l WHERE length(line) < 60)
    SELECT l.doc_id, CAST(l.pos AS BIGINT) AS line_no, s.name AS enclosing FROM l JOIN s ON l.doc_id = s.doc_id AND l.pos BETWEEN s.first_line AND s.last_line""")
def _(spark, d):
    return L.hover(lines(spark, d), "doc_id", F.length("line") < 60)


@query("e9_outline", f"""WITH l AS (SELECT doc_id, pos, line, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM {LINES} x)
    SELECT doc_id, line AS name, CAST(pos AS BIGINT) AS first_line, CAST(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n_lines) - 1 AS BIGINT) AS last_line FROM l WHERE length(line) < 60""")
def _(spark, d):
    return L.outline(lines(spark, d), "doc_id", F.length("line") < 60)


@query("e10_definition", """WITH q AS (SELECT unnest(['red widget', 'ring', 'small']) AS label), x AS (SELECT label, p_partkey, 'exact' AS how FROM part JOIN q ON p_name = label)
    SELECT * FROM x UNION ALL SELECT label, p_partkey, 'substring' FROM part JOIN q ON contains(p_name, label) WHERE label NOT IN (SELECT label FROM x)""")
def _(spark, d):
    return L.definitions(table(spark, d, "part"), ["red widget", "ring", "small"], key="p_partkey", name="p_name")


@query("e11_reference_buckets", rf"""WITH l AS (SELECT line, source IN ('src0', 'src1') AS t, lang <> 'en' AS o FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents)),
    h AS (SELECT symbol, line, t, o FROM l, (SELECT unnest({SYMBOLS}) AS symbol) WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])' || symbol || '($|[^A-Za-z0-9_])')),
    b AS (SELECT symbol, CASE WHEN t THEN 'test' WHEN regexp_matches(line, '(^|[^A-Za-z0-9_])' || symbol || ' = ') THEN 'definition' WHEN regexp_matches(line, '^(import|from) ') THEN 'import'
      WHEN regexp_matches(line, '(^|[^A-Za-z0-9_])' || symbol || '\(') THEN 'call' WHEN regexp_matches(line, '(^|[^A-Za-z0-9_])' || symbol || '[.\[]') THEN 'read' WHEN o THEN 'doc' ELSE 'mention' END AS bucket FROM h)
    SELECT symbol, bucket, count(*) FILTER (bucket <> 'test') AS hits, count(*) FILTER (bucket = 'test') AS excluded FROM b GROUP BY symbol, bucket""")
def _(spark, d):
    held = L.text_lines(table(spark, d, "documents"), "source", "lang")
    return L.reference_buckets(held, SYMBOLS, in_tests=F.col("source").isin("src0", "src1"), in_docs=F.col("lang") != "en", exclude=("test",))


portable(
    "e12_anchor_resolve",
    "SELECT page_id, [[a]] AS scheme, [[b]] AS host, [[c]] AS path, CASE WHEN [[a]] = 'https' THEN 'trusted' ELSE 'untrusted' END AS trust FROM {pages}",
    a="regexp_extract(url, '^([a-z]+)://', 1) ~~ regexp_extract(url, '^([a-z]+)://', 1)",
    b="regexp_extract(url, '^[a-z]+://([^/]*)', 1) ~~ regexp_extract(url, '^[a-z]+://([^/]*)', 1)",
    c="regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) ~~ regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1)",
)
portable(
    "e13_containment",
    "SELECT page_id, url FROM {pages} WHERE NOT contains(url, '/../') AND [[match]]",
    match="url rlike '^https?://[a-z0-9.-]+/' ~~ regexp_matches(url, '^https?://[a-z0-9.-]+/')",
)


@query("e14_prefix_lookup", """WITH h AS (SELECT q.asked, p.s_suppkey, p.s_name = q.asked AS exact_hit FROM supplier p JOIN (VALUES ('Supplier#000000001'), ('Supplier#00000001'), ('Supplier#00000009')) AS q(asked) ON p.s_name LIKE concat(q.asked, '%')),
    c AS (SELECT *, max(CASE WHEN exact_hit THEN 1 ELSE 0 END) OVER (PARTITION BY asked) AS any_exact, count(*) OVER (PARTITION BY asked) AS n FROM h)
    SELECT asked, s_suppkey, CASE WHEN exact_hit THEN 'exact' WHEN n = 1 THEN 'prefix' ELSE 'ambiguous' END AS how FROM c WHERE exact_hit OR any_exact = 0""")
def _(spark, d):
    return L.by_prefix(table(spark, d, "supplier"), ["Supplier#000000001", "Supplier#00000001", "Supplier#00000009"], key="s_suppkey", name="s_name")
