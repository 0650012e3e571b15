"""Sources, sinks and chunking queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.text import token_estimate
from marlstone.operators import chunking as C
from marlstone.operators.markdown import markdown_chunks
from marlstone.registry import portable, query, table

# --- sources -------------------------------------------------------------------------------------------------------

portable(
    "a1_repo_walk",
    """SELECT doc_id, concat(source, '/', doc_id) AS path, n_chars FROM {documents}
    WHERE octet_length([[bytes]]) <= 20000 AND source <> 'src3'""",
    bytes="text ~~ encode(text)",
)
portable(
    "a2_include_prefixes",
    """SELECT p.page_id, p.url FROM {pages} p WHERE EXISTS (SELECT 1 FROM (VALUES ('https://'), ('http://blog.')) AS i(prefix) WHERE [[starts]](p.url, prefix))
    AND NOT EXISTS (SELECT 1 FROM (VALUES ('https://m.')) AS x(prefix) WHERE [[starts]](p.url, prefix))""",
    starts="startswith ~~ starts_with",
)


@query("a3_ledger_read", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def _(spark, d):
    from marlstone.sources.ledger import parsed

    return parsed(table(spark, d, "events"), "props", "k bigint").select("event_id", "k")


portable(
    "a4_rule_merge",
    """WITH f AS (SELECT * FROM (VALUES ('mail', '@', 3), ('phone', '+', 2), ('key', 'token', 5)) AS f(rule, pattern, level)),
    p AS (SELECT * FROM (VALUES ('key', CAST(NULL AS VARCHAR(9)), 9, false), ('phone', NULL, NULL, true), ('card', '49', 4, false)) AS p(rule, pattern, level, disabled))
    SELECT coalesce(f.rule, p.rule) AS rule, coalesce(p.pattern, f.pattern) AS pattern, CAST(coalesce(p.level, f.level) AS BIGINT) AS level
    FROM f FULL OUTER JOIN p ON f.rule = p.rule WHERE NOT coalesce(p.disabled, false)""",
)
portable("a5_filtered_scan", "SELECT vec_id, label FROM {embeddings} WHERE label = 3")
portable(
    "a6_postings",
    "SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, [[words]] AS term FROM {documents}) GROUP BY doc_id, term) GROUP BY term",
    words=r"explode(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0)) ~~ unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))",
)


@query("a7_graph_artifact", "SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem")
def _(spark, d):
    from marlstone.sources.artifacts import read_artifact, scratch, write_artifact

    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    path = scratch(spark, "graph")
    write_artifact(edges, path)
    return read_artifact(spark, path)


portable(
    "a8_state_store",
    """WITH u AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {events})
    SELECT user_id, event_type, event_id FROM u WHERE n = 1""",
)
portable("a9_list_files", "SELECT page_id, url FROM {pages} WHERE [[like]]", like=r"url rlike '^[^/]*//[^/]*/en/[^/]*\\.html$' ~~ regexp_matches(url, '^[^/]*//[^/]*/en/[^/]*\.html$')")
portable(
    "a10_read_range",
    "SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM (SELECT doc_id, [[lines]] FROM {documents}) WHERE pos BETWEEN [[range]]",
    lines=r"posexplode(split(text, '\n')) AS (pos, line) ~~ unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos",
    range="1 AND 3 ~~ 1 AND 3",
)
portable(
    "a11_status_table",
    "SELECT event_type, [[agg]] AS row_text FROM (SELECT event_type, user_id, count(*) AS n FROM {events} GROUP BY event_type, user_id) GROUP BY event_type",
    agg="array_join(transform(array_sort(collect_list(struct(user_id, n))), x -> concat(x.user_id, ':', x.n)), ' | ') ~~ string_agg(user_id || ':' || n, ' | ' ORDER BY user_id)",
)

# --- chunks --------------------------------------------------------------------------------------------------------


@query("b1_line_windows", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, (pos // 5)::BIGINT AS chunk, min(pos)::BIGINT + 1 AS first_line, max(pos)::BIGINT + 1 AS last_line, string_agg(line, chr(10) ORDER BY pos) AS text FROM l GROUP BY doc_id, pos // 5")
def _(spark, d):
    return C.line_windows(table(spark, d, "documents"), size=5)


@query("b2_sections", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), s AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, section::BIGINT AS section, min(pos)::BIGINT AS first_line, count(*) AS n_lines, max(CASE WHEN length(line) < 40 THEN line END) AS heading FROM s GROUP BY doc_id, section")
def _(spark, d):
    short = F.length("line") < 40
    return C.sections(C.line_rows(table(spark, d, "documents")), short).groupBy("doc_id", "section").agg(
        F.min("pos").cast("bigint").alias("first_line"), F.count("*").alias("n_lines"), F.max(F.when(short, F.col("line"))).alias("heading")
    )


@query("b2_markdown_chunks", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    m AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN '# ' WHEN length(line) < 40 THEN '## ' ELSE '- ' END || trim(line, ' .*%$&#|') AS line, trim(line, ' .*%$&#|') AS name, pos > 0 AND length(line) < 40 AS head FROM l),
    s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part, max(CASE WHEN pos = 0 THEN name END) OVER (PARTITION BY doc_id) AS title FROM m),
    c AS (SELECT doc_id, part, min(pos) AS first_line, max(pos) AS last_line, any_value(title) AS title, max(CASE WHEN head THEN name END) AS name, string_agg(line, chr(10) ORDER BY pos) AS body FROM s GROUP BY doc_id, part)
    SELECT doc_id, part::BIGINT AS chunk, 'doc' AS kind, array_to_string(list_filter([title, name], lambda x: x <> ''), ' > ') AS section, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line,
           sha256(CASE WHEN part = 0 OR title = '' THEN body ELSE '# ' || title || chr(10) || chr(10) || body END) AS digest FROM c""")
def _(spark, d):
    """Documents as Markdown: the first line is the title, short lines are sections, others are items."""
    marked = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.when(i == 0, "# ").when(F.length(line) < 40, "## ").otherwise("- "), F.trim(line, F.lit(" .*%$&#|"))))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(marked, "\n").alias("text"))
    return markdown_chunks(docs).withColumn("digest", F.sha2("text", 256)).drop("text")


@query("b3_oversize_split", "SELECT doc_id, part::BIGINT AS part, substr(text, (part * 1500 + 1)::INT, 1500) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 1499) // 1500))) AS part FROM documents)")
def _(spark, d):
    return C.oversize_split(table(spark, d, "documents"))


@query("b4_small_merge", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), s AS (SELECT *, sum(CASE WHEN length(line) >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l) SELECT doc_id, island::BIGINT AS island, sum(length(line))::BIGINT AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id, island")
def _(spark, d):
    rows = C.line_rows(table(spark, d, "documents"))
    return C.merge_small(rows.select("doc_id", F.col("pos").alias("chunk"), F.length("line").cast("bigint").alias("n_lines"), F.col("line").alias("text")), least=60)


portable(
    "b5_body_collapse",
    "SELECT doc_id, CASE WHEN n > 5 THEN concat([[first]], ' ... ', CAST(n AS [[str]]), ' lines ... ', [[last]]) ELSE text END AS text FROM (SELECT doc_id, text, [[lines]] AS l, [[n]] AS n FROM {documents})",
    lines=r"split(text, '\n') ~~ string_split(text, chr(10))",
    n=r"size(split(text, '\n')) ~~ len(string_split(text, chr(10)))",
    first="l[0] ~~ l[1]",
    last="l[n - 1] ~~ l[n]",
    str="string ~~ VARCHAR",
)
portable(
    "b6_summaries",
    "SELECT page_id, [[h1]] AS heading, [[p]] AS summary FROM {pages}",
    h1="regexp_extract(html, '<h1>([^<]*)</h1>', 1) ~~ regexp_extract(html, '<h1>([^<]*)</h1>', 1)",
    p="regexp_extract(html, '<p>([^<]+)</p>', 1) ~~ regexp_extract(html, '<p>([^<]+)</p>', 1)",
)
portable(
    "b7_value_redaction",
    "SELECT doc_id, [[r]] AS text FROM {documents} WHERE text LIKE '%token%'",
    r=r"""regexp_replace(text, '([a-z_]+) = "[^"]*"', '$1 = "[value]"') ~~ regexp_replace(text, '([a-z_]+) = "[^"]*"', '\1 = "[value]"', 'g')""",
)
portable("b8_notebook_cells", "SELECT conv_id, turn AS cell, role, length(text) AS n_chars FROM {conversations}".replace("length(text)", "CAST(length(text) AS BIGINT)"))


@query("b9_constants", """SELECT doc_id, (i - 1)::BIGINT AS position, split_part(found, ' = ', 1) AS name, regexp_extract(found, '"([^"]*)"', 1) AS value FROM
    (SELECT doc_id, generate_subscripts(f, 1) AS i, unnest(f) AS found FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_]+ = "[^"]*"') AS f FROM documents))""")
def _(spark, d):
    from marlstone.operators.lookup import constants

    return constants(table(spark, d, "documents"), "doc_id")


portable(
    "b10_markup",
    "SELECT page_id, trim([[strip]]) AS text FROM {pages}",
    strip="regexp_replace(html, '<[^>]*>', ' ') ~~ regexp_replace(html, '<[^>]*>', ' ', 'g')",
)


@query("b11_symbols")
def _(spark, d):
    from marlstone.operators.code import python_symbols
    from marlstone.plans.graph import sources

    return python_symbols(sources(spark))


portable("b12_chunk_hash", "SELECT doc_id, [[h]] AS chunk_hash FROM {documents}", h="sha2(concat_ws('\\u0001', lang, source, text), 256) ~~ sha256(concat_ws(chr(1), lang, source, text))")
portable(
    "b13_layer_routing",
    """SELECT doc_id, layer FROM (SELECT doc_id, 'docs' AS layer FROM {documents} WHERE lang = 'en' UNION ALL
    SELECT doc_id, 'code' AS layer FROM {documents} WHERE text LIKE '%token%' OR lang <> 'en')""",
)


@query("h1_token_estimate", "SELECT doc_id, ceil(octet_length(encode(text)) / 4)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))
