"""Ranked retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.functions.vectors import dot
from marlstone.operators import lookup as L
from marlstone.operators.chunking import line_windows
from marlstone.operators.collapse import collapsed
from marlstone.operators import postings as P
from marlstone.operators import retrieval as R
from marlstone.operators.vector_index import build_index, search_index
from marlstone.registry import portable, query, table
from marlstone.sources.artifacts import scratch

QUESTIONS = [(1, "the general public license"), (2, "where is the thing defined in that"), (3, "how to install nicht und der")]
QUESTION_SQL = "(VALUES (1, 'the general public license'), (2, 'where is the thing defined in that'), (3, 'how to install nicht und der')) AS q(qid, text)"


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid int, text string")


TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
BM25_SQL = rf"""
w AS (SELECT doc_id, {TOKENS_SQL} AS l FROM documents),
st AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM w),
qt AS (SELECT DISTINCT qid, unnest({TOKENS_SQL}) AS term FROM {QUESTION_SQL}),
pt AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(l) AS dl, unnest(l) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
sc AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
       FROM pt JOIN df USING (term) JOIN qt USING (term), st GROUP BY qid, doc_id),
rk AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
"""
def best() -> list:
    return [F.round("score", 9).desc(), F.col("doc_id")]



def ranked(spark, d, n=20):
    return R.top_n(R.bm25(table(spark, d, "documents"), questions(spark)), n, by=best())


@query("f3_tokens", f"SELECT doc_id, len({TOKENS_SQL})::BIGINT AS n_tokens, len(list_distinct({TOKENS_SQL}))::BIGINT AS n_distinct FROM documents")
def _(spark, d):
    t = tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query("f4_bm25", f"WITH {BM25_SQL} SELECT qid, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 20")
def _(spark, d):
    return ranked(spark, d).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("f4_bm25_index", f"WITH {BM25_SQL} SELECT qid, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 20")
def _(spark, d):
    """The same from persisted postings of two segments."""
    return P.search(spark, postings_index(spark, d), questions(spark), 20).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def postings_index(spark, d):
    path, docs = scratch(spark, "postings"), table(spark, d, "documents")
    P.add_segment(docs.where("lang = 'en'"), path)
    P.add_segment(docs.where("lang is null or lang != 'en'"), path)
    return path


@query("a6_postings_index", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term")
def _(spark, d):
    path = postings_index(spark, d)
    P.merge_segments(spark, path)
    return P.term_totals(spark, path)


VECTORS_SQL = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
c AS (SELECT a.vec_id AS qid, b.vec_id, b.label, a.label AS own, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score
      FROM v a, v b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM c WHERE score >= 0)
"""


def nearest(spark, d, k=30):
    v = table(spark, d, "embeddings")
    return R.vector_top_k(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), k)


@query("f1_vector_search", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], e) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e, e))) AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY round(score, 9) DESC, vec_id LIMIT 20")
def _(spark, d):
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    s = v.crossJoin(F.broadcast(q)).select("vec_id", (dot(F.col("embedding"), F.col("q")) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("q"), F.col("q"))))).alias("score"))
    return s.where("score >= 0").orderBy(F.round("score", 9).desc(), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


@query("f2_vector_top_k", f"WITH {VECTORS_SQL} SELECT qid, vec_id, round(score, 6) AS score, rank FROM k WHERE rank <= 30")
def _(spark, d):
    return nearest(spark, d).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("f2_ann_top_k")
def _(spark, d):
    """The same from an inverted file; tests measure its recall against the exact rows."""
    v = table(spark, d, "embeddings")
    path = scratch(spark, "vector-index")
    build_index(v, path)
    return search_index(spark, path, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 20).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


LENGTH_SQL = "ln_ AS (SELECT q.qid, doc_id, row_number() OVER (PARTITION BY q.qid ORDER BY n_chars DESC, doc_id) AS rank FROM documents, (SELECT DISTINCT qid FROM qt) q WHERE contains(text, 'the'))"


def by_length(spark, d):
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("the"))).orderBy(F.col("n_chars").desc(), "doc_id").limit(30).select("doc_id", "n_chars")
    return R.top_n(docs.crossJoin(F.broadcast(questions(spark).select("qid"))), 30, by=[F.col("n_chars").desc(), F.col("doc_id")])


@query("f5_rank_fusion", f"WITH {BM25_SQL}, {LENGTH_SQL}, u AS (SELECT qid, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM rk WHERE rank <= 20 UNION ALL SELECT qid, doc_id, 1.5::DOUBLE / (60 + rank) FROM ln_ WHERE rank <= 30) SELECT qid, doc_id, round(sum(p), 9) AS score FROM u GROUP BY qid, doc_id")
def _(spark, d):
    return R.fuse([(ranked(spark, d), 1.0), (by_length(spark, d), 1.5)]).withColumn("score", F.round("score", 9))


@query("f6_hybrid_pool", f"WITH {BM25_SQL}, {LENGTH_SQL}, u AS (SELECT qid, doc_id, 'lexical' AS s FROM rk WHERE rank <= 20 UNION SELECT qid, doc_id, 'length' FROM ln_ WHERE rank <= 30) SELECT qid, doc_id, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY qid, doc_id")
def _(spark, d):
    return R.pool([(ranked(spark, d), "lexical"), (by_length(spark, d), "length")])


OVERLAP_SQL = f"ov AS (SELECT rk.qid, rk.doc_id, rk.rank, rk.score, len(list_intersect({TOKENS_SQL.replace('text', 'documents.text')}, qw.l))::DOUBLE / len(list_distinct(qw.l)) AS overlap FROM rk JOIN documents USING (doc_id) JOIN (SELECT qid, {TOKENS_SQL} AS l FROM {QUESTION_SQL}) qw USING (qid) WHERE rank <= 20)"


def overlapped(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", tokens(F.col("text")).alias("words"))
    asked = questions(spark).select("qid", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    both = docs.join(F.broadcast(ranked(spark, d)), "doc_id").join(F.broadcast(asked), "qid")
    return both.withColumn("overlap", F.size(F.array_intersect("words", "asked")) / F.size("asked"))


@query("f7_rerank", f"WITH {BM25_SQL}, {OVERLAP_SQL} SELECT qid, doc_id, round(1 / (1 + exp(-(4 * overlap - 2))), 6) AS relevance FROM ov")
def _(spark, d):
    return overlapped(spark, d).select("qid", "doc_id", F.round(1 / (1 + F.exp(-(4 * F.col("overlap") - 2))), 6).alias("relevance"))


TYPE_SQL = r"CASE WHEN regexp_matches(lower(text), '\b(where|which file|find|locate|defined)\b') THEN 'navigational' WHEN regexp_matches(lower(text), '\b(how do i|how to|steps|set up|install|configure)\b') THEN 'instructional' ELSE 'explanatory' END"


@query("f8_question_type", f"SELECT text, {TYPE_SQL} AS kind FROM (SELECT text FROM {QUESTION_SQL} UNION ALL SELECT text FROM conversations WHERE role = 'user')")
def _(spark, d):
    asked = questions(spark).select("text").unionByName(table(spark, d, "conversations").where("role = 'user'").select("text"))
    return asked.select("text", R.question_type(F.col("text")).alias("kind"))


portable(
    "f9_type_demotion",
    "SELECT doc_id, source, round(n_chars * coalesce(w, 1.0), 4) AS score FROM {documents} LEFT JOIN (VALUES ('src0', 0.6), ('src1', 0.75), ('src2', 0.5)) AS d(src, w) ON source = src",
)


@query("f10_definition_boost", r"WITH n AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part), q AS (SELECT list_distinct(string_split('where is the small ring or red widget defined', ' ')) AS a) SELECT p_partkey, CASE WHEN len(t) >= 2 AND len(list_filter(t, lambda x: NOT list_contains(a, x))) = 0 THEN 1.3 ELSE 1.0 END::DOUBLE AS boost FROM n, q")
def _(spark, d):
    asked = F.array(*[F.lit(w) for w in ("where", "is", "the", "small", "ring", "or", "red", "widget", "defined")])
    names = F.array_distinct(F.split(F.lower("p_name"), " "))
    hit = (F.size(names) >= 2) & (F.size(F.array_except(names, asked)) == 0)
    return table(spark, d, "part").select("p_partkey", F.when(hit, 1.3).otherwise(1.0).alias("boost"))


portable(
    "f11_rule_injection",
    """WITH r AS (SELECT * FROM (VALUES ('license', 'license'), ('mail', 'example')) AS r(word, longest)),
    h AS (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS n FROM {documents}, r WHERE contains(lower(text), longest))
    SELECT word, doc_id, 0.0 AS score FROM h WHERE n <= 5""".replace("0.0 AS", "CAST(0 AS DOUBLE) AS"),
)


@query("f12_candidate_select", f"WITH {BM25_SQL}, t AS (SELECT qid, doc_id, rank, score, max(score) OVER (PARTITION BY qid) AS top, n_chars, source, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS own FROM rk JOIN documents USING (doc_id) WHERE rank <= 40), k AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE own <= 3 AND score >= 0.85 * top) SELECT qid, doc_id, rank FROM k WHERE before < 16000")
def _(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    t = docs.join(F.broadcast(ranked(spark, d, 40)), "doc_id")
    by_q = Window.partitionBy("qid")
    t = t.withColumn("top", F.max("score").over(by_q)).withColumn("own", F.row_number().over(Window.partitionBy("qid", "source").orderBy("rank")))
    k = t.where((F.col("own") <= 3) & (F.col("score") >= 0.85 * F.col("top")))
    before = F.sum("n_chars").over(by_q.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return k.withColumn("before", F.coalesce(before, F.lit(0))).where("before < 16000").select("qid", "doc_id", "rank")


@query("f12_greedy_budget")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars").join(F.broadcast(ranked(spark, d, 40)), "doc_id")
    return R.greedy_budget(t.select("qid", "doc_id", "rank", "n_chars"), budget=16_000, key="doc_id", size="n_chars")


portable(
    "f13_collapse",
    "SELECT sha256_ AS digest, min(doc_id) AS doc_id, count(*) AS copies, [[agg]] AS sources FROM (SELECT [[sha]] AS sha256_, doc_id, source FROM {documents}) GROUP BY sha256_",
    sha="sha2(lower(text), 256) ~~ sha256(lower(text))",
    agg="array_join(array_sort(collect_set(source)), ',') ~~ string_agg(DISTINCT source, ',' ORDER BY source)",
)
@query("f14_stable_partition", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang <> 'en' THEN 1 ELSE 0 END, n_chars DESC, doc_id) AS place FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    other = F.when(F.col("lang") != "en", 1).otherwise(0)
    return L.ranked(docs, other, F.col("n_chars").desc(), F.col("doc_id"), within=("source",)).select("doc_id", "place")


@query("f15_drift_partition", """WITH t AS (SELECT d.doc_id, d.source, d.n_chars, coalesce(l.quality, 1) = 0 AS drifted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    b AS (SELECT *, max(CASE WHEN NOT drifted THEN n_chars END) OVER (PARTITION BY source) AS fresh FROM t)
    SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN drifted AND fresh >= 0.8 * n_chars THEN 1 ELSE 0 END, n_chars DESC, doc_id) AS place FROM b""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    told = docs.withColumn("drifted", F.coalesce("quality", F.lit(1)) == 0)
    fresh = told.where("NOT drifted").groupBy("source").agg(F.max("n_chars").alias("fresh"))
    late = F.when(F.col("drifted") & (F.col("fresh") >= 0.8 * F.col("n_chars")), 1).otherwise(0)
    return L.ranked(told.join(fresh, "source", "left"), late, F.col("n_chars").desc(), F.col("doc_id"), within=("source",)).select("doc_id", "place")


@query("f16_two_hop", f"WITH {BM25_SQL}, s AS (SELECT DISTINCT word FROM (SELECT unnest(l) AS word FROM w WHERE doc_id IN (SELECT doc_id FROM rk WHERE qid = 1 AND rank <= 3)) WHERE length(word) >= 4 AND word NOT IN ('with', 'that') ORDER BY word LIMIT 5), h AS (SELECT word, doc_id FROM documents, s WHERE contains(text, word)) SELECT DISTINCT doc_id FROM h WHERE doc_id NOT IN (SELECT doc_id FROM rk WHERE qid = 1 AND rank <= 3) ORDER BY doc_id LIMIT 10")
def _(spark, d):
    docs = table(spark, d, "documents")
    first = F.broadcast(ranked(spark, d, 3).where("qid = 1").select("doc_id"))
    words = docs.join(first, "doc_id", "left_semi").select(F.explode(tokens(F.col("text"))).alias("word"))
    names = words.where((F.length("word") >= 4) & ~F.col("word").isin("with", "that")).distinct().orderBy("word").limit(5)
    hits = docs.select("doc_id", "text").join(F.broadcast(names), F.contains("text", F.col("word"))).join(first, "doc_id", "left_anti")
    return hits.select("doc_id").distinct().orderBy("doc_id").limit(10)


CONF_SQL = "CASE WHEN max(overlap) < 0.1 THEN 'low' WHEN max(overlap) >= 0.5 AND count(*) FILTER (overlap >= 0.5) >= 2 THEN 'high' ELSE 'medium' END"


@query("f17_confidence", f"WITH {BM25_SQL}, {OVERLAP_SQL} SELECT qid, {CONF_SQL} AS confidence FROM ov GROUP BY qid")
def _(spark, d):
    g = overlapped(spark, d).groupBy("qid").agg(F.max("overlap").alias("s"), F.count_if(F.col("overlap") >= 0.5).alias("n"))
    return g.select("qid", R.confidence(F.col("s"), F.col("n")).alias("confidence"))


portable(
    "f18_degradation",
    """WITH have AS (SELECT (SELECT count(*) FROM {embeddings}) > 0 AS vectors, (SELECT count(*) FROM {documents}) > 0 AS lexical)
    SELECT CASE WHEN vectors THEN 'semantic' WHEN lexical THEN 'lexical' ELSE 'unavailable' END AS search_mode FROM have""",
)


@query("f19_weak", f"WITH {BM25_SQL}, {OVERLAP_SQL} SELECT qid, max(overlap) < 0.5 AS weak, CASE WHEN max(overlap) < 0.5 THEN 'no passage above the floor' END AS gap FROM ov GROUP BY qid")
def _(spark, d):
    g = overlapped(spark, d).groupBy("qid").agg((F.max("overlap") < 0.5).alias("weak"))
    return g.select("qid", "weak", F.when(F.col("weak"), "no passage above the floor").alias("gap"))


portable(
    "f20_graph_citations",
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM {lineitem}),
    n AS (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY t) AS k FROM e),
    c AS (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY t) AS m FROM n WHERE k <= 3 AND t NOT IN (SELECT p_partkey FROM {part} WHERE p_size > 40))
    SELECT s, t FROM c WHERE m <= 2""",
)
portable(
    "f21_freshness",
    """WITH f AS (SELECT user_id, max(ts) AS last, count(*) AS churn FROM {events} GROUP BY user_id)
    SELECT doc_id, last AS last_modified, churn FROM {documents} LEFT JOIN f ON doc_id = user_id""",
)


@query("f13_collapse_hits")
def _(spark, d):
    """Candidates of two retrievers, cut into overlapping windows of lines, as hits: tests hold them against brute force."""
    found = ranked(spark, d).select("qid", "doc_id", "rank", F.lit("lexical").alias("source")).unionByName(by_length(spark, d).select("qid", "doc_id", "rank", F.lit("length").alias("source")))
    docs = table(spark, d, "documents").join(R.small(found.select("doc_id").distinct()), "doc_id", "left_semi")
    hits = line_windows(docs, size=12, overlap=4).join(found, "doc_id")
    name = F.concat_ws(":", "qid", "source", "doc_id", "chunk")
    return collapsed(hits.select("qid", name.alias("id"), F.col("doc_id").alias("file"), F.col("first_line").alias("first"), F.col("last_line").alias("last"), F.lit(None).cast("string").alias("symbol"), "text", "source", "rank"))


@query("f22_retrieval_metrics", f"WITH {VECTORS_SQL}, r AS (SELECT qid, rank, CASE WHEN label = own THEN 1 ELSE 0 END AS rel FROM k WHERE rank <= 11 AND vec_id <> qid) SELECT qid, sum(rel)::BIGINT AS hits, round(coalesce(max(rel / rank), 0), 6) AS mrr, round(sum(rel / log2(1 + rank)), 6) AS dcg FROM r GROUP BY qid")
def _(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", "label")
    n = nearest(spark, d, 11).where("qid != vec_id").join(own, "vec_id").join(own.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    rel = F.when(F.col("label") == F.col("own"), 1).otherwise(0)
    return n.groupBy("qid").agg(F.sum(rel).alias("hits"), F.round(F.max(rel / F.col("rank")), 6).alias("mrr"), F.round(F.sum(rel / F.log2(1 + F.col("rank"))), 6).alias("dcg"))


@query("q_ask", f"WITH {BM25_SQL}, {OVERLAP_SQL} SELECT qid, doc_id, round(overlap * CASE WHEN source = 'src0' THEN 0.6 ELSE 1.0 END, 6) AS score, CASE WHEN qid = 2 THEN 'navigational' WHEN qid = 3 THEN 'instructional' ELSE 'explanatory' END AS kind, max(overlap) OVER (PARTITION BY qid) < 0.5 AS weak FROM ov JOIN documents USING (doc_id)")
def _(spark, d):
    from pyspark.sql import Window

    scored = overlapped(spark, d).join(F.broadcast(questions(spark)), "qid")
    weight = F.when(F.col("source") == "src0", 0.6).otherwise(1.0)
    return scored.select("qid", "doc_id", F.round(F.col("overlap") * weight, 6).alias("score"), R.question_type(F.col("text")).alias("kind"), (F.max("overlap").over(Window.partitionBy("qid")) < 0.5).alias("weak"))
