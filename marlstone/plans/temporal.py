"""Freshness, drift and memory queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import freshness as R
from marlstone.operators.lookup import ranked, running_total
from marlstone.registry import portable, query, table


SINCE = "TIMESTAMP_NTZ '2024-01-20 00:00:00' ~~ TIMESTAMP '2024-01-20 00:00:00'"


def since():
    return F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


@query("i1_file_freshness", """WITH f AS (SELECT user_id, max(ts) AS last_modified, sum(CASE WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 0 END) AS n FROM events GROUP BY user_id)
    SELECT user_id, last_modified, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS churn FROM f""")
def _(spark, d):
    return R.churn(table(spark, d, "events"), "user_id", "ts", since=since())


portable(
    "i2_commits_since",
    """WITH a AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN ts END) AS anchor FROM {events} GROUP BY user_id)
    SELECT e.user_id, count(DISTINCT e.event_id) AS commits_since FROM {events} e JOIN a ON e.user_id = a.user_id WHERE e.ts > a.anchor GROUP BY e.user_id""",
)


@query("i3_drift", """WITH a AS (SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase') > 0 THEN max(ts) FILTER (event_type IN ('signup', 'purchase')) END AS anchor FROM events GROUP BY user_id),
    c AS (SELECT a.user_id, sum(CASE WHEN e.ts > a.anchor THEN 1 ELSE 0 END) AS n FROM a JOIN events e ON e.user_id = a.user_id GROUP BY a.user_id)
    SELECT user_id, CAST(n AS BIGINT) AS commits_since, n >= 3 AND user_id % 11 <> 0 AS drifted FROM c""")
def _(spark, d):
    at = lambda k: F.when(F.col("event_type") == k, F.col("ts"))
    return R.drift(table(spark, d, "events"), "user_id", "ts", anchors=[at("signup"), at("purchase")], historical=F.col("user_id") % 11 == 0)


portable(
    "i4_waves_behind",
    """WITH p AS (SELECT DISTINCT l_orderkey AS w, l_partkey AS f FROM {lineitem})
    SELECT a.w, count(DISTINCT b.w) AS behind FROM p a JOIN p b ON a.f = b.f AND b.w > a.w GROUP BY a.w""",
)


@query("i5_drift_worklist", "SELECT user_id, count(*) AS commits_since, row_number() OVER (ORDER BY count(*) DESC, user_id)::INT AS place FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id")
def _(spark, d):
    late = table(spark, d, "events").where(F.col("ts") >= since()).groupBy("user_id").agg(F.count("*").alias("commits_since"))
    return ranked(late, F.col("commits_since").desc(), F.col("user_id"))


@query("i6_half_life", """WITH k AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events),
    g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0::DOUBLE AS days FROM k WHERE place <= 40),
    m AS (SELECT user_id, count(*) AS n, median(days) AS mid FROM g GROUP BY user_id)
    SELECT user_id, CASE WHEN n < 5 THEN 30::DOUBLE ELSE round(least(365::DOUBLE, greatest(30::DOUBLE, 60 * mid)), 4) END AS half_life FROM m""")
def _(spark, d):
    out = R.half_life(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", times=60.0)
    return out.select("user_id", F.round("half_life", 4).alias("half_life"))


@query("i7_policy_order", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN toxic = 0 THEN 0 ELSE 1 END, quality DESC, doc_id % 6, doc_id % 8, doc_id)::INT AS place FROM labels")
def _(spark, d):
    policy = F.when(F.col("toxic") == 0, 0).otherwise(1)
    return ranked(table(spark, d, "labels").select("doc_id", "toxic", "quality"), policy, F.col("quality").desc(), F.col("doc_id") % 6, F.col("doc_id") % 8, F.col("doc_id")).select("doc_id", "place")


@query("i8_duplicates", """WITH k AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS summary, regexp_extract_all(text, '[0-9a-f]{40}|[a-z0-9.]+@[a-z0-9.]+') AS refs FROM documents),
    s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, summary) AS first_key FROM k),
    r AS (SELECT DISTINCT doc_id, unnest(refs) AS ref FROM k), t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ref) AS first_key FROM r)
    SELECT doc_id, first_key, 'equal summary' AS reason FROM s WHERE doc_id <> first_key
    UNION ALL SELECT doc_id, min(first_key), 'shared evidence' FROM t WHERE doc_id <> first_key GROUP BY doc_id""")
def _(spark, d):
    """Evidence of a document: the keys and mail addresses that it names."""
    docs = table(spark, d, "documents").withColumn("refs", F.regexp_extract_all("text", F.lit("[0-9a-f]{40}|[a-z0-9.]+@[a-z0-9.]+"), F.lit(0)))
    return R.duplicates(docs, "doc_id", summary="text", groups=["lang"], evidence="refs")


portable(
    "i9_consolidation",
    """WITH t AS (SELECT l_orderkey, [[agg]] AS targets FROM (SELECT DISTINCT l_orderkey, l_suppkey % 10 AS t FROM {lineitem}) x GROUP BY l_orderkey)
    SELECT targets, count(*) AS n, min(l_orderkey) AS first_order FROM t GROUP BY targets HAVING count(*) > 1""",
    agg="array_join(array_sort(collect_list(t)), ',') ~~ string_agg(t::VARCHAR, ',' ORDER BY t)",
)
portable("i10_active_budget", "SELECT user_id % 10 AS lane, count(*) AS active, CAST(greatest(0, 1000 - count(*)) AS BIGINT) AS remaining, count(*) > 1000 AS curate FROM {events} WHERE event_type <> 'error' GROUP BY user_id % 10")
portable("i11_proposals", "SELECT d.doc_id FROM {documents} d [[anti]] {labels} l ON d.doc_id = l.doc_id WHERE d.n_chars > 1000", anti="LEFT ANTI JOIN ~~ ANTI JOIN")
@query("i12_backfill_paging", """WITH c AS (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, source FROM documents)
    SELECT doc_id, source, CAST(floor((upto - 1) / 65536) AS BIGINT) AS batch FROM c""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    upto = running_total(docs, "n_chars", F.col("doc_id"), within=("source",))
    return upto.select("doc_id", "source", F.floor((F.col("upto") - 1) / 65536).cast("bigint").alias("batch"))


@query("i13_eval_gate", "WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, n >= 30 AS passed FROM g")
def _(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", "n", (F.col("n") >= 30).alias("passed"))


@query("i14_lifecycle_mint")
def _(spark, d):
    from marlstone.operators.lifecycle import minted

    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return minted(orders, key="o_orderkey", day="o_orderdate")


@query("i14_minted_slots", """WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', (date_trunc('month', o_orderdate))::DATE) * 4096 + 60000000 + ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 3))::BIGINT AS own FROM orders),
    p AS (SELECT o_orderkey, own, row_number() OVER (ORDER BY own, o_orderkey) AS place FROM o)
    SELECT o_orderkey, (max(own - place) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) + place)::BIGINT AS number FROM p""")
def _(spark, d):
    """Ids of orders by month, hashed as both engines can."""
    from marlstone.operators.lifecycle import minted

    orders = table(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("month"))
    hashed = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 3), 16, 10)
    return minted(orders, key="o_orderkey", day="month", hashed=hashed).select("o_orderkey", "number")


@query("i13_rank_gate", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.vec_id AS qid, b.vec_id, a.label = b.label AS rel, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS c FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    k AS (SELECT qid, vec_id, rel, row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) AS n FROM s WHERE c >= 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS o FROM k WHERE n <= 20),
    q AS (SELECT qid, max((rel AND n <= 3)::INT)::DOUBLE AS hit, coalesce(max(1.0::DOUBLE / n) FILTER (rel), 0) AS rr, max((rel AND o <= 3)::INT)::DOUBLE AS hit_o, coalesce(max(1.0::DOUBLE / o) FILTER (rel), 0) AS rr_o FROM r GROUP BY qid),
    m AS (SELECT avg(hit) AS recall, avg(rr) AS mrr, avg(hit_o) AS recall_o, avg(rr_o) AS mrr_o FROM q)
    SELECT round(recall, 6) AS recall, round(mrr, 6) AS mrr, recall >= recall_o AND mrr > mrr_o AS passed FROM m""")
def _(spark, d):
    """May the ranking of the 20 nearest by cosine replace that by id? Recall at 3 and mean reciprocal rank of both."""
    from marlstone.operators import retrieval

    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("own"))
    order = [F.round("score", 9).desc(), F.col("vec_id")]
    near = retrieval.vector_top_k(v, asked.select("qid", "embedding"), 21).where("qid != vec_id").drop("rank")
    near = retrieval.top_n(near, 20, by=order).drop("rank")
    near = near.join(v.select("vec_id", "label"), "vec_id").join(asked.select("qid", "own"), "qid").select("qid", "vec_id", "score", (F.col("label") == F.col("own")).alias("rel"))
    told = lambda *by: R.recall_and_mrr(retrieval.top_n(near, 20, by=list(by), rank="place"), "qid", relevant=F.col("rel"), place="place")
    gate = R.eval_gate(told(*order), told(F.col("vec_id")), invariants=F.lit(True))
    return gate.select(F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "passed")


@query("i15_decoded_order", "SELECT doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY CAST(substr(source, 4) AS BIGINT), doc_id) AS place FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return ranked(docs, F.substring("source", 4, 1 << 30).cast("bigint"), F.col("doc_id"), within=("lang",)).drop("lang")
