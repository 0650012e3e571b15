"""Change detection queries and their SQL. The two snapshots are slices of one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import graph_merge as M
from marlstone.operators import incremental as I
from marlstone.registry import portable, query, table

BEFORE = "b AS (SELECT doc_id, n_chars, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 3)"
AFTER = "a AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_chars, sha256(CASE WHEN doc_id % 14 = 0 THEN upper(text) ELSE text END) AS digest FROM documents WHERE doc_id % 10 <> 4)"


def snapshots(spark, d):
    docs = table(spark, d, "documents")
    before = docs.where("doc_id % 10 <> 3").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    text = F.when(F.col("doc_id") % 14 == 0, F.upper("text")).otherwise(F.col("text"))
    after = docs.where("doc_id % 10 <> 4").select(
        "doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("n_chars"), F.sha2(text, 256).alias("digest")
    )
    return before, after


@query("c1_change_detect", f"WITH {BEFORE}, {AFTER} SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.n_chars = b.n_chars OR a.digest = b.digest THEN 'unchanged' ELSE 'updated' END AS change FROM b FULL OUTER JOIN a ON a.doc_id = b.doc_id")
def _(spark, d):
    return I.changes(*snapshots(spark, d), key="doc_id", stat=["n_chars"], digest="digest")


@query("c2_layer_staleness", f"WITH {BEFORE}, {AFTER} SELECT a.doc_id, a.digest IS DISTINCT FROM b.digest AS stale FROM a LEFT JOIN b USING (doc_id)")
def _(spark, d):
    b, a = snapshots(spark, d)
    return a.alias("a").join(b.alias("b"), "doc_id", "left").select("doc_id", (~F.col("a.digest").eqNullSafe(F.col("b.digest"))).alias("stale"))


@query("c3_delta_plan", f"WITH {BEFORE}, {AFTER} SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.digest = b.digest THEN 'unchanged' ELSE 'changed' END AS plan, a.digest IS NOT NULL AND a.digest IN (SELECT digest FROM b) AS reuse FROM b FULL OUTER JOIN a ON a.doc_id = b.doc_id")
def _(spark, d):
    return I.delta_plan(*snapshots(spark, d), key="doc_id", digest="digest")


portable(
    "c4_convergence",
    """SELECT layer, CASE WHEN model_now <> model_then OR walker_now <> walker_then THEN 'full' WHEN chunker_now <> chunker_then THEN 'rechunk' ELSE 'incremental' END AS action
    FROM (VALUES ('docs', 2, 1, 1, 1, 1, 1), ('code', 1, 1, 1, 1, 3, 2), ('tests', 1, 1, 1, 1, 1, 1)) AS m(layer, model_now, model_then, walker_now, walker_then, chunker_now, chunker_then)""",
)
portable(
    "c5_orphan_retirement",
    """WITH gone AS (SELECT l.doc_id, l.quality FROM {labels} l [[anti]] (SELECT doc_id FROM {documents} WHERE doc_id % 9 <> 0) d ON l.doc_id = d.doc_id),
    r AS (SELECT CAST((SELECT count(*) FROM gone) AS DOUBLE) / (SELECT count(*) FROM {labels}) AS ratio)
    SELECT doc_id, CASE WHEN ratio > 0.5 THEN 'blocked' WHEN quality = 0 THEN 'preserve' ELSE 'remove' END AS action FROM gone, r""",
    anti="LEFT ANTI JOIN ~~ ANTI JOIN",
)
portable(
    "c6_reconcile",
    """SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM {documents} WHERE doc_id % 3 = 0 EXCEPT SELECT doc_id FROM {labels}) AS x
    UNION ALL SELECT 'extra' AS side, doc_id FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents} WHERE doc_id % 3 = 0) AS y""",
)
portable(
    "c7_build_epoch",
    """WITH o AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM {events})
    SELECT user_id, event_id, CASE WHEN was IS NULL THEN 'uninitialized' WHEN event_type = 'purchase' AND was = 'signup' THEN 'complete' ELSE 'building' END AS state FROM o""",
)


@query("c8_compaction", "SELECT count(*) AS n_rows, (count(*) + 4999) // 5000 AS n_files FROM events")
def _(spark, d):
    from marlstone.sources.artifacts import compacted, scratch

    out = scratch(spark, "compacted")
    compacted(table(spark, d, "events"), rows_a_file=5000).write.parquet(out)
    whole = spark.read.parquet(out)
    named = whole.select(F.input_file_name().alias("file"))
    return named.agg(F.count("*").alias("n_rows"), F.countDistinct("file").alias("n_files"))


portable(
    "c9_quiet_bursts",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN [[gap]] < 7200 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM {events})),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
    SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS n FROM s GROUP BY user_id, burst""",
    gap="coalesce(timestampdiff(SECOND, was, ts), 7200) ~~ coalesce(date_diff('microsecond', was, ts) // 1000000, 7200)",
)


@query("c10_incremental_graph", "SELECT l_suppkey AS owner, l_partkey AS target, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("target"))
    edges = items.groupBy("owner", "target").agg(F.count("*").alias("n"))
    old = edges.withColumn("n", F.when(F.col("owner") % 5 == 0, F.col("n") + 7).otherwise(F.col("n")))
    changed = edges.where("owner % 5 = 0").select("owner").distinct()
    return I.merged_edges(old, changed, edges.where("owner % 5 = 0"), owner="owner")


@query("c10_graph_merge", """WITH d AS (SELECT p_name || '#' || p_size AS symbol, p_partkey AS node FROM part), n AS (SELECT symbol, count(DISTINCT node) AS n, min(node) AS node FROM d GROUP BY symbol),
    r AS (SELECT DISTINCT 's' || l_suppkey AS file, p_name || '#' || p_size AS symbol FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT file, symbol, CASE WHEN n = 1 THEN node END AS target, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence FROM r LEFT JOIN n USING (symbol)""")
def _(spark, d):
    """Suppliers reference parts, brands define them. Stored is a graph where some brands had other names and every fifth supplier other references."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat_ws("#", "p_name", F.col("p_size").cast("string")).alias("symbol"), F.col("p_partkey").alias("node"))
    named = table(spark, d, "lineitem").join(part.select(F.col("node").alias("l_partkey"), "symbol"), "l_partkey")
    references = named.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"), "symbol").distinct()
    other = F.col("file").rlike("[13]$")
    old_name = F.when(other & (F.col("node") % 3 == 0), F.concat(F.lit("old "), "symbol")).when(other & (F.col("node") % 3 == 1), F.regexp_replace("symbol", "#.*", "#1")).otherwise(F.col("symbol"))
    late = F.pmod(F.xxhash64("file"), F.lit(5)) == 0
    stored = M.build(part.withColumn("symbol", old_name), references.where(~late | (F.xxhash64("symbol") % 2 == 0)))
    changed = part.where(other).select("file").unionByName(references.where(late).select("file"))
    return M.merge(stored, changed, part.where(other), references.where(late))[0].edges


portable(
    "c11_fingerprint",
    "SELECT [[sha]] AS fingerprint FROM {nation}",
    sha="sha2(array_join(sort_array(collect_list(concat(n_nationkey, ':', n_name, ':', n_regionkey))), '|'), 256) ~~ sha256(string_agg(n_nationkey || ':' || n_name || ':' || n_regionkey, '|' ORDER BY n_nationkey || ':' || n_name || ':' || n_regionkey))",
)


@query("c11_table_fingerprint", "SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag)), 1, 12))::BIGINT)::VARCHAR AS digest FROM lineitem")
def _(spark, d):
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")]).cast("binary"))
    out = I.fingerprint(table(spark, d, "lineitem"), F.conv(F.substring(row, 1, 12), 16, 10))
    return out.select("n", F.col("digest").cast("string").alias("digest"))


@query("c12_index_health", "SELECT lang AS layer, CASE WHEN count(*) = 0 THEN 'absent' WHEN count(*) FILTER (n_chars < 10) > 0 THEN 'degraded' WHEN count(*) FILTER (doc_id % 97 = 0) > 0 THEN 'needs_update' ELSE 'ready' END AS health FROM documents GROUP BY lang")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 97 == 0).alias("stale"), F.count_if(F.col("n_chars") < 10).alias("missing"))
    return g.select(F.col("lang").alias("layer"), I.health(F.col("n"), F.col("stale"), F.col("missing")).alias("health"))
