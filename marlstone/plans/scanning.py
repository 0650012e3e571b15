"""Scanning queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import scanning as S
from marlstone.registry import portable, query, table

_RULE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, line_no, '{rule}' AS rule, {n} AS ord, line, unnest(regexp_extract_all(line, '{pattern}')) AS matched FROM l WHERE contains(line, '{word}')"
    for rule, n, word, pattern in S.RULES
)
FOUND = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS line_no FROM documents),
f0 AS ({_RULE_SQL}), f AS (SELECT doc_id, line_no, rule, ord, matched, instr(line, matched)::BIGINT AS start, instr(line, matched)::BIGINT + length(matched) AS stop FROM f0)"""
ENTROPY = "en AS (SELECT doc_id, line_no, rule, matched, -sum(p * log2(p)) AS entropy FROM (SELECT doc_id, line_no, rule, matched, ch, count(*) / length(matched)::DOUBLE AS p FROM (SELECT DISTINCT doc_id, line_no, rule, matched, unnest(range(1, length(matched) + 1)) AS i, substr(matched, i::INT, 1) AS ch FROM f) GROUP BY doc_id, line_no, rule, matched, ch) GROUP BY doc_id, line_no, rule, matched)"


def found(spark, d):
    return S.scan(table(spark, d, "documents"))


@query("k1_rule_scan", f"WITH {FOUND} SELECT doc_id, line_no, rule, matched FROM f")
def _(spark, d):
    return found(spark, d).select("doc_id", "line_no", "rule", "matched")


portable("k2_keyword_prefilter", "SELECT doc_id FROM {documents} WHERE contains(text, 'token') OR contains(text, '@') OR contains(text, 'icens')")


@query("k3_entropy", f"WITH {FOUND}, {ENTROPY} SELECT doc_id, line_no, rule, matched, round(entropy, 6) AS entropy FROM en WHERE rule = 'token' AND entropy >= 3.5")
def _(spark, d):
    rows = found(spark, d).where("rule = 'token'").select("doc_id", "line_no", "rule", "matched").distinct()
    return S.high_entropy(rows, least=3.5).withColumn("entropy", F.round("entropy", 6))


@query("k4_allowlist", f"WITH {FOUND} SELECT doc_id, line_no, rule, matched FROM f WHERE NOT (regexp_matches(matched, '^10[.]|mail0') OR contains(lower(matched), 'example.net'))")
def _(spark, d):
    return S.allowed(found(spark, d), words=["example.net"], pattern="^10[.]|mail0").select("doc_id", "line_no", "rule", "matched")


_PIECES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, line_no, '{rule}' AS rule, {n} AS ord, regexp_extract_all(line, '{pattern}') AS m, string_split_regex(line, '{pattern}') AS p FROM l WHERE contains(line, '{word}')"
    for rule, n, word, pattern in S.RULES
)
#: Each match at its own place: behind the pieces between matches and the matches before it.
PLACED = f"""{FOUND}, f1 AS ({_PIECES_SQL}),
f2 AS (SELECT doc_id, line_no, rule, ord, unnest(m) AS matched, unnest(list_transform(range(1, len(m) + 1), lambda j: 1 + list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0)))::BIGINT AS start FROM f1),
pl AS (SELECT *, start + length(matched) AS stop FROM f2)"""


@query("k5_span_dedup", f"WITH {PLACED} SELECT doc_id, line_no, rule, matched FROM pl a WHERE NOT EXISTS (SELECT 1 FROM pl b WHERE a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.ord < a.ord AND b.start < a.stop AND a.start < b.stop)")
def _(spark, d):
    return S.without_overlaps(found(spark, d)).select("doc_id", "line_no", "rule", "matched")


portable(
    "k6_inline_suppression",
    "SELECT event_id, CASE WHEN note LIKE '%allow: %' THEN 'suppressed' WHEN note LIKE '%allow%' THEN 'reason missing' ELSE 'active' END AS state FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('allow: ', event_type) WHEN event_id % 3 = 1 THEN 'allow' ELSE '' END AS note FROM {events})",
)


@query("k7_redaction", f"WITH {FOUND} SELECT doc_id, line_no, rule, CASE WHEN length(matched) <= 8 THEN '[hidden]' WHEN length(matched) < 20 THEN substr(matched, 1, 2) || '...' || right(matched, 2) ELSE substr(matched, 1, 4) || '...' || right(matched, 4) END AS matched FROM f")
def _(spark, d):
    return S.shown(found(spark, d)).select("doc_id", "line_no", "rule", "matched")


portable(
    "k8_confirmations",
    """WITH c AS (SELECT event_id % 500 AS finding, user_id FROM {events} WHERE event_type IN ('click', 'purchase') AND ts >= [[since]]),
    a AS (SELECT count(DISTINCT user_id) AS reviewers FROM {events} WHERE ts >= [[since]])
    SELECT finding, count(DISTINCT user_id) AS confirmations, count(DISTINCT user_id) >= min(least(3, reviewers)) AS confirmed FROM c, a GROUP BY finding""",
    since="TIMESTAMP_NTZ '2024-01-05 00:00:00' ~~ TIMESTAMP '2024-01-05 00:00:00'",
)


@query("k9_findings_merge", f"WITH {FOUND}, n AS (SELECT DISTINCT doc_id, line_no, rule FROM f), b AS (SELECT doc_id, line_no, rule, CASE WHEN doc_id % 3 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM n WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, -1, 'gone', CASE WHEN doc_id % 4 = 0 THEN 'dismissed' ELSE 'pending' END FROM (SELECT DISTINCT doc_id FROM n)) SELECT doc_id, line_no, rule, coalesce(b.status, 'pending') AS status FROM b FULL OUTER JOIN (SELECT *, true AS seen FROM n) n USING (doc_id, line_no, rule) WHERE seen OR b.status <> 'pending'")
def _(spark, d):
    now = found(spark, d).select("doc_id", "line_no", "rule").distinct()
    kept = now.where("doc_id % 2 = 0").withColumn("status", F.when(F.col("doc_id") % 3 == 0, "confirmed").otherwise("pending"))
    gone = now.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("bigint").alias("line_no"), F.lit("gone").alias("rule"), F.when(F.col("doc_id") % 4 == 0, "dismissed").otherwise("pending").alias("status"))
    return S.merged_findings(kept.unionByName(gone), now, keys=["doc_id", "line_no", "rule"])


@query("k10_gate", f"WITH {FOUND} SELECT source, count(*) FILTER (rule = 'token') > 0 AS blocked, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM f JOIN documents USING (doc_id) GROUP BY source")
def _(spark, d):
    rows = found(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.bool_or(F.col("rule") == "token").alias("blocked"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


portable(
    "k11_scan_cache",
    """WITH c AS (SELECT doc_id, [[sha]] AS digest FROM {documents} WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'other' ELSE [[sha]] END AS digest FROM {documents})
    SELECT n.doc_id FROM n [[anti]] c ON n.doc_id = c.doc_id AND n.digest = c.digest""",
    sha="sha2(text, 256) ~~ sha256(text)",
    anti="LEFT ANTI JOIN ~~ ANTI JOIN",
)
portable(
    "k12_jwt_expiry",
    "SELECT name, [[exp]] AS expires, [[exp]] < 1700000000 AS expired FROM (VALUES ('a', 'eyJleHAiOiAxNjAwMDAwMDAwfQ=='), ('b', 'eyJleHAiOiAxODAwMDAwMDAwfQ==')) AS j(name, claims)",
    exp="CAST(get_json_object(decode(unbase64(claims), 'UTF-8'), '$.exp') AS BIGINT) ~~ CAST(decode(from_base64(claims))::JSON ->> '$.exp' AS BIGINT)",
)


@query("k13_forbidden_content", f"WITH {FOUND} SELECT doc_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS reasons FROM f WHERE rule IN ('token', 'email', 'phone') GROUP BY doc_id")
def _(spark, d):
    rows = found(spark, d).where(F.col("rule").isin("token", "email", "phone"))
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("reasons"))
