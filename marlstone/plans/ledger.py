"""Ledger and accounting queries. `events` is the ledger: user = wave, event type = stage, props.k = size."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import accounts as A
from marlstone.registry import portable, query, table

E = "(SELECT event_id, user_id, event_type, ts, value, [[k]] AS k FROM {events})"
K = "CAST(get_json_object(props, '$.k') AS BIGINT) ~~ CAST(props::JSON ->> '$.k' AS BIGINT)"

#: The ledger in SQL.
LEDGER = "(SELECT event_id, user_id, event_type, ts, value, CAST(props::JSON ->> '$.k' AS BIGINT) AS k FROM events)"


def ledger(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def kind(*names):
    return F.col("event_type").isin(*names)


def paid(*names):
    return F.when(kind(*names), F.col("k")).otherwise(0)


@query("h2_closed_ledger", f"""WITH t AS (SELECT user_id, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN k ELSE 0 END) AS credit, sum(CASE WHEN event_type IN ('view', 'error') THEN k ELSE 0 END) AS debit FROM {LEDGER} e GROUP BY user_id)
    SELECT user_id, CAST(credit AS BIGINT) AS credit, CAST(debit AS BIGINT) AS debit, CAST(greatest(0, credit - debit) AS BIGINT) AS saved FROM t
    UNION ALL SELECT NULL, CAST(sum(credit) AS BIGINT), CAST(sum(debit) AS BIGINT), CAST(greatest(0, sum(credit) - sum(debit)) AS BIGINT) FROM t""")
def _(spark, d):
    return A.closed_ledger(ledger(spark, d), "user_id", credit=paid("purchase", "signup"), debit=paid("view", "error"))


@query("h3_once_only_credit", f"SELECT user_id, event_type, k, min(event_id) AS event_id FROM {LEDGER} e GROUP BY user_id, event_type, k")
def _(spark, d):
    return A.once_only(ledger(spark, d), "user_id", "event_type", "k", event="event_id")


portable(
    "h4_replay_protection",
    "SELECT event_id, min(user_id) AS user_id, count(*) AS seen FROM (SELECT event_id, user_id FROM {events} UNION ALL SELECT event_id, user_id FROM {events} WHERE event_id % 10 = 0) AS u GROUP BY event_id",
)


@query("h5_credit_cap", f"""WITH i AS (SELECT event_type, user_id, k, min(event_id) AS first_event FROM {LEDGER} e GROUP BY event_type, user_id, k), r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY first_event) AS n FROM i)
    SELECT event_type, CAST(sum(CASE WHEN n <= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS credited, CAST(sum(CASE WHEN n > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM r GROUP BY event_type""")
def _(spark, d):
    return A.credit_cap(ledger(spark, d), "event_type", "user_id", "k", cap=1000)


@query("h6_stage_attribution", """WITH f AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'purchase' THEN 'implement' WHEN 'view' THEN 'review' END AS focus, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS step FROM events),
    o AS (SELECT a.event_id, a.user_id, a.ts, sum(a.step) OVER w AS open_now, max(CASE WHEN a.focus IS NOT NULL THEN (a.ts, a.event_id) END) OVER w AS at FROM f a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT o.event_id, coalesce(f.focus, CASE WHEN open_now = 1 THEN 'open wave' END, 'general') AS stage FROM o LEFT JOIN f ON f.user_id = o.user_id AND (f.ts, f.event_id) = o.at""")
def _(spark, d):
    focus = F.when(kind("signup"), "plan").when(kind("purchase"), "implement").when(kind("view"), "review")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return A.attributed(events, "user_id", "ts", "event_id", focus=focus, opens=kind("click"), closes=kind("error")).select("event_id", "stage")


portable(
    "h7_adoption",
    f"""WITH m AS (SELECT CASE WHEN user_id % 10 = 0 THEN user_id + 1 ELSE user_id END AS owner, event_type, k, event_id FROM {E} e)
    SELECT owner, event_type, k, min(event_id) AS event_id FROM m GROUP BY owner, event_type, k""",
    k=K,
)


@query("h8_seal_floor", f"SELECT user_id, CAST(sum(CASE WHEN event_id < 5000 THEN k ELSE 0 END) AS BIGINT) AS floor_sum, CAST(sum(CASE WHEN event_id >= 5000 THEN k ELSE 0 END) AS BIGINT) AS later, CAST(sum(k) AS BIGINT) AS total FROM {LEDGER} e GROUP BY user_id")
def _(spark, d):
    return A.sealed_floor(ledger(spark, d), "user_id", amount=F.col("k"), sealed=F.col("event_id") < 5000)


portable(
    "h9_paired_residual",
    """WITH p AS (SELECT l_orderkey AS pair_id, l_suppkey % 10 AS arm, greatest(0, max(l_extendedprice) - min(l_extendedprice) - sum(l_quantity)) AS residual FROM {lineitem} GROUP BY l_orderkey, l_suppkey % 10 HAVING count(*) >= 2)
    SELECT arm, count(*) AS pairs, round(min(residual), 4) AS residual FROM p GROUP BY arm HAVING count(*) >= 5""",
)


@query("h10_exploration_credit", f"""WITH c AS (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 0.5::DOUBLE * k ELSE 0 END) AS seen, sum(CASE WHEN event_type = 'click' THEN 0.75::DOUBLE * k ELSE 0 END) AS cited, sum(CASE WHEN event_type IN ('click', 'view') THEN k ELSE 0 END)::DOUBLE AS cost FROM {LEDGER} e GROUP BY user_id)
    SELECT user_id, round(least(least(seen, 0.5 * cost) + cited, 0.75 * cost)::DOUBLE, 4) AS credit FROM c""")
def _(spark, d):
    out = A.exploration_credit(ledger(spark, d), "user_id", cost=F.col("k"), surfaced=kind("view"), cited=kind("click"))
    return out.select("user_id", F.round("credit", 4).alias("credit"))


portable(
    "h11_outcome_metrics",
    """WITH o AS (SELECT o_custkey, count(*) AS orders FROM {orders} GROUP BY o_custkey), e AS (SELECT user_id, count(*) AS events FROM {events} GROUP BY user_id),
    l AS (SELECT o_custkey, count(*) AS items FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey)
    SELECT c_custkey, orders, items, events, CASE WHEN events IS NULL THEN 'unavailable' ELSE 'measured' END AS state FROM {customer} LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey LEFT JOIN e ON c_custkey = user_id""",
)


@query("h12_review_state", f"""WITH h AS (SELECT user_id, k % 5 AS lane, event_id, event_type, row_number() OVER (PARTITION BY user_id, k % 5 ORDER BY event_id DESC) AS n FROM {LEDGER} e WHERE event_type IN ('purchase', 'signup')),
    r AS (SELECT user_id, k % 5 AS lane, max(event_id) AS repaired FROM {LEDGER} e WHERE event_type = 'error' GROUP BY user_id, k % 5)
    SELECT h.user_id, h.lane, CASE WHEN repaired > h.event_id THEN 'stale' WHEN h.event_type = 'purchase' THEN 'approved' ELSE 'pending' END AS state FROM h LEFT JOIN r ON h.user_id = r.user_id AND h.lane = r.lane WHERE h.n = 1""")
def _(spark, d):
    lanes = ledger(spark, d).withColumn("lane", F.col("k") % 5)
    return A.review_state(lanes, "user_id", "lane", event="event_id", review=kind("purchase", "signup"), approves=kind("purchase"), repair=kind("error"))


portable(
    "h14_independence_audit",
    """WITH x AS (SELECT event_id, user_id, event_type, event_id % 7 AS claim, lead(event_id) OVER (PARTITION BY event_id % 1000, event_type ORDER BY event_id) AS next_id, lead(user_id) OVER (PARTITION BY event_id % 1000, event_type ORDER BY event_id) AS next_user FROM {events} WHERE event_type IN ('error', 'view'))
    SELECT event_id, next_id, user_id <> next_user AS independent FROM x WHERE next_id IS NOT NULL""",
)
portable(
    "h15_posture_gap",
    "SELECT user_id, count(*) AS changed, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM {events} GROUP BY user_id HAVING sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) <= 12 AND count(*) >= 5",
)


@query("h16_idempotent_request", f"SELECT user_id, event_type, CASE WHEN count(DISTINCT k) = 1 THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS n FROM {LEDGER} e GROUP BY user_id, event_type")
def _(spark, d):
    return A.idempotent(ledger(spark, d), "user_id", "event_type", digest="k")


portable(
    "h17_dashboard",
    """SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderdate >= [[day]] THEN 1 ELSE 0 END) AS BIGINT) AS recent, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus""",
    day="TIMESTAMP_NTZ '1998-01-01 00:00:00' ~~ TIMESTAMP '1998-01-01 00:00:00'",
)
portable(
    "h18_provenance",
    """WITH a AS (SELECT doc_id, [[grammar]] AS by_grammar FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('Land wave ', CAST(doc_id % 17 AS [[str]]), ' now') ELSE 'other' END AS message FROM {documents}) m),
    b AS (SELECT doc_id, CAST(quality + doc_id % 17 AS [[str]]) AS by_sha FROM {labels})
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN coalesce(by_grammar, '') = '' AND by_sha IS NULL THEN 'absence' WHEN coalesce(by_grammar, '') = '' OR by_sha IS NULL THEN 'partial' WHEN by_grammar = by_sha THEN 'resolved' ELSE 'conflict' END AS outcome FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""",
    grammar="regexp_extract(message, 'Land waves? ([0-9]+)', 1) ~~ regexp_extract(message, 'Land waves? ([0-9]+)', 1)",
    str="string ~~ VARCHAR",
)
portable(
    "h19_lifecycle",
    """WITH o AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, sum(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_now FROM {events})
    SELECT event_id, event_type, was, CASE WHEN event_type = 'purchase' AND coalesce(was, '') NOT IN ('view', 'click') THEN true ELSE false END AS illegal, open_now > 1 AS more_than_one_open FROM o""",
)


@query("h20_gate", """WITH c AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) < 20 AS few_errors, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) >= 10 AS bought, count(*) >= 50 AS active FROM events GROUP BY user_id)
    SELECT user_id, few_errors AND bought AND active AS ready, concat(CASE WHEN few_errors THEN '' ELSE 'errors;' END, CASE WHEN bought THEN '' ELSE 'purchases;' END, CASE WHEN active THEN '' ELSE 'activity;' END) AS recovery FROM c""")
def _(spark, d):
    return A.gate(table(spark, d, "events"), "user_id", errors=F.count_if(kind("error")) < 20, purchases=F.count_if(kind("purchase")) >= 10, activity=F.count("*") >= 50)


portable(
    "h21_checklist",
    """SELECT o_orderkey, count(*) AS criteria, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS complete, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS deferred FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
