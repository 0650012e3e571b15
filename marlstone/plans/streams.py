"""Streaming queries, each drained over the whole ledger and equal to its batch twin's SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from marlstone.registry import query
from marlstone.sources.artifacts import scratch
from marlstone.streaming import ledger as L
from marlstone.streaming import publication as P


def stream(spark, d):
    # A file source reads folders: the table is linked into one by its own path pattern.
    return L.event_stream(spark, f"{d}/events.parquet*")


@query("l1_replay_safe", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return L.drained(L.without_replays(L.stamped(stream(spark, d)))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("l2_quiet_period", "WITH g AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS bursts, count(*)::BIGINT AS n FROM g GROUP BY user_id")
def _(spark, d):
    bursts = L.drained(L.quiet_bursts(L.stamped(stream(spark, d))), mode="complete")
    return bursts.groupBy("user_id").agg(F.count("*").alias("bursts"), F.sum("n").alias("n"))


@query("l3_leading_edge")
def _(spark, d):
    return L.drained(L.leading_edge(L.stamped(stream(spark, d)), seconds=7200))


@query("l4_publication", "SELECT count(*) AS n, sum(user_id)::BIGINT AS users FROM events")
def _(spark, d):
    target = scratch(spark, "published")
    L.publish(stream(spark, d).select("event_id", "user_id"), target)
    return spark.read.parquet(target).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("l5_late_events", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 'sealed' ELSE 'above' END AS side, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    side = F.when(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "sealed").otherwise("above")
    return L.drained(stream(spark, d).select(side.alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("l6_trigger", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return L.drained(stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), mode="complete")


@query("l7_exactly_once", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def _(spark, d):
    kept = L.without_replays(L.stamped(stream(spark, d)))
    return L.drained(kept).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("l4_compare_and_set", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    """Two streams, of even and of odd users, publish into one target; each batch has a generation of its own."""
    target, events = scratch(spark, "published"), stream(spark, d)
    for odd in (0, 1):
        P.publish(events.where(F.col("user_id") % 2 == odd), target, name=f"half{odd}", state=scratch(spark, "state"))
    return P.published(spark, target, events.schema).groupBy("event_type").agg(F.count("*").alias("n"))


@query("l7_idempotent_sink", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def _(spark, d):
    """The stream dies between its first batch's write and commit and starts again; totals are those of one run."""
    target, state, killed = scratch(spark, "published"), scratch(spark, "state"), []

    def kill(number: int) -> None:
        if not killed:
            killed.append(number)
            raise RuntimeError("killed before the commit")

    events = stream(spark, d)
    try:
        P.publish(events, target, name="ledger", state=state, before_commit=kill)
    except StreamingQueryException:
        P.publish(events, target, name="ledger", state=state)
    return P.published(spark, target, events.schema).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
