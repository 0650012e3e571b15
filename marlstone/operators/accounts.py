"""Ledger operators: totals that are floored once, once-only credit, caps, attribution and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closed_ledger(entries: DataFrame, key: str, *, credit: Column, debit: Column) -> DataFrame:
    """Credits less debits by key and in all (key null): key, credit, debit, saved (H2).

    Both levels come from one pass by grouping sets over the sums, and each
    total is floored at 0 once; a total is not the sum of floored parts.
    """
    sums = entries.select(key, credit.alias("credit"), debit.alias("debit")).groupBy(key).agg(
        F.coalesce(F.sum("credit"), F.lit(0)).alias("credit"), F.coalesce(F.sum("debit"), F.lit(0)).alias("debit")
    )
    levels = sums.groupingSets([[F.col(key)], []], F.col(key)).agg(
        F.sum("credit").cast("bigint").alias("credit"), F.sum("debit").cast("bigint").alias("debit")
    )
    return levels.withColumn("saved", F.greatest(F.lit(0), F.col("credit") - F.col("debit")).cast("bigint"))


def once_only(entries: DataFrame, *identity: str, event: str) -> DataFrame:
    """Each identity once, with its first event (H3); replays of an event change nothing."""
    return entries.groupBy(*identity).agg(F.min(event).alias(event))


def credit_cap(entries: DataFrame, phase: str, *identity: str, cap: int) -> DataFrame:
    """Identities that a phase credits, and those beyond the cap: phase, credited, dropped (H5).

    Which ones fall beyond the cap never changes how many, so no phase is ranked
    in one task; identities are made distinct before they are counted.
    """
    counted = entries.groupBy(phase, *identity).agg(F.lit(1).alias("one")).groupBy(phase).agg(F.count("*").alias("n"))
    return counted.select(phase, F.least("n", F.lit(cap)).cast("bigint").alias("credited"), F.greatest(F.col("n") - cap, F.lit(0)).cast("bigint").alias("dropped"))


def attributed(events: DataFrame, owner: str, *order: str, focus: Column, opens: Column, closes: Column, general: str = "general") -> DataFrame:
    """The stage each event belongs to, in a column ``stage`` (H6).

    The last focus of the owner up to the event counts. Before any focus it is
    the owner's open wave if exactly one is open, else ``general``.
    """
    so_far = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    open_now = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(so_far)
    last = F.last(focus, ignorenulls=True).over(so_far)
    return events.withColumn("stage", F.coalesce(last, F.when(open_now == 1, F.lit("open wave")), F.lit(general)))


def exploration_credit(entries: DataFrame, origin: str, *, cost: Column, surfaced: Column, cited: Column) -> DataFrame:
    """Credit of each origin: half the cost of what was surfaced, three quarters of what was cited, within budgets.

    Surfaced entries give at most half of the origin's cost, all entries
    together at most three quarters.
    """
    part = lambda on, share: F.coalesce(F.sum(F.when(on, cost * share)), F.lit(0.0))
    sums = entries.groupBy(origin).agg(
        part(surfaced & ~cited, 0.5).alias("surfaced"), part(cited, 0.75).alias("cited"), F.coalesce(F.sum(F.when(surfaced | cited, cost)), F.lit(0)).cast("double").alias("cost")
    )
    credit = F.least(F.least("surfaced", 0.5 * F.col("cost")) + F.col("cited"), 0.75 * F.col("cost"))
    return sums.select(origin, credit.alias("credit"))


def sealed_floor(entries: DataFrame, key: str, *, amount: Column, sealed: Column) -> DataFrame:
    """What is sealed, what came later, and both: key, floor_sum, later, total (H8)."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return entries.groupBy(key).agg(
        whole(F.when(sealed, amount).otherwise(0)).alias("floor_sum"), whole(F.when(sealed, 0).otherwise(amount)).alias("later"), F.sum(amount).cast("bigint").alias("total")
    )


def idempotent(requests: DataFrame, *identity: str, digest: str) -> DataFrame:
    """Requests by identity: equal digests are replays, different ones a conflict: identity, outcome, n."""
    told = requests.groupBy(*identity).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high"), F.count("*").alias("n"))
    return told.select(*identity, F.when(F.col("_low") == F.col("_high"), "replay").otherwise("conflict").alias("outcome"), "n")


def review_state(events: DataFrame, *lane: str, event: str, review: Column, approves: Column, repair: Column) -> DataFrame:
    """Current state of each reviewed lane: lane, state.

    The last review decides; a repair after it makes it stale. One pass: both
    are maxima of the same group.
    """
    told = events.groupBy(*lane).agg(
        F.max(F.when(review, F.struct(F.col(event).alias("at"), approves.alias("approves")))).alias("last"), F.max(F.when(repair, F.col(event))).alias("repaired")
    )
    state = F.when(F.col("repaired") > F.col("last.at"), "stale").when(F.col("last.approves"), "approved").otherwise("pending")
    return told.where("last is not null").select(*lane, state.alias("state"))


def gate(events: DataFrame, key: str, **checks: Column) -> DataFrame:
    """Readiness of each key: key, ready, and recovery, the names of failed checks in order."""
    told = events.groupBy(key).agg(*[c.alias(n) for n, c in checks.items()])
    ready = F.lit(True)
    for n in checks:
        ready = ready & F.coalesce(F.col(n), F.lit(False))
    failed = F.concat(*[F.when(F.coalesce(F.col(n), F.lit(False)), "").otherwise(f"{n};") for n in checks])
    return told.select(key, ready.alias("ready"), failed.alias("recovery"))
