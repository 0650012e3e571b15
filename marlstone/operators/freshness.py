"""Freshness, drift and memory operators over commits and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn(commits: DataFrame, file: str, at: str, *, since: Column) -> DataFrame:
    """Last commit of each file, and its recent commits as a share of the busiest file's: file, last_modified, churn.

    The largest count is a scalar subquery of partial maxima, not a window over
    all files. Without any recent commit churn is null.
    """
    files = commits.groupBy(file).agg(F.max(at).alias("last_modified"), F.count_if(F.col(at) >= since).alias("n"))
    most = files.select(F.max("n").cast("double").alias("most")).scalar()
    return files.select(file, "last_modified", F.round(F.try_divide(F.col("n").cast("double"), most), 6).alias("churn"))


def drift(commits: DataFrame, file: str, at: str, *, anchors: list[Column], historical: Column, threshold: int = 3) -> DataFrame:
    """Commits since the newest anchor of each file: file, commits_since, drifted.

    Anchors are times of a commit, or null where it is none of the kind; files
    that lack one of the kinds have no anchor and no commits since.
    Historical files are never flagged.
    """
    newest = commits.groupBy(file).agg(*[F.max(a).alias(f"_{i}") for i, a in enumerate(anchors)])
    known = F.lit(True)
    for i in range(len(anchors)):
        known = known & F.col(f"_{i}").isNotNull()
    latest = F.greatest(*[F.col(f"_{i}") for i in range(len(anchors))]) if len(anchors) > 1 else F.col("_0")
    anchored = newest.select(file, F.when(known, latest).alias("_anchor"))
    since = commits.select(file, at).join(anchored, file).groupBy(file).agg(F.count_if(F.col(at) > F.col("_anchor")).alias("commits_since"))
    return since.select(file, "commits_since", ((F.col("commits_since") >= threshold) & ~historical).alias("drifted"))


def half_life(commits: DataFrame, target: str, at: str, *order: str, low: int = 5, most: int = 40, times: float = 6.0, least_days: float = 30.0, most_days: float = 365.0) -> DataFrame:
    """Half-life of each target in days: the median gap of its newest commits times ``times``, within bounds.

    The newest ``most`` commits count; a target with fewer than ``low`` has the
    fixed least. The newest are taken by a limit inside the window, so a busy
    target does not bring all its commits to one task.
    """
    newest = Window.partitionBy(target).orderBy(F.col(at).desc(), *[F.col(o).desc() for o in order])
    kept = commits.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= most)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gaps = kept.withColumn("_gap", (F.lag(micros).over(newest) - micros) / F.lit(86_400_000_000.0))
    told = gaps.groupBy(target).agg(F.count("*").alias("_n"), F.median("_gap").alias("_mid"))
    days = F.least(F.lit(most_days), F.greatest(F.lit(least_days), F.col("_mid") * times))
    return told.select(target, F.when(F.col("_n") < low, F.lit(least_days)).otherwise(days).alias("half_life"))


def most_conservative(links: DataFrame, lives: DataFrame, record: str, target: str) -> DataFrame:
    """The longest half-life among a record's targets: record, half_life."""
    return links.join(lives, target).groupBy(record).agg(F.max("half_life").alias("half_life"))


def normalised(column: Column) -> Column:
    """Lower case, anything but digits and letters as one space."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]+", " ")


def duplicates(records: DataFrame, key: str, *, summary: str, groups: list[str], evidence: str | None = None) -> DataFrame:
    """Pairs of records tied to the least of their kind: key, first_key, reason (I8).

    Equal normalised summaries within the groups, or a shared evidence
    reference. A record is tied to the least key that it shares a summary or a
    reference with, so copies never form all pairs.
    """
    own = records.withColumn("_norm", F.sha2(normalised(F.col(summary)), 256))
    least = own.groupBy(*groups, "_norm").agg(F.min(key).alias("first_key"))
    same = [F.col(f"o.{g}").eqNullSafe(F.col(f"l.{g}")) for g in [*groups, "_norm"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = own.alias("o").join(least.alias("l"), on).select(F.col(f"o.{key}").alias(key), "first_key").where(F.col(key) != F.col("first_key")).withColumn("reason", F.lit("equal summary"))
    if evidence:
        refs = records.select(key, F.explode(evidence).alias("_ref")).distinct()
        shared = refs.groupBy("_ref").agg(F.min(key).alias("first_key"))
        tied = refs.join(shared, "_ref").where(F.col(key) != F.col("first_key")).groupBy(key).agg(F.min("first_key").alias("first_key"))
        out = out.unionByName(tied.withColumn("reason", F.lit("shared evidence")))
    return out


def recall_and_mrr(ranked: DataFrame, query: str, *, relevant: Column, place: str, at: int = 3) -> DataFrame:
    """Recall within the first places and mean reciprocal rank of a ranking: one row, recall, mrr."""
    told = ranked.groupBy(query).agg(F.max(F.when(relevant & (F.col(place) <= at), 1.0).otherwise(0.0)).alias("hit"), F.max(F.when(relevant, 1.0 / F.col(place)).otherwise(0.0)).alias("rr"))
    return told.agg(F.avg("hit").alias("recall"), F.avg("rr").alias("mrr"))


def eval_gate(new: DataFrame, old: DataFrame, *, invariants: Column) -> DataFrame:
    """Whether a ranking may replace another: recall, mrr, passed (I13): recall not lower, MRR strictly higher, invariants hold."""
    before = lambda c: old.select(c).scalar()
    better = (F.col("recall") >= before("recall")) & (F.col("mrr") > before("mrr")) & invariants
    return new.select("recall", "mrr", F.coalesce(better, F.lit(False)).alias("passed"))
