"""Change detection and incremental maintenance as set and merge operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, *, key: str, stat: list[str], digest: str) -> DataFrame:
    """Class of each key: added, removed, unchanged (same stat, or same digest) or updated. One full outer join."""
    b = before.select(F.col(key), F.struct(*stat).alias("stat_b"), F.col(digest).alias("digest_b"))
    a = after.select(F.col(key), F.struct(*stat).alias("stat_a"), F.col(digest).alias("digest_a"))
    kind = (
        F.when(F.col("stat_b").isNull(), "added")
        .when(F.col("stat_a").isNull(), "removed")
        .when((F.col("stat_a") == F.col("stat_b")) | F.col("digest_a").eqNullSafe(F.col("digest_b")), "unchanged")
        .otherwise("updated")
    )
    return b.join(a, key, "full_outer").select(key, kind.alias("change"))


def delta_plan(before: DataFrame, after: DataFrame, *, key: str, digest: str) -> DataFrame:
    """Plan of each chunk, and whether a vector of its digest is there to be used again."""
    b, a = before.select(key, F.col(digest).alias("digest_b")), after.select(key, F.col(digest).alias("digest_a"))
    known = before.select(F.col(digest).alias("digest_a")).distinct().withColumn("reuse", F.lit(True))
    kind = (
        F.when(F.col("digest_b").isNull(), "added")
        .when(F.col("digest_a").isNull(), "removed")
        .when(F.col("digest_a") == F.col("digest_b"), "unchanged")
        .otherwise("changed")
    )
    return b.join(a, key, "full_outer").join(known, "digest_a", "left").select(key, kind.alias("plan"), F.coalesce("reuse", F.lit(False)).alias("reuse"))


def merged_edges(stored: DataFrame, changed: DataFrame, fresh: DataFrame, *, owner: str) -> DataFrame:
    """A stored graph with the fragments of changed owners replaced: equals a full build."""
    return stored.join(changed.select(owner).distinct(), owner, "left_anti").unionByName(fresh)


def fingerprint(df: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """Order-free digest of a table of any size: count and sum of row hashes (xxhash64 of all columns unless given), combined in each task."""
    hashed = F.xxhash64(*df.columns) if row_hash is None else row_hash
    return df.select(F.count("*").alias("n"), F.sum(hashed.cast("decimal(38,0)")).alias("digest"))


def health(rows: Column, stale: Column, missing: Column) -> Column:
    """Class of an index, worst first."""
    return F.when(rows == 0, "absent").when(missing > 0, "degraded").when(stale > 0, "needs_update").otherwise("ready")
