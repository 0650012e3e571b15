"""Post-processing of communities: stable names over builds, one stem together, small ones absorbed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import components, stored


def remapped(new: DataFrame, old: DataFrame) -> DataFrame:
    """New communities (node, community) under the names of an earlier build, one to one: node, community.

    Pairs of a new and an old community are matched by the number of nodes that they share, the largest
    first, ties by the new name, then the old; each name is given once. In a
    round all pairs are taken that are first for both their sides, which gives
    what a greedy pass over all pairs would, in few rounds. A community
    that gets no old name keeps its own, with a sign behind it if an old one has that name.
    """
    shared = stored(new.join(old.select("node", F.col("community").alias("was")), "node").groupBy("community", "was").agg(F.count("*").alias("n")))
    matched = None
    while not shared.isEmpty():
        first = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.col("n").desc(), "community", "was"))
        taken = stored(shared.withColumn("i", first("community")).withColumn("j", first("was")).where("i = 1 and j = 1").select("community", "was"))
        matched = taken if matched is None else matched.unionByName(taken)
        shared = stored(shared.join(taken.select("community"), "community", "left_anti").join(taken.select("was"), "was", "left_anti"))
    if matched is None:
        return new.select("node", "community")
    names = matched.select(F.col("was").alias("community"), F.lit(True).alias("taken"))
    own = new.select("node", "community").join(matched, "community", "left").join(names, "community", "left")
    free = F.when(F.col("taken"), F.concat(F.col("community").cast("string"), F.lit("~"))).otherwise(F.col("community"))
    return own.select("node", F.coalesce("was", free).alias("community"))


def joined_stems(communities: DataFrame, stems: DataFrame) -> DataFrame:
    """Communities whose nodes all have one and the same stem (node, stem) as one: node, community (the least of the joined names)."""
    told = communities.join(stems, "node", "left").groupBy("community").agg(F.min("stem").alias("stem"), F.max("stem").alias("most"), F.count_if(F.col("stem").isNull()).alias("without"))
    pure = told.where("stem = most and without = 0")
    least = pure.groupBy("stem").agg(F.min("community").alias("least"))
    return communities.join(pure.join(least, "stem").select("community", "least"), "community", "left").select("node", F.coalesce("least", "community").alias("community"))


def absorbed(communities: DataFrame, pairs: DataFrame, *, least: int = 12) -> DataFrame:
    """Communities of fewer than ``least`` nodes go to the community that they are tied to most (ties: least name), until none can: node, community.

    Pairs are (a, b, weight). All small ones choose at once; what choices connect is one
    community then, under the name of its largest (ties: least name). Each round
    leaves fewer small ones, so there are few rounds. Small ones without ties to others stay.
    """
    now = stored(communities.select("node", "community"))
    while True:
        sizes = stored(now.groupBy("community").agg(F.count("*").alias("n")))
        small = sizes.where(F.col("n") < least).select("community")
        own = lambda side, now=now: now.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
        # Only edges at nodes of small communities are looked at.
        inside = stored(now.join(small, "community").select("node", "community"))
        if inside.isEmpty():
            return now
        at = lambda x, y, own=own, inside=inside: pairs.join(inside.withColumnRenamed("node", x), x).join(own(y), y).select("community", F.col(f"c_{y}").alias("to"), "weight").where("community != to")
        ties = at("a", "b").unionByName(at("b", "a")).groupBy("community", "to").agg(F.sum("weight").alias("weight"))
        chosen = stored(ties.groupBy("community").agg(F.min(F.struct((-F.col("weight")).alias("w"), "to")).alias("best")).select(F.col("community").alias("a"), F.col("best.to").alias("b")))
        if chosen.isEmpty():
            return now
        groups = components(chosen).select(F.col("node").alias("community"), "component")
        lead = groups.join(sizes, "community").groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("lead"))
        named = groups.join(lead, "component").select("community", F.col("lead.community").alias("name"))
        now = stored(now.join(named, "community", "left").select("node", F.coalesce("name", "community").alias("community")))
