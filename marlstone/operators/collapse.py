"""Near-duplicate collapse of candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.operators.graph import checkpointed, components


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct hashes of the runs of ``size`` tokens; fewer tokens are one run, none for a text without tokens."""

    def runs(words: Column) -> Column:
        each = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, size)]))
        return F.array_distinct(F.slice(each, 1, F.greatest(F.lit(1), F.size(words) - (size - 1))))

    return F.transform(F.array(tokens(text)), runs)[0]


def _signature(own: Column, bands: int, rows: int) -> Column:
    """Bands of minima of the shingles under different hashes; a pair at similarity s shares one with probability 1 - (1 - s^rows)^bands."""
    least = lambda seed: F.array_min(F.transform(own, lambda x: F.xxhash64(x, F.lit(seed))))
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * rows + r) for r in range(rows)]).alias("hash")) for b in range(bands)])


def links(rows: DataFrame, *, threshold: float = 0.8, bands: int = 16, band_rows: int = 3) -> DataFrame:
    """Pairs (a, b) of ids that are one hit: rows are (qid, id, file, first, last, symbol, text).

    Copies of a symbol or of a text are tied to their least id. Lines of a file
    that overlap (ends included) are tied in chains, by a running end over their
    starts. Texts of ``threshold`` similarity of word 5-shingles or more are found in bands, where each
    is compared with the band's least text, and with the next one in the band's order. No
    group makes all its pairs.
    """
    tied = []
    same = F.sha2(F.array_join(tokens(F.col("text")), " "), 256)
    for key in (F.col("symbol"), F.when(F.size(tokens(F.col("text"))) > 0, same)):
        keyed = rows.select("qid", "id", key.alias("key")).where("key is not null")
        least = keyed.groupBy("qid", "key").agg(F.min("id").alias("a"))
        tied.append(keyed.join(least, ["qid", "key"]).select("a", F.col("id").alias("b")))
    lines = rows.where("file is not null and first is not null and last >= first").select("qid", "file", "first", "last", "id")
    # Equal stretches are one, so that a hot one is no long window.
    spans = lines.groupBy("qid", "file", "first", "last").agg(F.min("id").alias("lead"))
    tied.append(lines.join(spans, ["qid", "file", "first", "last"]).select(F.col("lead").alias("a"), F.col("id").alias("b")))
    order = Window.partitionBy("qid", "file").orderBy("first", "last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chained = spans.select(F.col("lead").alias("b"), F.lag("lead").over(order).alias("a"), (F.col("first") <= F.max("last").over(before)).alias("on"))
    tied.append(chained.where("on").select("a", "b"))
    # Of equal texts the least id stands for all.
    texts = rows.select("qid", "id", "text", same.alias("key")).groupBy("qid", "key").agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text"))
    own = checkpointed(texts.select("qid", "id", F.explode(F.array(shingles(F.col("text")))).alias("own")).where(F.size("own") > 0))
    banded = own.select("qid", "id", F.inline(_signature(F.col("own"), bands, band_rows)))
    place = Window.partitionBy("qid", "band", "hash").orderBy("id")
    near = banded.select("id", F.first("id").over(place).alias("lead"), F.lag("id").over(place).alias("next"))
    pairs = near.select(F.col("id").alias("b"), F.explode(F.array("lead", "next")).alias("a")).where("a is not null and a != b").distinct()
    left, right = (own.select(F.col("id").alias(s), F.col("own").alias(f"own_{s}")) for s in "ab")
    held = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    tied.append(held.where(shared >= threshold * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b"))
    out = tied[0]
    for t in tied[1:]:
        out = out.unionByName(t)
    return out.where("a != b").distinct()


def collapsed(rows: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One row a group of near-duplicates of a question: qid, id, rank (of its best row), sources (sorted, different), n.

    ``rows`` are candidates (qid, id, file, first, last, symbol, text, source,
    rank); ``id`` is different in each row. Rows of a question are one hit if
    they name one symbol, overlap in a file, or have equal or nearly equal words; groups are
    what such ties connect. The best row has the least rank, ties by id. Null symbols, files
    and lines tie nothing, nor do texts without words.
    """
    kept = checkpointed(rows.select("qid", "id", "file", "first", "last", "symbol", "text", "source", "rank"))
    groups = components(links(kept, threshold=threshold)).select(F.col("node").alias("id"), "component")
    told = kept.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = F.min(F.struct("rank", "id")).alias("best")
    return told.groupBy("qid", "component").agg(best, F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n")).select("qid", "best.id", "best.rank", "sources", "n")
