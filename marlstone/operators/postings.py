"""A persisted inverted index of texts for BM25: buckets of terms, blocks of postings with bounds, segments.

Documents are dealt into ranges of about ``RANGE_ROWS``; those of one length class share ranges, so
that lengths within a range are alike. A block holds a term's postings in one
range, with the largest term frequency and the least length, from which the
block's largest score follows at any state of the corpus. Blocks lie in buckets
by a hash of the term. A batch of documents is a segment of its own; statistics
add up over segments, and a merge rewrites several as one.

A search first reads the bounds of the asked terms alone (column pruning). The
ranges with the largest summed bounds are scored first and give a threshold; of
the others only ranges whose summed bound reaches it are read. Bounds are never
below a score, so the result is exact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.operators.graph import checkpointed, dropped, released, stored
from marlstone.operators.retrieval import small, top_n

BUCKETS, RANGE_ROWS = 64, 512
BLOCKS = "term string, range_id bigint, n bigint, cf bigint, max_tf bigint, min_dl int, docs array<struct<doc_id:bigint,tf:bigint,dl:int>>, segment string, bucket int"


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_segment(postings: DataFrame, lengths: DataFrame, path: str, segment: str, range_rows: int) -> None:
    """One segment from postings (doc_id, dl, term, tf) and lengths (class, n, total: documents and tokens of each length class)."""
    with released(postings.sparkSession):
        classes = {r["class"]: (r["n"], r["total"]) for r in lengths.collect()}
    # As many numbers as there are length classes (a few for each doubling).
    parts = F.coalesce(F.create_map(*[F.lit(x) for c, (n, _) in classes.items() for x in (c, max(1, n // range_rows))])[F.col("class")], F.lit(1)) if classes else F.lit(1)
    ranged = postings.withColumn("class", length_class(F.col("dl"))).withColumn("range_id", F.col("class").cast("bigint") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), parts))
    blocks = ranged.groupBy("term", "range_id").agg(
        F.count("*").alias("n"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
        F.array_sort(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("docs"),
    )
    placed = blocks.withColumn("segment", F.lit(segment)).withColumn("bucket", bucket_of(F.col("term")))
    # Sorted by term, so that a file's row groups are told apart by it; a bucket's terms are dealt by range too, so that a frequent one is shared out.
    with released(postings.sparkSession):
        placed.repartition("bucket", F.pmod("range_id", F.lit(8))).sortWithinPartitions("term", "range_id").write.mode("append").partitionBy("segment", "bucket").option("compression", "zstd").parquet(f"{path}/blocks")
    n, total = (sum(c[i] for c in classes.values()) for i in (0, 1))
    postings.sparkSession.createDataFrame([(segment, n, total)], "segment string, n bigint, total bigint").coalesce(1).write.mode("append").parquet(f"{path}/segments")


def length_class(dl: Column) -> Column:
    """Four classes for each doubling of a length."""
    return F.floor(4 * F.log2(F.greatest(dl, F.lit(1)))).cast("int")


def add_segment(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> str:
    """Index a batch of documents as a new segment under ``path``; what is there stays untouched. Returns the segment.

    Texts are tokenised once; the tokens' counts are combined before they are
    shuffled. A null or empty text counts as a document without words. Keys are
    taken to be different ones, over all segments. A segment is readable once its
    statistics are written, after its blocks.
    """
    segment = uuid.uuid4().hex
    words = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.explode(F.array(tokens(F.col(text)))).alias("words")).withColumn("dl", F.size("words"))
    counted = words.select("doc_id", "dl", F.explode_outer("words").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    counted = stored(counted)
    lengths = counted.groupBy("doc_id", "dl").agg(F.count("*")).groupBy(length_class(F.col("dl")).alias("class")).agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    _write_segment(counted.where("term is not null"), lengths, path, segment, range_rows)
    dropped(counted)
    return segment


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their documents and tokens; a merged one's parts are left out."""
    told = spark.read.schema("segment string, n bigint, total bigint").parquet(f"{path}/segments")
    gone = spark.read.schema("segment string").json(f"{path}/merged") if _exists(spark, f"{path}/merged") else spark.createDataFrame([], "segment string")
    return told.join(F.broadcast(gone), "segment", "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def merge_segments(spark: SparkSession, path: str, *, range_rows: int = RANGE_ROWS) -> str:
    """Rewrite all live segments as one, from their blocks alone; the old ones are named as merged once it is written."""
    live = [r["segment"] for r in segments(spark, path).collect()]
    stats = segments(spark, path).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    old = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("segment").isin(live))
    postings = old.select("term", F.inline("docs")).select("doc_id", "dl", "term", "tf")
    lengths = postings.select("doc_id", "dl").distinct().groupBy(length_class(F.col("dl")).alias("class")).agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    segment = uuid.uuid4().hex
    # Documents without words stand in no block; they are counted as the lowest class.
    worded = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    empty = spark.createDataFrame([(-1, stats["n"] - worded, 0)], "class int, n bigint, total bigint")
    _write_segment(postings, lengths.unionByName(empty), path, segment, range_rows)
    spark.createDataFrame([(s,) for s in live], "segment string").coalesce(1).write.mode("append").json(f"{path}/merged")
    return segment


def blocks_of(spark: SparkSession, path: str, asked: DataFrame, live: list[str] | None = None) -> DataFrame:
    """Live blocks of the asked terms (a ``term`` column): only these terms' buckets of live segments are read."""
    live = [r["segment"] for r in segments(spark, path).collect()] if live is None else live
    # Numbers of buckets, of which there are ``BUCKETS`` at most.
    buckets = sorted(r["b"] for r in asked.select(bucket_of(F.col("term")).alias("b")).distinct().collect())
    every = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("segment").isin(live) & F.col("bucket").isin(buckets))
    return every.join(small(asked.select("term").distinct()), "term", "left_semi")


def term_totals(spark: SparkSession, path: str) -> DataFrame:
    """Documents and places of every term, from the blocks' counts alone: term, df, cf."""
    live = [r["segment"] for r in segments(spark, path).collect()]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("segment").isin(live))
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def reaching(ranges: DataFrame, threshold: DataFrame) -> DataFrame:
    """Ranges whose bound reaches the question's threshold (all, if it has none): qid, segment, range_id."""
    bounded = ranges.join(small(threshold), "qid", "left")
    return bounded.where(F.col("least").isNull() | (F.col("most") >= F.col("least") - 1e-6)).select("qid", "segment", "range_id")


def search(spark: SparkSession, path: str, questions: DataFrame, n: int = 20, *, key: str = "doc_id", k1: float = 1.2, b: float = 0.75, first_ranges: int | None = None) -> DataFrame:
    """The n best documents of each question (qid, text) by BM25 from the index alone: qid, key, score, rank; ties by key.

    Equal to scoring all documents. ``first_ranges`` (from ``n``, unless given) are
    scored before the others, for a threshold.
    """
    asked = checkpointed(questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    live = segments(spark, path).collect()
    stats = {"docs": sum(r["n"] for r in live), "total": sum(r["total"] for r in live)}
    average = stats["total"] / max(1, stats["docs"])
    found = blocks_of(spark, path, asked, [r["segment"] for r in live])
    impact = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average)) if average else F.lit(0.0)
    bounds = found.select("term", "segment", "range_id", "n", impact(F.col("max_tf"), F.col("min_dl")).alias("impact"))
    df = F.sum("n").alias("df")
    idf = F.log(1 + (F.lit(stats["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = small(checkpointed(asked.join(bounds.groupBy("term").agg(df), "term").select("qid", "term", idf.alias("idf"))))
    # What each range can give a question at most: numbers of blocks, without their postings.
    most = checkpointed(bounds.join(weights, "term").groupBy("qid", "segment", "range_id").agg(F.sum(F.col("impact") * F.col("idf")).alias("most"), F.max("n").alias("n")))
    by_bound = Window.partitionBy("qid").orderBy(F.col("most").desc(), "segment", "range_id")
    # No fewer ranges than have n documents together; a range has one at least.
    lead = top_n(most, first_ranges or n, by=[F.col("most").desc(), F.col("segment"), F.col("range_id")], rank="place")
    lead = lead.withColumn("before", F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < n)
    lead = checkpointed(lead.select("qid", "segment", "range_id"))

    def scored(ranges: DataFrame) -> DataFrame:
        wanted = ranges.join(weights, "qid")
        held = found.join(small(wanted), ["term", "segment", "range_id"]).select("qid", "idf", F.inline("docs"))
        return held.groupBy("qid", F.col("doc_id").alias(key)).agg(F.sum(F.col("idf") * impact(F.col("tf"), F.col("dl"))).alias("score"))

    order = [F.round("score", 9).desc(), F.col(key)]
    early = checkpointed(top_n(scored(lead), n, by=order))
    threshold = early.where(F.col("rank") == n).select("qid", F.col("score").alias("least"))
    rest = reaching(most.join(lead, ["qid", "segment", "range_id"], "left_anti"), threshold)
    return top_n(early.select("qid", key, "score").unionByName(scored(rest)), n, by=order)
