"""A training corpus from `documents`: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import checkpoint_folder, read
from marlstone.llm.decontaminate import without_hits
from marlstone.llm.near_dedup import near_duplicates
from marlstone.llm.packing import packed_pieces, tokenizer_path
from marlstone.llm.queries import SIZE
from marlstone.llm.substring_dedup import substring_dedup
from marlstone.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier calls toxic go; each row is judged by its own text, whatever its doc_id."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays: that with the least doc_id (null last), of equal ones that with the least hash of text.

    Every row gets a key of its own, written once, so repeated and null doc_ids
    with different texts are different documents; rows without words all stay.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    path = f"{checkpoint_folder(spark)}/keyed"
    docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    classes = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "class_id")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.xxhash64("text").alias("hash"), key)
    kept = keyed.select(key, rank.alias("rank")).join(classes, key).groupBy("class_id").agg(F.min("rank").alias("rank")).select(F.col(f"rank.{key}").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; documents that lose all their words go. Rows of one doc_id are not earlier than each other."""
    cut = substring_dedup(docs, rows=True).where("n_removed < n_words or n_words = 0")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint").alias("n_chars")}
    return cut.select(*[new.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark window go."""
    return without_hits(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in packed sequences."""
    return packed_pieces(docs, tokenizer_path(), size=SIZE)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Two stages (a trained classifier and a tokenizer) have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs, folder = read(spark, sf_dir, "documents"), checkpoint_folder(spark)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
