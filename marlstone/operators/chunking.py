"""Row-generating operators: documents to chunks. Everything but hashes of ids is one pass and one shuffle by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import lines


def line_rows(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """One row a line: key, pos (from 0), line. Narrow: no shuffle."""
    return docs.select(key, F.posexplode(lines(F.col("text"))).alias("pos", "line"))


def line_windows(docs: DataFrame, *, size: int = 120, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """Windows of ``size`` lines: key, chunk, first_line, last_line, text; cut inside the row, without a shuffle."""
    step = size - overlap
    own = docs.select(key, lines(F.col("text")).alias("own_lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("own_lines") - 1 - overlap, F.lit(0)), F.lit(step))
    return own.select(key, "own_lines", F.posexplode(starts).alias("chunk", "at")).select(
        key,
        F.col("chunk").cast("bigint").alias("chunk"),
        (F.col("at") + 1).cast("bigint").alias("first_line"),
        F.least(F.col("at") + size, F.size("own_lines")).cast("bigint").alias("last_line"),
        F.array_join(F.slice("own_lines", F.col("at") + 1, F.lit(size)), "\n").alias("text"),
    )


def sections(rows: DataFrame, heading, *, key: str = "doc_id") -> DataFrame:
    """Number the sections of line rows: a heading line starts the next one (0 stands before the first)."""
    by_doc = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(by_doc))


def oversize_split(docs: DataFrame, *, size: int = 1500, key: str = "doc_id") -> DataFrame:
    """Sub-ranges of ``size`` characters: key, part, text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    return docs.select(key, "text", F.posexplode(starts).alias("part", "at")).select(
        key, F.col("part").cast("bigint").alias("part"), F.col("text").substr(F.col("at") + 1, F.lit(size)).alias("text")
    )


def merge_small(chunks: DataFrame, *, least: int = 2, key: str = "doc_id") -> DataFrame:
    """Chunks (key, chunk, n_lines, text) of fewer lines than ``least`` join the one before them."""
    by_doc = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when((F.col("n_lines") >= least), 1).otherwise(0)).over(by_doc)
    grouped = chunks.withColumn("island", island).groupBy(key, "island").agg(
        F.sum("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("own")
    )
    return grouped.select(key, "island", "n_lines", F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text"))


def chunk_hash(*columns) -> Column:
    """Fingerprint of what retrieval sees of a chunk."""
    return F.sha2(F.concat_ws("\u0001", *columns), 256)
