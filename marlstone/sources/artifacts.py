"""Versioned tables: a generation is written whole, then one pointer row makes it current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder (a temporary folder only in a local session that names none)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="marlstone-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def write_artifact(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> str:
    """Write the next generation and point to it; readers of the old one are not disturbed."""
    generation = uuid.uuid4().hex
    df.write.mode("errorifexists").partitionBy(*partition_by).option("compression", "zstd").parquet(f"{path}/generation={generation}")
    df.sparkSession.range(1).selectExpr(f"'{generation}' AS generation").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return generation


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The current generation; the pointer is read once, so a later write does not mix in."""
    generation = spark.read.schema("generation string").json(f"{path}/current").first()["generation"]
    return spark.read.parquet(f"{path}/generation={generation}")


def compacted(df: DataFrame, *, rows_a_file: int = 1_000_000) -> DataFrame:
    """As many partitions as files of about ``rows_a_file`` rows need."""
    return df.repartition(max(1, -(-df.count() // rows_a_file)))
