"""Transactional publication of stream batches: attempts, one commit record a batch, a side for late rows.

A batch is written as an attempt of its own, which nobody reads. It counts once a
commit record is there: a small file named by the next generation that only one
writer can create (compare-and-set). A stream that restarts may write a batch
again, but finds its record and leaves it; an attempt without a record is
never read. So totals stay, wherever a writer is killed. Records also carry
the floor below which the ledger is sealed: rows under the floor of the batches
before go to the late side and leave the sealed rows alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def records(spark: SparkSession, target: str) -> list[dict]:
    """Commit records by generation: one for each batch of a stream, the earliest if a writer was overtaken."""
    folder, fs = _files(spark, f"{target}/log")
    if not fs.exists(folder):
        return []
    texts = spark.read.option("wholetext", True).text(f"{target}/log").select(F.input_file_name().alias("f"), "value").collect()
    told, seen = [], set()
    # A claim that was never filled is no record.
    for r in sorted((json.loads(t["value"]) for t in texts if t["value"].strip()), key=lambda r: r["generation"]):
        if (r["stream"], r["batch"]) not in seen:
            seen.add((r["stream"], r["batch"]))
            told.append(r)
    return told


def _claimed(spark: SparkSession, target: str) -> int:
    folder, fs = _files(spark, f"{target}/log")
    return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0


def compare_and_set(spark: SparkSession, target: str, generation: int, record: dict) -> bool:
    """Write a record as this generation; False if another writer has it."""
    path, fs = _files(spark, f"{target}/log/{generation:020d}.json")
    try:
        out = fs.create(path, False)
    except Exception:
        if fs.exists(path):
            return False
        raise
    out.write(bytearray(json.dumps({**record, "generation": generation}).encode()))
    out.close()
    return True


def commit(spark: SparkSession, target: str, record: dict) -> bool:
    """Commit a batch of a stream once, at whatever generation is free; False if it already is."""
    while True:
        if any((r["stream"], r["batch"]) == (record["stream"], record["batch"]) for r in records(spark, target)):
            return False
        if compare_and_set(spark, target, _claimed(spark, target) + 1, record):
            return True


def put_batch(batch: DataFrame, number: int, target: str, *, stream: str, at: str, delay_seconds: int, before_commit: Callable[[int], None] | None = None) -> None:
    """Write a batch as an attempt and commit it.

    Rows whose time ``at`` lies below the floor that the stream's batches before this one have set are late; the
    floor is the largest time seen less ``delay_seconds`` and never falls. Rows
    without a time are never late.
    """
    spark = batch.sparkSession
    known = records(spark, target)
    if any((r["stream"], r["batch"]) == (stream, number) for r in known):
        return
    floor = max((r["floor"] for r in known if r["stream"] == stream and r["batch"] < number and r["floor"] is not None), default=None)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    late = F.coalesce(micros < F.lit(floor), F.lit(False)) if floor is not None else F.lit(False)
    attempt = f"{target}/data/{stream}/batch={number}/attempt={uuid.uuid4().hex}"
    batch.withColumn("late", late).write.parquet(attempt)
    written = spark.read.schema(batch.schema.add("late", "boolean")).parquet(attempt)
    told = written.agg(F.count("*").alias("rows"), F.max(micros).alias("last")).first()
    ends = [x for x in (floor, told["last"] - delay_seconds * 1_000_000 if told["last"] is not None else None) if x is not None]
    if before_commit:
        before_commit(number)
    commit(spark, target, {"stream": stream, "batch": number, "attempt": attempt, "rows": told["rows"], "floor": max(ends, default=None)})


def publish(stream: DataFrame, target: str, *, name: str, state: str, at: str = "ts", delay_seconds: int = 0, before_commit: Callable[[int], None] | None = None) -> None:
    """Run a stream over all that is there into ``target``; with the same ``state`` it goes on where it was, whatever stopped it."""

    def put(batch: DataFrame, number: int) -> None:
        put_batch(batch, number, target, stream=name, at=at, delay_seconds=delay_seconds, before_commit=before_commit)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def published(spark: SparkSession, target: str, schema) -> DataFrame:
    """All committed rows, with ``late``: attempts that a record names, nothing else."""
    paths = [r["attempt"] for r in records(spark, target) if r["rows"]]
    kinds = schema.add("late", "boolean") if "late" not in schema.names else schema
    return spark.read.schema(kinds).parquet(*paths) if paths else spark.createDataFrame([], kinds)
