"""Structured Streaming forms of the ledger: replay-safe intake, quiet periods, exactly-once totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.artifacts import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, *, files_a_batch: int = 10) -> DataFrame:
    """Files of the ledger as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def stamped(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Events with a watermark on their time (as an instant)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def without_replays(events: DataFrame) -> DataFrame:
    """One event for each id within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def quiet_bursts(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Bursts of a user's events that a quiet period ends."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote (a table in the shared folder)."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out if mode == "append" else f"{out}/batch")


def publish(stream: DataFrame, target: str) -> None:
    """Compare-and-set publication: a batch's table is written under its number, which a restart writes again, not twice."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, f"state-{uuid.uuid4().hex}")).trigger(availableNow=True).start().awaitTermination()


def leading_edge(events: DataFrame, *, seconds: int = 45) -> DataFrame:
    """The first event of a user, then none until ``seconds`` have passed since the last one let through."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for pdf in frames:
            for t, i in sorted(zip(pdf["ts"], pdf["event_id"], strict=True)):
                now = t.value // 1000
                if last is None or now - last >= seconds * 1_000_000:
                    last = now
                    out.append((key[0], i))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
