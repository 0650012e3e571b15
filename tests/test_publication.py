"""Publication of stream batches: crashes, competing writers, late rows."""

import datetime as dt
import os
import time

import pytest
from pyspark.errors import StreamingQueryException

from marlstone.streaming import publication as P

SCHEMA = "id bigint, ts timestamp, value double"
DAY = dt.datetime(2024, 1, 1)


def file_of(spark, folder, number, rows):
    """One file of the stream; files come in the order of their times."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")
    for name in os.listdir(f"{folder}/{number}"):
        os.utime(f"{folder}/{number}/{name}", (time.time() - 1000 + number,) * 2)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def rows_of(spark, target):
    return sorted((r.id, r.late) for r in P.published(spark, target, spark.createDataFrame([], SCHEMA).schema).collect())


def hours(*which):
    return [(i, DAY + dt.timedelta(hours=h) if h is not None else None, 1.0) for i, h in which]


def test_kill_between_write_and_commit(spark, tmp_path):
    folder, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(4):
        file_of(spark, folder, k, hours(*[(10 * k + i, 24 * k + i) for i in range(5)]))

    def kill(number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        P.publish(source(spark, folder), target, name="s", state=state, before_commit=kill)
    assert [r["batch"] for r in P.records(spark, target)] == [0, 1]
    assert os.listdir(f"{target}/data/s/batch=2")  # written, not committed, not read
    assert len(rows_of(spark, target)) == 10
    P.publish(source(spark, folder), target, name="s", state=state)
    assert [r["batch"] for r in P.records(spark, target)] == [0, 1, 2, 3]
    assert len(os.listdir(f"{target}/data/s/batch=2")) == 2
    assert [i for i, _ in rows_of(spark, target)] == [10 * k + i for k in range(4) for i in range(5)]
    # A batch that comes again after its commit changes nothing.
    P.put_batch(spark.createDataFrame(hours((1, 1)), SCHEMA), 3, target, stream="s", at="ts", delay_seconds=0)
    assert len(rows_of(spark, target)) == 20


def test_late_rows_take_the_side(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 10), (2, 30)], [(3, 27), (4, 29), (5, None), (6, 20)], [(7, 100)], [(8, 97), (9, 98), (10, 1)]]
    for k, which in enumerate(batches):
        file_of(spark, folder, k, hours(*which))
    P.publish(source(spark, folder), target, name="s", state=str(tmp_path / "state"), delay_seconds=2 * 3600)
    want, floor = [], None
    for which in batches:
        want += [(i, floor is not None and h is not None and h < floor) for i, h in which]
        floor = max(h for h in [floor, *(h - 2 for _, h in which if h is not None)] if h is not None)
    assert rows_of(spark, target) == sorted(want)
    assert [i for i, late in rows_of(spark, target) if late] == [3, 6, 8, 10] and [r["floor"] for r in P.records(spark, target)] == sorted(r["floor"] for r in P.records(spark, target))


def test_one_writer_a_generation(spark, tmp_path):
    target, record = str(tmp_path / "out"), {"attempt": "x", "rows": 0, "floor": None}
    assert P.compare_and_set(spark, target, 1, {**record, "stream": "a", "batch": 0})
    assert not P.compare_and_set(spark, target, 1, {**record, "stream": "b", "batch": 0})
    assert P.commit(spark, target, {**record, "stream": "b", "batch": 0})
    assert not P.commit(spark, target, {**record, "stream": "a", "batch": 0})
    # A claim whose writer died before it was filled is passed over.
    open(f"{target}/log/{3:020d}.json", "w").close()
    assert P.commit(spark, target, {**record, "stream": "a", "batch": 1})
    assert [(r["generation"], r["stream"], r["batch"]) for r in P.records(spark, target)] == [(1, "a", 0), (2, "b", 0), (4, "a", 1)]
    assert rows_of(spark, target) == []
