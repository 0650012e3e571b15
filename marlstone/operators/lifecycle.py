"""Lifecycle ids: base-36 numbers of a day and a 12-bit hash."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lookup import ranked

#: Ids of one day, and the number that the first day has (a parameter of the scheme).
A_DAY, OFFSET = 4096, 60_000_000


def _hash12(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: int.from_bytes(hashlib.blake2s(str(k).encode(), digest_size=2).digest(), "big") & 0xFFF).astype("int64")


def minted(rows: DataFrame, *, key: str, day: str, offset: int = OFFSET, hashed: Column | None = None, block: int = 1 << 16) -> DataFrame:
    """An id for each key: the day's block plus the key's 12-bit hash, moved past ids that an earlier key took.

    Linear probing in the order of (day block + hash, key): the n-th key gets the
    larger of its own number and one past the id before it, so n plus a running
    maximum of own number less n, over all days. A day with more keys than its
    ids, or with keys at its end, runs into the next day's block, whose keys then move on too, so no
    id is given twice. ``hashed`` takes the place of the blake2s of the key. Rows are
    ranked over all tasks, and the maximum runs within blocks of places and over
    their maxima. Repeated keys get an id each; rows without a day have none.
    """
    hash12 = F.pandas_udf(_hash12, "bigint")
    own = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("bigint") * A_DAY + F.lit(offset) + (hash12(F.col(key).cast("string")) if hashed is None else hashed.cast("bigint"))
    placed = ranked(rows.where(F.col(day).isNotNull()).select(F.col(key), own.alias("own")), F.col("own"), F.col(key))
    held = placed.select(key, "place", (F.col("own") - F.col("place")).alias("lead"), F.floor(F.col("place") / block).cast("bigint").alias("block"))
    running = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # One row for each block of places.
    most = held.groupBy("block").agg(F.max("lead").alias("most"))
    before = most.select("block", F.max("most").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    number = F.greatest(F.max("lead").over(running), F.col("before")) + F.col("place")
    told = held.join(before, "block").select(key, number.alias("number"))
    return told.select(key, "number", F.lower(F.conv(F.col("number").cast("string"), 10, 36)).alias("lifecycle_id"))
