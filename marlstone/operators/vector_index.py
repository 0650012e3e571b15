"""Approximate vector search: a partitioned inverted file in Parquet.

Vectors of length one are dealt to the nearest of a bounded number of centres,
which are fitted on a bounded sample. A list of the index is one centre's
vectors, cut into blocks so that a list that holds a third of all rows is
shared out. A question is a row of a table: it is sent to the blocks of its
nearest centres, and only k rows a question and block come back. Small lists share
a block: a question goes there once, with the numbers of the lists that it probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.graph import released, stored
from marlstone.operators.retrieval import best_of_pair, top_n


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


#: Rows of scores of vectors against centres that a task holds at once, and rows that a batch of routed questions has at most.
SCORED_ROWS, ROUTED_ROWS = 1024, 1 << 14


def nearest_list(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector; scores are held for ``SCORED_ROWS`` vectors at a time."""
    own = [(_unit(vectors.iloc[i : i + SCORED_ROWS]) @ centres.T).argmax(axis=1) for i in range(0, len(vectors), SCORED_ROWS)]
    return np.concatenate(own).astype("int32")


def _own_list(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The same for a sample of unit vectors."""
    own = [(sample[i : i + SCORED_ROWS] @ centres.T).argmax(axis=1) for i in range(0, len(sample), SCORED_ROWS)]
    return np.concatenate([np.zeros(0, np.int64), *own])


def routed_rows(pdf: pd.DataFrame, centres: np.ndarray, wanted: int) -> Iterator[pd.DataFrame]:
    """A row for each question (qid, embedding) and each of its ``wanted`` nearest centres, in batches of about ``ROUTED_ROWS`` rows."""
    at_once = max(1, min(SCORED_ROWS, ROUTED_ROWS // wanted))
    for i in range(0, len(pdf), at_once):
        part = pdf.iloc[i : i + at_once]
        near = np.argpartition(-(_unit(part["embedding"]) @ centres.T), wanted - 1, axis=1)[:, :wanted]
        yield pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), wanted), "embedding": np.repeat(part["embedding"].to_numpy(), wanted), "list": near.ravel().astype("int32")})


def grouped_rows(routed: pd.DataFrame, wanted: int, group_of: np.ndarray) -> pd.DataFrame:
    """Of rows of ``routed_rows`` one for each question and group of lists, with its probed lists there; lists of group -1 have no vectors."""
    at, group, lists = [], [], []
    for i, row in enumerate(routed["list"].to_numpy().reshape(-1, wanted)):
        row = row[np.argsort(group_of[row], kind="stable")]
        own = group_of[row]
        first = np.flatnonzero(np.diff(own, prepend=-2))
        for g, part in zip(own[first], np.split(row, first[1:]), strict=True):
            if g >= 0:
                at.append(i * wanted)
                group.append(g)
                lists.append(part)
    out = routed[["qid", "embedding"]].iloc[at].reset_index(drop=True)
    return out.assign(group=np.array(group, "int32"), lists=pd.Series(lists, dtype=object))


#: Blocks that lists are packed into on small indexes, so that tasks share them; rows that a block has at least for that, and at most.
BLOCKS, LEAST_ROWS, BLOCK_ROWS = 24, 1 << 12, 1 << 15
#: Questions that are searched at a time, at least and at most.
QUESTION_ROWS = 1 << 12, 1 << 14


def list_groups(sizes: dict[int, int], lists: int) -> np.ndarray:
    """Group of each list: lists in a row share one up to a block's rows, a larger list has its own; -1 for lists without vectors."""
    most = min(BLOCK_ROWS, max(LEAST_ROWS, sum(sizes.values()) // BLOCKS))
    out, group, held = np.full(lists, -1), 0, 0
    for i in sorted(sizes):
        if held and held + sizes[i] > most:
            group, held = group + 1, 0
        out[i] = group
        held += sizes[i]
    return out


def fit_centres(sample: np.ndarray, lists: int, *, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Spherical k-means over a sample of unit vectors; a centre that loses its last row takes a random one."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = _own_list(sample, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        empty = np.bincount(own, minlength=len(centres)) == 0
        total[empty] = sample[rng.integers(0, len(sample), empty.sum())]
        centres = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300)
    return centres


def fit_probes(sample: np.ndarray, centres: np.ndarray, *, recall: float, k: int = 20, questions: int = 500) -> int:
    """Lists to probe so that a sampled question meets the share ``recall`` of its k nearest other sampled vectors."""
    asked = sample[:: max(1, len(sample) // questions)]
    own = _own_list(sample, centres)
    # Some questions at a time, so that the driver holds few scores.
    near = []
    for i in range(0, len(asked), 32):
        score = asked[i : i + 32] @ sample.T
        score[np.arange(len(score)), np.arange(0, len(sample), max(1, len(sample) // questions))[i : i + len(score)]] = -np.inf
        near.append(np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)].copy())
    near = np.concatenate(near)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else len(centres)


def build_index(vectors: DataFrame, path: str, *, key: str = "vec_id", column: str = "embedding", lists: int | None = None, most_lists: int = 4096, recall: float = 0.95, sampled: int = 50_000, block_rows: int = 1 << 15) -> None:
    """Write an index of every vector (key, embedding) under ``path``: centres, the lists' sizes, and vectors partitioned by list.

    ``lists`` is the root of the number of rows unless it is given, ``most_lists``
    at most, so centres are data that a driver may hold. How many lists a question
    probes is fitted to ``recall`` on the sample too and kept with the index: few
    where vectors form groups, about half of them where they have no structure. Null
    vectors and ones without components are left out; all others must have one length.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)).select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<float>").alias("embedding"))
    n = rows.count()
    wanted = min(most_lists, lists or max(1, math.isqrt(n)))
    some = [r["embedding"] for r in rows.where(F.rand(11) < min(1.0, sampled / max(1, n))).select("embedding").collect()] or [r["embedding"] for r in rows.select("embedding").limit(1).collect()]
    sample = _unit(pd.Series(some)) if some else np.zeros((0, 1))
    some = len(some)
    centres = fit_centres(sample, wanted) if some else sample
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(fit_probes(sample, centres, recall=recall) if some else 0,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")

    # A list that holds more than a block by the sample has files for about as many blocks.
    share = np.bincount(_own_list(sample, centres), minlength=wanted) / len(sample) if some else np.zeros(wanted)
    files = np.maximum(1, np.ceil(2 * share * n / block_rows)).astype(np.int64)

    def dealt(batches):
        for pdf in batches:
            if len(pdf):
                pdf["list"] = nearest_list(pdf["embedding"], centres)
                pdf["salt"] = (pd.util.hash_array(pdf["key"].to_numpy()) % files[pdf["list"]].astype(np.uint64)).astype("int32")
                yield pdf[["list", "salt", "key", "embedding"]]

    placed = rows.mapInPandas(dealt, "list int, salt int, key bigint, embedding array<float>")
    with released(spark):
        placed.repartition("list", "salt").write.partitionBy("list").parquet(f"{path}/vectors")
    written = spark.read.schema("key bigint, embedding array<float>, salt int, list int").parquet(f"{path}/vectors")
    written.groupBy("list").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).coalesce(1).write.parquet(f"{path}/sizes")


def search_index(spark: SparkSession, path: str, questions: DataFrame, k: int, *, probes: int | None = None, key: str = "vec_id", question_rows: int | None = None) -> DataFrame:
    """Nearest vectors of each question (qid, embedding) by cosine, from the index alone: qid, key, score, rank; negative scores are dropped.

    A question looks into the lists of its ``probes`` nearest centres (as many as the
    index was fitted for, unless given). No question reaches the driver; the centres do, whose
    number is bounded. Only probed lists are read. Ties go to the lesser key. About ``question_rows``
    questions (a 64th of the index's rows within ``QUESTION_ROWS``, unless given) are searched at a time and their shuffle files given back
    (the results are stored, unless all are searched at once), so the disk that is needed beside them grows with the index only.
    """
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])
    asked = questions.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("qid", F.col("embedding").cast("array<float>").alias("embedding"))
    sizes = spark.read.parquet(f"{path}/sizes")
    wanted = min(len(centres), probes or spark.read.parquet(f"{path}/probes").first()["probes"])
    kind = asked.schema["qid"].dataType.simpleString()
    held = {r["list"]: (r["n"], r["blocks"]) for r in sizes.collect()}
    group_of = list_groups({i: n for i, (n, _) in held.items()}, len(centres))
    blocks = dict.fromkeys(group_of.tolist(), 1)
    # All lists of a group are cut alike.
    for i, (_, n) in held.items():
        blocks[group_of[i]] = max(blocks[group_of[i]], n)
    places = spark.createDataFrame([(i, int(g), blocks[g]) for i, g in enumerate(group_of.tolist()) if g >= 0], "list int, group int, blocks int")

    def routed(batches):
        for pdf in batches:
            if len(pdf) and len(centres):
                for frame in routed_rows(pdf, centres, wanted):
                    yield grouped_rows(frame, wanted, group_of)

    def searched(asked: DataFrame) -> DataFrame:
        probed = asked.mapInPandas(routed, f"qid {kind}, embedding array<float>, group int, lists array<int>")
        left = probed.join(F.broadcast(places.select("group", "blocks").distinct()), "group").select("qid", "embedding", "lists", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        # The lists that some question probes: at most as many numbers as there are centres.
        lists = sorted(r["list"] for r in probed.select(F.explode("lists").alias("list")).distinct().collect())
        rows = spark.read.schema("key bigint, embedding array<float>, salt int, list int").parquet(f"{path}/vectors").where(F.col("list").isin(lists))
        right = rows.join(F.broadcast(places), "list").select("key", "embedding", "list", "group", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"))
        found = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(best_of_pair(k), f"qid {kind}, key bigint, score double")
        return top_n(found.withColumnRenamed("key", key), k, by=[F.round("score", 9).desc(), F.col(key)])

    question_rows = question_rows or min(QUESTION_ROWS[1], max(QUESTION_ROWS[0], sum(n for n, _ in held.values()) // 64))
    parts = max(1, -(-asked.count() // question_rows))
    if parts == 1:
        return searched(asked)
    some = [stored(searched(asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i))) for i in range(parts)]
    return reduce(DataFrame.unionByName, some)
