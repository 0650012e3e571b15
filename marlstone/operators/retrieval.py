"""Ranked retrieval. Questions come as a table with a qid, so one plan answers a batch of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.operators.graph import checkpointed

#: A broadcast side may have so many rows; beyond that a shuffled plan is used.
MOST_BROADCAST_ROWS = 50_000


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose size has been checked, else the side as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bm25(docs: DataFrame, questions: DataFrame, *, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 score of every document that holds a word of a question: qid, key, score.

    ``questions`` has qid and text, ``key`` is different in each row. Texts are
    tokenised once; only lengths and the tokens that some question asks for leave
    the scan, combined before the one shuffle, and the statistics are taken from
    that small written table.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = small(asked.select("term").distinct())
    # One scan: of each text its length and what it holds of the asked terms stays, as a written table.
    words = docs.select(F.col(key), F.explode(F.array(tokens(F.col("text")))).alias("words")).select(key, F.size("words").alias("dl"), F.explode_outer("words").alias("term"))
    hits = words.join(terms.withColumn("asked", F.lit(True)), "term", "left").select(key, "dl", F.when(F.col("asked"), F.col("term")).alias("term"))
    counted = checkpointed(hits.groupBy(key, "dl", "term").agg(F.count("*").alias("tf")))
    # Each text once: it has a row without a term, or rows of asked terms only.
    texts = counted.groupBy(key, "dl").agg(F.count("*")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = counted.where("term is not null")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = postings.join(small(df), "term").crossJoin(F.broadcast(texts))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighed.select(key, "term", part.alias("part"))
    return scored.join(small(asked), "term").groupBy("qid", key).agg(F.sum("part").alias("score"))


def top_n(ranked: DataFrame, n: int, *, by: list[Column], within: str = "qid", rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; the limit also runs before the shuffle."""
    return ranked.withColumn(rank, F.row_number().over(Window.partitionBy(within).orderBy(*by)).cast("bigint")).where(F.col(rank) <= n)


def best_of_pair(k: int):
    """The k best vectors of each question of a block; where questions have ``lists``, of vectors whose ``list`` is one of them."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        qid, key, score = [], [], []
        if len(left) and len(right):
            q, x = (np.stack(side["embedding"].to_numpy()).astype(np.float64) for side in (left, right))
            q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (q, x))
            own, names = right["key"].to_numpy(), left["qid"].to_numpy()
            if "lists" in left:
                lists, of = np.unique(right["list"].to_numpy(), return_inverse=True)
                probed = left["lists"].to_numpy()
            # Some questions at a time, so that scores stay small.
            for first in range(0, len(q), 256):
                scores = q[first : first + 256] @ x.T
                if "lists" in left:
                    scores[~np.stack([np.isin(lists, own_lists) for own_lists in probed[first : first + 256]])[:, of]] = -1.0
                for name, s in zip(names[first : first + 256], scores, strict=True):
                    rounded = np.round(s, 9)
                    at = np.flatnonzero((s >= 0) & (rounded >= (np.partition(rounded, -k)[-k] if len(s) > k else -1)))
                    at = at[np.lexsort((own[at], -rounded[at]))[:k]]
                    qid.append(np.repeat(name, len(at)))
                    key.append(own[at])
                    score.append(s[at])
        join = lambda parts: np.concatenate(parts) if parts else []
        return pd.DataFrame({"qid": join(qid), "key": join(key), "score": join(score)})

    return run


def block_pairs(questions: DataFrame, vectors: DataFrame, k: int, *, by: list[str], question_rows: int = 4096) -> DataFrame:
    """The k best vectors of each question within each block that both name: qid, key, score (cosine, not negative).

    ``questions`` has qid, embedding and the columns ``by``, ``vectors`` key,
    embedding and these columns. A block's questions are cut into parts of about
    ``question_rows``, to each of which its vectors go, so a task holds one part
    and one block.
    """
    parts = max(1, -(-questions.count() // question_rows))
    asked = questions.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    wanted = asked.select(*by, "part").distinct()
    both = [*by, "part"]
    # Aliases, as both sides may come from one table.
    sent = vectors.join(wanted, by).select(*[F.col(c).alias(c) for c in (*both, "key", "embedding")])
    kinds = f"qid {questions.schema['qid'].dataType.simpleString()}, key bigint, score double"
    return asked.groupBy(*both).cogroup(sent.groupBy(*both)).applyInPandas(best_of_pair(k), kinds)


def vector_top_k(vectors: DataFrame, questions: DataFrame, k: int, *, key: str = "vec_id", block_rows: int = 1 << 15, question_rows: int = 4096) -> DataFrame:
    """Exact cosine top k of each question (qid, embedding): qid, key, score, rank; negative scores are dropped.

    Vectors are dealt into blocks of about ``block_rows`` by a hash of their key and
    each part of about ``question_rows`` questions meets each block once; a pair
    gives k rows a question. Neither questions nor vectors reach the driver.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col(key).cast("bigint").alias("key"), "embedding", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    asked = questions.where(F.col("embedding").isNotNull()).select("qid", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = block_pairs(asked, rows, k, by=["block"], question_rows=question_rows)
    return top_n(found.withColumnRenamed("key", key), k, by=[F.round("score", 9).desc(), F.col(key)])


def fuse(lists: list[tuple[DataFrame, float]], *, key: str = "doc_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, key, rank) with a weight each: qid, key, score."""
    parts = [df.select("qid", key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("qid", key).agg(F.sum("part").alias("score"))


def pool(lists: list[tuple[DataFrame, str]], *, key: str = "doc_id") -> DataFrame:
    """Candidates of several retrievers with the sorted set of those that found each."""
    parts = [df.select("qid", key, F.lit(name).alias("source")) for df, name in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("qid", key).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def question_type(text: Column) -> Column:
    """navigational, instructional or explanatory by signal words, in this order; explanatory by default."""
    t = F.lower(text)
    return (
        F.when(t.rlike(r"\b(where|which file|find|locate|defined)\b"), "navigational")
        .when(t.rlike(r"\b(how do i|how to|steps|set up|install|configure)\b"), "instructional")
        .otherwise("explanatory")
    )


def confidence(score: Column, citations: Column, *, reranked: bool = True, lexical_only: bool = False) -> Column:
    """Band of an answer: high needs a score of .5 and two citations, low is under .1; without reranking medium at most."""
    if lexical_only:
        return F.lit("low")
    band = F.when(score < 0.1, "low")
    if reranked:
        band = band.when((score >= 0.5) & (citations >= 2), "high")
    return band.otherwise("medium")


def greedy_budget(ranked: DataFrame, *, budget: int, key: str, size: str) -> DataFrame:
    """In rank order take each row whose text still fits the budget, skipping those that do not (one small group a question)."""
    names = [f.name for f in ranked.schema.fields]

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        kept, used = [], 0
        for n in pdf[size].tolist():
            ok = used + n <= budget
            kept.append(ok)
            used += n if ok else 0
        return pdf[np.array(kept, bool)][names]

    return ranked.groupBy("qid").applyInPandas(take, ranked.schema)
