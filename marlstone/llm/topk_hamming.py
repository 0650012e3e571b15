"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments. If two codes differ in r bits, one of m segments
differs in r // m bits at most. So codes are looked up by each segment with all
values at distance 0, then 1, and so on; after radius s every code up to
distance m * (s + 1) - 1 has been met, and a query is done once its k-th
verified distance is not beyond that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import parts_for, small_batches


def sign_codes(vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One bit for each dimension: is it above 0? The first is the highest bit of the first byte; missing bits of the last byte are 0.

    Null or empty vectors have no code and are left out. Null components count as not above 0.
    """
    source = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.col(key).isNotNull())
    bits = F.array_join(F.transform(column, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    padded = F.rpad(bits, F.ceil(F.size(column) / 8).cast("int") * 8, F.lit("0"))
    # Eight bits at a time, as two hexadecimal digits.
    digits = F.transform(
        F.sequence(F.lit(1), F.length("bits"), F.lit(8)), lambda i: F.lpad(F.conv(F.substring(F.col("bits"), i, F.lit(8)), 2, 16), 2, "0")
    )
    return source.select(F.col(key).cast("bigint").alias("id"), padded.alias("bits")).select("id", F.unhex(F.array_join(digits, "")).alias("code"))


class Index:
    """Codes of one length under all their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = np.unpackbits(codes, axis=1)
        n, width = bits.shape
        wanted = max(1, round(width / max(4, min(20, int(np.log2(max(2, n)))))))
        self.edges = np.linspace(0, width, wanted + 1).astype(int)
        self.tables = []
        for lo, hi in zip(self.edges[:-1], self.edges[1:], strict=True):
            values = self.segment(bits, lo, hi)
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << (hi - lo)) + 1))))

    @staticmethod
    def segment(bits: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return bits[:, lo:hi].astype(np.int64) @ (1 << np.arange(hi - lo - 1, -1, -1, dtype=np.int64))

    def search(self, query: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest codes (all, if fewer) by distance, then key: their numbers and distances."""
        bits = np.unpackbits(query[None, :], axis=1)
        own = [int(self.segment(bits, lo, hi)[0]) for lo, hi in zip(self.edges[:-1], self.edges[1:], strict=True)]
        met = np.zeros(len(self.codes), bool)
        best, dist, m, s = np.zeros(0, int), np.zeros(0, int), len(own), 0
        while True:
            found = []
            for (order, cuts), value, lo, hi in zip(self.tables, own, self.edges[:-1], self.edges[1:], strict=True):
                if s <= hi - lo:
                    masks = _masks(int(hi - lo), s) ^ value
                    first, size = cuts[masks], cuts[masks + 1] - cuts[masks]
                    first, size = first[size > 0], size[size > 0]
                    if len(size):
                        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        found.append(order[at])
            new = np.unique(np.concatenate(found)) if found else best[:0]
            new = new[~met[new]]
            met[new] = True
            d = np.bitwise_count(self.codes[new] ^ query).sum(axis=1).astype(int)
            best, dist = np.r_[best, new], np.r_[dist, d]
            order = np.lexsort((key[best], dist))[:k]
            best, dist = best[order], dist[order]
            if met.all() or len(best) == k and dist[-1] <= m * (s + 1) - 1:
                return best, dist
            s += 1


_known: dict[tuple[int, int], np.ndarray] = {}


def _masks(width: int, ones: int) -> np.ndarray:
    if (width, ones) not in _known:
        _known[width, ones] = np.array([sum(1 << i for i in c) for c in combinations(range(width), ones)], np.int64)
    return _known[width, ones]


FOUND = "code binary, skip bigint, distance int, ids array<struct<id:bigint,n:bigint>>"


def _searched(k: int):
    def run(key, left, right):
        out: list[tuple] = []
        codes, ids = right.column("code").to_pylist(), right.column("ids").to_pylist()
        queries = list(zip(left.column("code").to_pylist(), left.column("skip").to_pylist(), strict=True))
        skips = {s for _, s in queries if s is not None}
        for size in {len(c) for c in codes}:
            own = [i for i, c in enumerate(codes) if len(c) == size]
            packed = np.frombuffer(b"".join(codes[i] for i in own), np.uint8).reshape(len(own), size)
            index, least = Index(packed), np.array([ids[i][0]["id"] for i in own])
            held: dict[int, list[int]] = {s: [] for s in skips}
            for j, i in enumerate(own):
                for x in ids[i]:
                    if x["id"] in held:
                        held[x["id"]].append(j)
            for q, skip in queries:
                if len(q) != size:
                    continue
                at, names, where = index, least, range(len(own))
                if skip is not None and held[skip]:
                    # Codes are ranked by their least other id; those of this id alone are left out.
                    rest = {j: [x["id"] for x in ids[own[j]] if x["id"] != skip] for j in held[skip]}
                    names = least.copy()
                    for j, others in rest.items():
                        names[j] = others[0] if others else 0
                    gone = [j for j, others in rest.items() if not others]
                    if gone:
                        where = np.setdiff1d(np.arange(len(own)), gone)
                        if not len(where):
                            continue
                        at, names = Index(packed[where]), names[where]
                best, dist = at.search(np.frombuffer(q, np.uint8), names, k)
                for b, d in zip(best, dist, strict=True):
                    out.append((q, skip, int(d), [x for x in ids[own[where[b]]] if x["id"] != skip]))
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["code", "skip", "distance", "ids"])

    return run


def top_k(codes: DataFrame, queries: DataFrame, *, k: int = 10, index_rows: int = 1 << 18, query_rows: int = 1024, copies: int = 64) -> DataFrame:
    """The k nearest other rows of each query by Hamming distance, ties by id: query_id, rank, id, distance.

    Both inputs have id and code (binary; null codes are left out). Rows of one
    code and id are counted. A code is one entry with its k + 1 least different
    ids, found by a limit that is applied before the shuffle, so a code that a
    third of all rows have is no burden and nothing is lost: of equal distances
    the lesser ids win. Entries are dealt into blocks of about ``index_rows`` and
    distinct queries into blocks of about ``query_rows``, larger ones where that
    would copy the index more often than ``copies``; each pair of blocks is
    searched by its own index and gives k + 1 entries a query. A code is compared
    with codes of its length only. A query is not its own neighbour; with fewer
    rows there are fewer neighbours. Repeated ids are rows of their own, but
    never neighbours of their id. An id that has one code has one place among
    k + 1, so queries of a code share a search; an id with several codes has
    searches of its own that skip it.
    """
    small_batches(codes.sparkSession, 4000)
    counted = codes.where("code is not null").select(F.col("code").alias("code"), F.col("id").alias("id")).groupBy("code", "id").agg(F.count("*").alias("n"))
    ranked = counted.select("*", F.row_number().over(Window.partitionBy("code").orderBy("id")).alias("place"))
    entries = ranked.where(F.col("place") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("ids"))
    several = counted.groupBy("id").agg(F.count("*").alias("codes")).where("codes > 1").select(F.col("id").alias("query_id"), F.col("id").alias("skip"))
    own = queries.where("code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("code")).join(several, "query_id", "left")
    asked = own.select("code", "skip").distinct()
    n_index, n_query = (parts_for(df.count(), rows, 1) for df, rows in ((codes, index_rows), (asked, query_rows)))
    # Many queries make larger blocks, up to what a task holds, so that an index is built once for more of them.
    n_query = max(min(n_query, copies), -(-n_query // 64))
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("code", "skip", block(n_query, "code", "skip").alias("q"), every(n_index).alias("i"))
    right = entries.select("code", "ids", every(n_query).alias("q"), block(n_index, "code").alias("i"))
    found = left.groupBy("q", "i").cogroup(right.groupBy("q", "i")).applyInArrow(_searched(k + 1), FOUND)
    single = found.select("code", "skip", "distance", F.inline("ids"))
    by_query = Window.partitionBy("code", "skip").orderBy("distance", "id")
    near = single.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1).groupBy("code", "skip").agg(
        F.array_sort(F.collect_list(F.struct("distance", "id", "n"))).alias("near")
    )
    near = near.select(F.col("code").alias("near_code"), F.col("skip").alias("near_skip"), "near")
    own = own.join(near, (F.col("code") == F.col("near_code")) & F.col("skip").eqNullSafe(F.col("near_skip")))
    others = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    rows = F.slice(F.flatten(F.transform(others, lambda x: F.array_repeat(x, F.least(x["n"], F.lit(k)).cast("int")))), 1, k)
    return own.select("query_id", F.posexplode(rows).alias("rank", "near")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("near.id").alias("id"), F.col("near.distance").alias("distance")
    )
