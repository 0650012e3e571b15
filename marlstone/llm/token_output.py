"""Binary training output: best-fit-decreasing packing into token id matrices.

Packing is done inside a partition, pool by pool: a pool takes pieces until it
holds ``pool_tokens`` tokens, is packed and written out. So nothing is shuffled,
memory is bounded by the pool, and a lost task packs its own rows again; the
price is at most a few partly filled sequences a pool.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches
from marlstone.llm.packing import token_ids


class Capacities:
    """Segment tree over free room: which bins have the least room that still suffices?"""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node //= 2

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of least room >= length."""
        node = self.leaves + length
        if not self.count[node]:
            # Climb to the first right sibling that holds a bin, then go down its left edge.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Numbers of the pieces in each bin: longest piece first, each into the bin that it fits most tightly."""
    free, out = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if found := free.take(n):
            room, number = found
        else:
            room, number = size, len(out)
            out.append([])
        out[number].append(i)
        if room - n:
            free.put(room - n, number)
    return out


SEQUENCE = "doc_ids array<bigint>, pieces array<int>, starts array<bigint>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


def _written(path: str, size: int, end_id: int, pad_id: int, pool_tokens: int):
    end = np.array([end_id], "<u4").tobytes()
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
    names = ["doc_ids", "pieces", "starts", "cu_seqlens", "n_tokens", "ids", "positions"]

    def packed(pool):
        lengths = [len(d) // 4 for _, _, _, d in pool]
        rows = []
        for own in best_fit_decreasing(lengths, size):
            edges = np.r_[0, np.cumsum([lengths[i] for i in own])]
            n = int(edges[-1])
            ids = b"".join(pool[i][3] for i in own) + np.full(size - n, pad_id, "<u4").tobytes()
            positions = np.r_[np.arange(n) - np.repeat(edges[:-1], np.diff(edges)), np.zeros(size - n, np.int64)].astype("<u4").tobytes()
            rows.append(([pool[i][0] for i in own], [pool[i][1] for i in own], [pool[i][2] for i in own], edges.tolist(), n, ids, positions))
        for first in range(0, len(rows), 500):
            columns = zip(*rows[first : first + 500], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        encode, pool, held = token_ids(path), [], 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    pool.append((doc, k, at // 4, data[at : at + 4 * size]))
                    held += len(pool[-1][3]) // 4
                    if held >= pool_tokens:
                        yield from packed(pool)
                        pool, held = [], 0
        if pool:
            yield from packed(pool)

    return run


def packed_sequences(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 0, pad_id: int = 0, pool_tokens: int = 4_000_000) -> DataFrame:
    """Rows of packed id matrices: one sequence of ``size`` ids each.

    ``docs`` has doc_id and text; other columns are ignored. A document's ids
    are followed by ``end_id``; longer ones are split into pieces of ``size``
    tokens, the last one shorter, so joining a document's pieces by number gives
    all its ids back. Each row has doc_ids, pieces (numbers from 0) and starts
    (ids of the document before the piece), cu_seqlens (cumulative lengths from
    0), n_tokens, ids (little-endian unsigned 32-bit, padded with ``pad_id``) and
    positions (same form; they begin at 0 with each piece, 0 in the padding).

    Null and empty texts are one piece that holds the end id. Repeated rows are
    packed each. An empty table has no sequences.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_written(path, size, end_id, pad_id, pool_tokens), SEQUENCE)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Write the matrices as Parquet, one row a sequence; executors write to the shared store through Spark."""
    sequences.write.mode("overwrite").option("compression", "zstd").parquet(path)


def matrix(rows: list[bytes], size: int) -> np.ndarray:
    """Ids (or positions) of some sequences as a matrix."""
    return np.frombuffer(b"".join(rows), "<u4").reshape(-1, size)

