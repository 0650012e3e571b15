"""Shared pieces: table reading, sizing, word hashing on raw UTF-8 bytes.

Text travels to Python as binary and is split by byte tables, so no word is
ever decoded. Hashes are polynomial prefix hashes modulo 2**64 that are mixed
afterwards; NumPy computes them for a whole block of documents at once.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 0x9E3779B97F4A7C15
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z: every other byte turns into a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Words of `[^\x20\x09-\x0D]+`: only white space turns into a space.
PLAIN = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch of whole texts can weigh."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder: the one that ``spark.checkpoint.dir`` names.

    Only a local session that names none gets a temporary one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="marlstone-checkpoint-")
        context.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """A folder of its own for tables in the shared checkpoint folder."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 in a text column (one pass of partial sums)."""
    return docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(size: int, target: int, least: int = 8) -> int:
    """Number of parts so that each holds about ``target`` bytes, whatever the input's size."""
    return max(least, -(-size // target))


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix = _splitmix
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BYTES = _splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEED))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def blocks(texts: list[bytes | None], most: int = 1 << 20):
    """Runs (first, last + 1) of documents of about ``most`` bytes together; a longer document is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def word_spans(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word its hash, start and end in the texts joined by a space; and each text's number of words."""
    joined = np.frombuffer(b" ".join([t or b"" for t in texts]).translate(table) + b" ", np.uint8)
    inside = (joined != 32).view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers_to(len(joined) + 1)
    total = np.empty(len(joined) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[joined] * power[: len(joined)], out=total[1:])
    hashes = _splitmix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    until = np.cumsum([(len(t) if t else 0) + 1 for t in texts])
    return hashes, starts, ends, np.diff(np.searchsorted(starts, until), prepend=0)


def words_of(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and, for every document, how many words it has."""
    hashes, _, _, n_words = word_spans(texts, table)
    return hashes, n_words


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive values."""
    n = max(0, len(hashes) - k + 1)
    out = hashes[:n] + np.uint64((SEED * (salt + 1)) % (1 << 64))
    for j in range(1, k):
        out = out * np.uint64(BASE) + hashes[j : n + j]
    return _splitmix(out)


def fitting(n_words: np.ndarray, k: int) -> np.ndarray:
    """For the runs of k words in documents laid end to end: does a run stay in one document?"""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    n = max(0, len(doc) - k + 1)
    return doc[:n] == doc[k - 1 :] if n else np.zeros(0, bool)


def trim() -> None:
    """Give freed memory back, so that a reused worker does not keep the peak of its largest group."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def split_by(bucket: np.ndarray, n: int):
    """(bucket, indexes) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]
