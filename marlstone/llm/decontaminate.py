"""Benchmark decontamination by one Aho-Corasick automaton."""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import FOLD, blocks, checkpointed, small_batches, words_of

STATE = "doc_id bigint, text binary, n_words bigint, items array<string>, spans array<struct<start:int,stop:int>>"


class Patterns:
    """One automaton over the windows of items; a word is three characters that stand for its number in the items' vocabulary.

    The three come from ranges of their own, so a match always begins and ends
    with a word. Words are told apart by 64-bit hashes.
    """

    def __init__(self, items: list[tuple[int, bytes | None]], size: int):
        texts = [t for _, t in items]
        hashes, n_words = words_of(texts, FOLD)
        self.vocabulary = np.unique(hashes)
        own = self.coded(np.searchsorted(self.vocabulary, hashes)).tobytes().decode("latin-1")
        found: dict[str, set[str]] = {}
        at = 0
        for (item, _), n in zip(items, n_words.tolist(), strict=True):
            k = min(n, size)
            for i in range(at, at + n - k + 1 if n else at):
                found.setdefault(own[3 * i : 3 * (i + k)], set()).add(str(item))
            at += n
        self.least = min((len(x) // 3 for x in found), default=0)
        self.items: list[list[str]] = []
        self.machine = ahocorasick.Automaton()
        for window, names in found.items():
            self.machine.add_word(window, (len(self.items), len(window) // 3))
            self.items.append(sorted(names))
        if found:
            self.machine.make_automaton()

    @staticmethod
    def coded(numbers: np.ndarray) -> np.ndarray:
        if len(numbers) and numbers.max() >= 85**3:
            raise ValueError("more than 614,125 different words in a block of items: make block_bytes smaller")
        return np.stack([numbers % 85, 85 + numbers // 85 % 85, 170 + numbers // 7225], axis=1).astype(np.uint8)

    def scan(self, texts: list[bytes | None]):
        """For each text its number of words and a list of matches: word behind the last, words, window."""
        for first, last in blocks(texts):
            hashes, n_words = words_of(texts[first:last], FOLD)
            if not self.items or not len(hashes):
                yield from ((n, []) for n in n_words.tolist())
                continue
            number = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[number] == hashes
            until = np.cumsum(n_words)
            # Only runs of known words in one document can hold a match.
            edge = np.zeros(len(hashes) + 1, bool)
            edge[until] = edge[0] = True
            edge[1:-1] |= known[1:] != known[:-1]
            cuts = np.flatnonzero(edge)
            good = known[cuts[:-1]] & (np.diff(cuts) >= self.least)
            begins, ends = cuts[:-1][good], cuts[1:][good]
            matches: list[list] = [[] for _ in n_words]
            if len(begins):
                whole = self.coded(number).tobytes().decode("latin-1")
                docs = np.searchsorted(until, begins, "right")
                offset = begins - (until - n_words)[docs]
                for d, o, s, e in zip(docs.tolist(), offset.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    for end, (window, k) in self.machine.iter(whole[3 * s : 3 * e]):
                        matches[d].append((o + (end + 1) // 3, k, window))
            yield from zip(n_words.tolist(), matches, strict=True)


_held: dict[str, Patterns] = {}


def patterns(key: str, items: list, size: int) -> Patterns:
    """The patterns of a block of items, built once in a worker, which keeps one block's."""
    if key not in _held:
        _held.clear()
        _held[key] = Patterns(items, size)
    return _held[key]


def _scanner(key: str, wanted: list, size: int):
    def run(batches):
        own = patterns(key, wanted, size)
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            told = zip(batch.column("doc_id").to_pylist(), texts, batch.column("items").to_pylist(), batch.column("spans").to_pylist(), own.scan(texts), strict=True)
            for doc, text, items, spans, (n, matches) in told:
                covered = [(x["start"], x["stop"]) for x in spans]
                if matches:
                    items = sorted({*items, *(i for w in {w for _, _, w in matches} for i in own.items[w])})
                    both = np.asarray([(e - k, e) for e, k, _ in matches] + covered)
                    covered = merged(both[:, 0], both[:, 1])
                rows.append((doc, text, n, items, [{"start": s, "stop": e} for s, e in covered]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(TYPES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, TYPES, strict=True)],
                names=["doc_id", "text", "n_words", "items", "spans"],
            )

    return run


TYPES = [
    pa.int64(),
    pa.binary(),
    pa.int64(),
    pa.list_(pa.string()),
    pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
]


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans; touching ones join."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(stops[order])
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[cut].tolist(), e[np.r_[cut[1:] - 1, len(e) - 1]].tolist(), strict=True))


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks, each with a key of its own."""
    wanted = benchmark.select(F.col("item_id").alias("item"), F.col("text").cast("binary").alias("words"))
    size = wanted.select(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        block = wanted.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b) if n > 1 else wanted
        yield uuid.uuid4().hex, [(r["item"], None if r["words"] is None else bytes(r["words"])) for r in block.toLocalIterator()]


def without_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """Rows of ``docs``, all columns, in whose own text ``contaminated_spans`` finds nothing."""
    small_batches(docs.sparkSession)

    def clean(key: str, items: list):
        def run(batches):
            own = patterns(key, items, window)
            for batch in batches:
                found = own.scan(batch.column("text").cast(pa.binary()).to_pylist())
                yield batch.filter(pa.array([not m for _, m in found], pa.bool_()))

        return run

    out = docs
    for b, (key, items) in enumerate(_blocks(benchmark, block_bytes)):
        out = (out if b == 0 else checkpointed(out)).mapInArrow(clean(key, items), docs.schema)
    return out


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 2 << 20
) -> DataFrame:
    """Words of documents that lie in a window of a benchmark item.

    ``docs`` has doc_id and text, ``benchmark`` has item_id and text; other
    columns are ignored. Both sides are lower-cased (A-Z) and cut into words of
    digits, letters and non-ASCII characters. Each run of ``window`` item words
    (a shorter item is one run) is a pattern of one automaton, which reads each
    normalised document once; match offsets are mapped back to word numbers.

    The items are a stated query set. While their text is at most
    ``block_bytes`` (2 MB are about 270 MB in a worker) it is one automaton and the job has no shuffle. Beyond that
    the items are dealt into blocks of about that size by a hash of their id,
    each block is one automaton, and a document's spans from all blocks are
    merged (the state between two blocks is checkpointed).

    Nulls and empty texts have no words. Repeated document rows each give a row
    and repeated items count once. An empty benchmark hits nothing. Returns
    doc_id, n_words, n_hit (words hit), n_items, items (ids as sorted strings),
    spans (half-open word ranges) and text.
    """
    small_batches(docs.sparkSession)
    state = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:int,stop:int>>").alias("spans"),
    )
    for b, (key, items) in enumerate(_blocks(benchmark, block_bytes)):
        state = (state if b == 0 else checkpointed(state)).mapInArrow(_scanner(key, items, window), STATE)
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["stop"] - s["start"])
    return state.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans",
        F.col("text").cast("string").alias("text"),
    )
