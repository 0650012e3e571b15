"""Toxicity by compression distance: which of two zstandard dictionaries makes a window shorter."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import BASE, blocks, mix, small_batches, word_spans

#: Letters of either case and every byte of a non-ASCII character; the rest separates.
LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A window is one word with spaces around it, repeated: alone it is too short for zstandard to compress at all.
REPEATS = 3
LEVEL = 19


def lowered(text: bytes | None) -> bytes:
    if not text:
        return b""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


@dataclass
class Spread:
    """Distinct words of texts: where each stands in ``buffer`` (a space on either side), how often it occurs, and (word, text) pairs."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    texts: np.ndarray
    n_texts: int

    def pieces(self, k: int, wanted: np.ndarray | None = None, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """All (wanted) pieces of k bytes as numbers, in words with their spaces, and the word of each."""
        n = np.maximum(0, self.ends - self.starts + 3 - k)
        values, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        cuts = np.append(np.flatnonzero(np.diff(np.cumsum(n) // most, prepend=-1)), len(n))
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            at, run = _runs(self.starts[first:last] - 1, n[first:last])
            value = np.full(len(at), k, np.uint64)
            for j in range(k):
                value = value << np.uint64(8) | self.buffer[at + j]
            if wanted is not None:
                on = np.isin(value, wanted)
                value, run = value[on], run[on]
            values.append(value)
            words.append(run + first)
        return np.concatenate(values), np.concatenate(words)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... of each run, and the run's number."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[run], run


def _spread(texts: list[bytes]) -> Spread:
    """Words, paired with the texts that bring each in a context (the word before) not seen in an earlier text.

    So copies of a text, and a text that repeats itself, count once. The texts
    of a word are returned, as pieces of words are to be counted by text too.
    Arrays of numbers keep this small: about 60 bytes for each word of the texts.
    """
    hashes, starts, lengths, n_words, base = [], [], [], [], 1
    for first, last in blocks(texts):
        h, s, e, n = word_spans(texts[first:last], LETTERS)
        hashes.append(h)
        starts.append(s + base)
        lengths.append((e - s).astype(np.int32))
        n_words.append(n)
        base += sum(len(t) + 1 for t in texts[first:last])
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    own, n_words = join(hashes, np.uint64), join(n_words, np.int64)
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    firsts = np.cumsum(n_words) - n_words
    before[firsts[n_words > 0]] = 0
    before *= np.uint64(BASE)
    before += own
    new = np.unique(mix(before), return_index=True)[1]
    del before
    _, one, which, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    text = np.searchsorted(np.cumsum(n_words), new, side="right")
    pairs = np.unique(which[new] * max(1, len(texts)) + text)
    buffer = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(LETTERS), np.uint8)
    start = join(starts, np.int64)[one]
    words, text = np.divmod(pairs, max(1, len(texts)))
    return Spread(buffer, start, start + join(lengths, np.int32)[one], counts, words, text, len(texts))


def _by_piece(spread: Spread, wanted: np.ndarray | None = None, least: int = 1, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each piece is, for pieces in at least so many (and wanted); about ``most`` pairs at once are held."""
    own = np.bincount(spread.words, minlength=len(spread.starts))
    until = np.cumsum(own)
    kept, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in (5, 6, 7):
        piece, word = spread.pieces(k, wanted)
        # No piece is in more texts than its words have together.
        names, which = np.unique(piece, return_inverse=True)
        on = (np.bincount(which, own[word], len(names)) >= least)[which]
        which, word = which[on], word[on]
        order = np.argsort(which, kind="stable")
        which, word = which[order], word[order]
        number = np.zeros(len(names), np.int64)
        part = np.cumsum(own[word]) // most
        cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        # A part begins where a piece begins.
        cuts = np.unique(np.append(np.searchsorted(which, which[cuts]), len(which))) if len(part) else [0]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            at, run = _runs((until - own)[word[first:last]], own[word[first:last]])
            met = np.unique(which[first:last][run] * max(1, spread.n_texts) + spread.texts[at]) // max(1, spread.n_texts)
            number += np.bincount(met, minlength=len(names))
        kept.append(names[number >= least])
        numbers.append(number[number >= least])
    return np.concatenate(kept), np.concatenate(numbers)


def _told_apart(word: bytes, told: set[bytes]) -> list[bytes]:
    """The stretches of a word that the pieces cover."""
    framed = b" " + word + b" "
    on = bytearray(len(framed))
    for k in (5, 6, 7):
        for i in range(len(framed) - k + 1):
            if framed[i : i + k] in told:
                on[i : i + k] = b"\x01" * k
    out, i = [], 0
    while (i := on.find(1, i)) >= 0:
        end = on.find(0, i)
        end = len(on) if end < 0 else end
        out.append(framed[i:end])
        i = end
    return out


def fit(toxic: list[bytes], ordinary: list[bytes], *, least: int = 4, ratio: float = 10.0, words: int = 8000, size: int = 32768) -> tuple[bytes, bytes]:
    """Content of the two dictionaries, the most useful last, from lower-cased texts.

    Most of a toxic document is ordinary text, so its dictionary gets only what
    sets toxic documents apart: stretches of 5 bytes or more that ``least``
    texts bring in contexts of their own, ``ratio`` times the share of ordinary
    texts that do. The ordinary dictionary gets the most frequent ordinary words.
    """
    bad, good = _spread(toxic), _spread(ordinary)
    often, n = _by_piece(bad, least=least)
    named, number = _by_piece(good, often)
    beside = np.zeros(len(often))
    beside[np.searchsorted(often, named)] = number
    told = often[n / max(1, len(toxic)) >= ratio * (beside + 0.5) / max(1, len(ordinary))]
    holders = np.unique(np.concatenate([bad.pieces(k, told)[1] for k in (5, 6, 7)]))
    told = {int(p).to_bytes(8, "big").lstrip(b"\0")[1:] for p in told}
    own = np.bincount(bad.words, minlength=len(bad.starts))
    stretches: Counter = Counter()
    for i in holders.tolist():
        for stretch in _told_apart(bad.buffer[bad.starts[i] : bad.ends[i]].tobytes(), told):
            stretches[stretch] += int(own[i])
    order = lambda c: [x for x, _ in sorted(c.items(), key=lambda y: (y[1], y[0]))]
    # All words as frequent as the last one that counts; of equal ones those that sort first stay.
    level = np.partition(good.counts, -words)[-words] if len(good.counts) > words else 0
    common = {good.buffer[good.starts[i] : good.ends[i]].tobytes(): int(good.counts[i]) for i in np.flatnonzero(good.counts >= level).tolist()}
    kept = dict(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:words])
    return b"".join(order(stretches))[-size:], (b" " + b" ".join(order(kept)) + b" ")[-4 * size :]


class Distance:
    """By how many bytes a word's window is shorter with the toxic dictionary; words met before are looked up."""

    MOST = 1_000_000

    def __init__(self, toxic: bytes, ordinary: bytes):
        make = lambda d: zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(d) >= 8 else None,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        self.toxic, self.ordinary = make(toxic).compress, make(ordinary).compress
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int16)

    def of_word(self, word: bytes) -> int:
        window = (b" " + word) * REPEATS + b" "
        return len(self.ordinary(window)) - len(self.toxic(window))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each lower-cased text the differences of its words."""
        hashes, starts, ends, n_words = word_spans(texts, LETTERS)
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.MOST:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            joined = b" ".join(texts)
            own = [self.of_word(joined[s:e]) for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)]
            self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], own)
            at = np.searchsorted(self.keys, keys)
        return np.split(self.values[at][which], np.cumsum(n_words)[:-1])


@lru_cache(maxsize=2)
def distance(toxic: bytes, ordinary: bytes) -> Distance:
    return Distance(toxic, ordinary)


def measured(texts: list[bytes | None], toxic: bytes, ordinary: bytes) -> list[int]:
    """The largest difference of any window of each text, from 0 to 9."""
    out, measure = [], distance(toxic, ordinary)
    for first, last in blocks(texts):
        for values in measure([lowered(t) for t in texts[first:last]]):
            out.append(min(9, max(0, int(values.max()))) if len(values) else 0)
    return out


def calibrated(levels: list[int], toxic: list[int]) -> list[float]:
    """Chance of a toxic document by level, never falling (pooled where it would)."""
    pools = [[0.1, 0.2 + 0.8 * (k == 0), 1] for k in range(10)]
    for level, label in zip(levels, toxic, strict=True):
        pools[level][0] += label
        pools[level][1] += 1
    done: list[list[float]] = []
    for p in pools:
        done.append(list(p))
        while len(done) > 1 and done[-2][0] / done[-2][1] >= done[-1][0] / done[-1][1]:
            a = done.pop()
            done[-1] = [x + y for x, y in zip(done[-1], a, strict=True)]
    return [t / n for t, n, k in done for _ in range(int(k))]


def _scored(toxic: bytes, ordinary: bytes, chances: list[float]):
    def run(batches):
        for batch in batches:
            scores = [chances[k] for k in measured(batch.column("text").to_pylist(), toxic, ordinary)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 1500, ordinary_rows: int = 3000, sample_bytes: int = 64 << 20) -> tuple[bytes, bytes, list[float]]:
    """Both dictionaries and the chance for each difference, learnt from a bounded sample of labelled rows.

    Only rows whose crc32(doc_id) mod 5 is not 0 are used: 2, 3 and 4 for the
    dictionaries, 1 for the chances. The sample has at most ``toxic_rows`` and
    ``ordinary_rows`` rows, those of the ids with the least hash and of one id that
    with the least hash of text, and of each kind no row after the one that makes
    ``sample_bytes`` of text full.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 0)
    told = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    samples = []
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        # At most so many ids, and one row of each, so what reaches the driver is bounded whatever the ids' numbers of rows.
        chosen = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        own = told.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
        own = own.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", fold.alias("fold"), "text")
        rows, size = [], 0
        for r in own.orderBy("doc_id").toLocalIterator():
            rows.append((r["fold"], lowered(None if r["text"] is None else bytes(r["text"]))))
            size += len(rows[-1][1])
            if size >= sample_bytes:
                break
        samples.append(rows)
    toxic, ordinary = samples
    content = fit([t for k, t in toxic if k != 1], [t for k, t in ordinary if k != 1])
    held = [(t, 1) for k, t in toxic if k == 1] + [(t, 0) for k, t in ordinary if k == 1]
    return *content, calibrated(measured([t for t, _ in held], *content), [y for _, y in held])


def score_toxicity(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """Chance that a document is toxic: doc_id, held_out, score, predicted.

    ``docs`` has doc_id and text, ``labels`` has doc_id and toxic; other columns
    are ignored. A window is one word. A document's level is the largest number
    of bytes by which the toxic dictionary makes one of its windows shorter than
    the ordinary dictionary does; calibration on labelled documents that the
    dictionaries have not seen turns the level into a chance. Whole texts are
    scored in one pass without a shuffle.

    Null and empty texts have level 0. A label counts once for each doc_id (the
    larger of several). Without toxic labels nothing is toxic. ``held_out`` is
    false for a null doc_id. Repeated rows each give a row.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, **sample)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = source.mapInArrow(_scored(*model), "doc_id bigint, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """Rows of ``docs``, all columns, whose own text ``score_toxicity`` does not call toxic."""
    small_batches(docs.sparkSession)
    toxic, ordinary, chances = train(docs, labels, **sample)

    def run(batches):
        for batch in batches:
            levels = measured(batch.column("text").cast(pa.binary()).to_pylist(), toxic, ordinary)
            yield batch.filter(pa.array([chances[k] < 0.5 for k in levels], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
