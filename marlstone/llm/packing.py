"""Token pieces and best-two-fit packing.

Packing looks at lengths only. The counts of pieces by length (at most as many
numbers as a sequence has tokens) are all that reaches the driver, however many
pieces there are; there a plan of bin patterns with multiplicities is made.
Then each piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import blocks, checkpointed, small_batches, word_spans

#: Distinct space-separated strings, and parts of them, that a worker keeps the ids of.
CACHE, PARTS = 1_000_000, 150_000
#: Only space and line feed separate: no tokenizer here joins what they part.
SPACES = bytes(32 if b == 10 else b for b in range(256))


#: Strings that the shortcut takes: printable characters of Latin-1, which normalisation leaves alone.
SIMPLE = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters as the letters that stand for their UTF-8 bytes in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class TokenIds:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins what a space or a line feed
    separates, so a text's ids are those of its space-separated strings, one
    after another. Those recur, so their ids are kept, under 64-bit hashes in
    sorted arrays that are searched for a whole batch at once. A string not seen
    before is cut by the tokenizer's own pattern if it is plain Latin-1, and the
    model gives each part's ids; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, list[int]] = {}
        self._forget()
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told["added_tokens"]]
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = [t for t in (told["pre_tokenizer"] or {}).get("pretokenizers", []) if t["type"] == "Split"]
        # The shortcut holds for this kind of tokenizer only.
        self.pattern = None
        if kinds == ["NFC", "Replace", "Lowercase"] and len(cuts) == 1 and cuts[0]["invert"]:
            self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.pool, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _part(self, part: str) -> list[int]:
        ids = [t.id for t in self.model.tokenize(part.translate(self.letters))]
        if len(self.parts) > PARTS:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def _ids(self, strings: list[str]) -> list[list[int]]:
        out: list = [None] * len(strings)
        others, parts, special = [], self.parts, self.special
        for i, w in enumerate(strings):
            if not self.pattern or not SIMPLE.fullmatch(w) or ("<" in w and any(x in w for x in special)):
                others.append(i)
            elif w.isalpha():
                x = w.lower()
                out[i] = parts[x] if x in parts else self._part(x)
            else:
                out[i] = own = []
                for x in self.pattern.findall(w.lower()):
                    own += parts[x] if x in parts else self._part(x)
        for first in range(0, len(others), 4096):
            some = others[first : first + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([strings[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        ids = self._ids(strings)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        n = len(self.first) - 1
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(sizes)]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, at, keys), np.insert(self.at, at, n + np.arange(len(keys)))

    def _of_block(self, texts: list[bytes | None]) -> list[bytes]:
        hashes, starts, ends, per_text = word_spans(texts, SPACES)
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            joined = b" ".join([t or b"" for t in texts])
            self._learn(keys[new], [joined[s:e].decode("utf-8", "replace") for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        entry = self.at[at][which]
        first, size = self.first[entry], self.first[entry + 1] - self.first[entry]
        until = np.r_[0, np.cumsum(size)]
        flat = self.pool[np.repeat(first - until[:-1], size) + np.arange(until[-1])]
        data, edges = flat.astype("<u4").tobytes(), until[np.r_[0, np.cumsum(per_text)]] * 4
        return [data[s:e] for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        return [x for first, last in blocks(texts) for x in self._of_block(texts[first:last])]


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def _pieces(path: str, size: int, end_id: int, keep: bool):
    def run(batches):
        encode, end = token_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for doc, data in zip(ids, encode(texts), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    own = data[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own if keep else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return run


def token_pieces(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Cut each document's ids (its end id last) into pieces of at most ``size``; only longer documents are cut.

    A null text counts as empty: one piece that holds the end id alone.
    """
    small_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")]
    out = docs.select(*columns).mapInArrow(_pieces(path, size, end_id, keep_ids), PIECE)
    return out if keep_ids else out.drop("ids")


def best_two_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Bin patterns [(length, times), ...] and how many bins of each; ``counts[n]`` pieces have length n.

    A bin starts with the longest piece left and is filled greedily with the
    longest that fits. If room is left, its smallest piece gives way to two
    unpacked pieces that fill the room and its place more tightly. The pattern
    is used as often as the counts allow.
    """
    left = np.array(counts, np.int64)
    size = len(left) - 1
    index = np.arange(size + 1)
    plan = []
    top = size
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        free = left.copy()
        free[top] -= 1
        bin_, gap, at = {top: 1}, size - top, top
        while gap > 0:
            at = min(at, gap)
            while at and not free[at]:
                at -= 1
            if not at:
                break
            n = int(min(free[at], gap // at))
            bin_[at] = bin_.get(at, 0) + n
            free[at] -= n
            gap -= n * at
        small = min(bin_)
        if gap and len(bin_) + bin_[small] > 2:
            room = gap + small
            below = np.maximum.accumulate(np.where(free > 0, index, 0))
            first = np.flatnonzero(free[: room + 1] > 0)
            second = below[room - first]
            # A pair of equals needs two of them; else the next shorter one is the partner.
            same = (second == first) & (free[first] < 2)
            second = np.where(same, below[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and (best := int(np.argmax(total))) >= 0 and total[best] > small:
                bin_[small] -= 1
                for n in (int(first[best]), int(second[best])):
                    bin_[n] = bin_.get(n, 0) + 1
        pattern = [(n, k) for n, k in sorted(bin_.items(), reverse=True) if k]
        times = min(int(left[n]) // k for n, k in pattern)
        for n, k in pattern:
            left[n] -= times * k
        plan.append((pattern, times))


def _places(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: rank at which a pattern begins, its first sequence, pieces of the length in a bin, offset of the first."""
    begun: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n, k in pattern:
            rows.setdefault(n, []).append((begun.get(n, 0), sequence, k, offset))
            begun[n] = begun.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def _placed(places):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, first, per_bin, start = places[int(n)]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                own = rank[at] - ranks[k]
                sequence[at] = first[k] + own // per_bin[k]
                offset[at] = start[k] + own % per_bin[k] * n
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(sequence), pa.array(offset)], names=["own", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, *, size: int = 2048, planner=best_two_fit, rows_a_group: int = 50_000) -> DataFrame:
    """Give each piece a sequence and an offset in it.

    ``pieces`` has a length from 1 to ``size`` and whatever columns more; its own
    ``sequence_id`` and ``offset``, if any, are replaced. Every row gets a number,
    once, with the checkpoint; rows are ranked within their length, in groups of about
    ``rows_a_group`` by a hash of the number, whose counts are summed first, so
    neither a length nor any number of equal rows is gathered in one task. All
    pieces of full length, a length like any other, get a sequence each. An empty
    table stays empty.
    """
    own = F.struct(*[c for c in pieces.columns if c not in ("sequence_id", "offset")])
    numbered = checkpointed(pieces.select(own.alias("own"), F.col("length").alias("length"), F.monotonically_increasing_id().alias("row")))
    groups = max(1, -(-numbered.count() // rows_a_group))
    keyed = grouped(numbered, groups)
    counts = keyed.groupBy("length", "group").agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    every = np.zeros(size + 1, np.int64)
    for r in by_length:
        every[r["length"]] = r["n"]
    places = _places(planner(every))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "group", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "group").orderBy("row"))
    ranked = keyed.withColumn("rank", rank).join(offsets, ["length", "group"]).select("own", "length", (F.col("before") + F.col("rank") - 1).alias("rank"))
    kind = ranked.schema["own"].dataType.simpleString()
    return ranked.mapInArrow(_placed(places), f"own {kind}, sequence_id bigint, offset bigint").select("own.*", "sequence_id", "offset")


def grouped(numbered: DataFrame, groups: int) -> DataFrame:
    """Numbered rows with their group, by a hash of the number."""
    return numbered.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))


def packed_pieces(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place: best-two-fit over the whole table.

    Each document is tokenized once; the pieces (without ids) are checkpointed,
    as they are counted, ranked and placed. Repeated rows are packed each.
    """
    return pack(token_pieces(docs, path, size=size, end_id=end_id), size=size)
