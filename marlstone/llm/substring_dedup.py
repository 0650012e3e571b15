"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the whole corpus, cut into blocks by content. A window is
``window`` consecutive words; its anchor is the smallest hash of the
``anchor``-word runs in it. A run of windows with one anchor is a segment, and
a block holds the segments whose anchors hash to it. Equal windows have equal
anchors, so whatever a document can copy from stands in the one block that its
own segment goes to: each stretch is factored against the block that can match
it, and the shuffle grows with the text, not with documents times blocks.

In a block every word of a segment gets the longest match with a segment of an
earlier document (source document and word), by doubling up from window length
to the longest that still occurs. The greedy parse takes the longest factor at
the first word that has one, then looks at the windows that straddle its end;
one that reaches further is the next factor. Factors of neighbouring segments
that go on in the same source are joined to one. Factors have ``window`` words
at least, and what they cover is duplicate.

Before that a first pass exchanges only anchors. Segments whose anchor stands in
one document alone are literals and never travel. Windows of anchors that stand
in very many segments are segments by themselves and go to a block by their own
hash, so that no block has to hold all contexts of a frequent phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import BASE, PLAIN, blocks, fitting, grams, mix, parts_for, small_batches, split_by, text_bytes, trim, words_of

SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("word", pa.int32())])
RESULT = (
    "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, "
    "factors array<struct<start:int,length:int,source:bigint,word:int>>, text string"
)
#: Stands for a null doc_id, which is later than every other.
LATEST = np.iinfo(np.int64).max
#: Bits of an anchor that carry its hash, the bit for "two documents of the part have it"; the rest is the logarithm of its segments.
HASH, SEVERAL, LOG = np.uint64(~31 % (1 << 64)), np.uint64(16), np.uint64(15)


def _load(table: pa.Table) -> tuple[np.ndarray, list[bytes | None]]:
    ids = table.column("doc_id").combine_chunks().fill_null(LATEST).to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), table.column("text").to_pylist()


def _join(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _heads(*ordered: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in ordered columns."""
    n = len(ordered[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    return new


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run laid end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _windows(texts: list[bytes | None], window: int, anchor: int):
    """By blocks of documents: first document, words of each, and of every window whether it stays in a document, its anchor, the words and its document."""
    for first, last in blocks(texts):
        words, n_words = words_of(texts[first:last], PLAIN)
        if len(words) < window:
            yield first, n_words, None
            continue
        small = grams(words, anchor) & HASH
        n = len(words) - window + 1
        least = small[:n].copy()
        for j in range(1, window - anchor + 1):
            np.minimum(least, small[j : n + j], out=least)
        doc = np.repeat(np.arange(first, last), n_words)[:n]
        yield first, n_words, (fitting(n_words, window), least, words, doc)


def _anchors(window: int, anchor: int, n_buckets: int):
    def run(key, table):
        ids, texts = _load(table)
        keys, docs = [], []
        for _, _, found in _windows(texts, window, anchor):
            if found:
                ok, least, _, doc = found
                least, doc = least[ok], doc[ok]
                new = _heads(least, doc)
                keys.append(least[new])
                docs.append(ids[doc[new]])
        k, d = _join(keys, np.uint64), _join(docs, np.int64)
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        head = np.flatnonzero(_heads(k))
        if len(head):
            several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
            log = np.minimum(15, np.log2(np.diff(np.r_[head, len(k)]))).astype(np.uint64)
            packed = k[head] | several.astype(np.uint64) * SEVERAL | log
        else:
            packed = k
        rows = [(b, packed[at].tobytes()) for b, at in split_by(_bucket(packed, n_buckets), n_buckets)]
        trim()
        part = key[0].as_py()
        return pa.table(
            [pa.array([b for b, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())],
            names=["bucket", "part", "keys"],
        )

    return run


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _shared_anchors(hot: int):
    def run(key, table):
        """For each part, which of its anchors another document has; the lowest bit says that it has more than ``hot`` segments in all."""
        parts, blobs = table.column("part").to_pylist(), table.column("keys").to_pylist()
        arrays = [np.frombuffer(b, np.uint64) for b in blobs]
        every = np.sort(np.concatenate(arrays))
        clean = every & HASH
        head = np.flatnonzero(_heads(clean))
        size = np.diff(np.r_[head, len(clean)])
        shared = (size > 1) | (np.bitwise_or.reduceat(every, head) & SEVERAL > 0)
        many = np.add.reduceat(np.int64(1) << (every & LOG).astype(np.int64), head) > hot
        both, many = clean[head][shared], many[shared]
        rows = []
        for part, a in zip(parts, arrays, strict=True):
            k = a & HASH
            at = np.minimum(np.searchsorted(both, k), max(0, len(both) - 1))
            hit = both[at] == k if len(both) else np.zeros(len(k), bool)
            if hit.any():
                rows.append((part, (k[hit] | many[at[hit]].astype(np.uint64)).tobytes()))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "keys"])

    return run


def _keys_of(table: pa.Table) -> np.ndarray:
    return np.sort(_join([np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()], np.uint64))


class Segments:
    """The segments of one part whose anchors are shared, in an order that their contents alone fix; ``least`` of them are different."""

    def __init__(self, ids: np.ndarray, texts: list[bytes | None], shared: np.ndarray, window: int, anchor: int, words: bool):
        self.n_words = np.zeros(len(texts), np.int64)
        rows: list[tuple] = []
        hashes, hot = shared & HASH, (shared & np.uint64(1)).astype(bool)
        for first, n_words, found in _windows(texts, window, anchor):
            self.n_words[first : first + len(n_words)] = n_words
            if not found or not len(shared):
                continue
            ok, least, word, doc = found
            spot = np.minimum(np.searchsorted(hashes, least), len(hashes) - 1)
            at = np.flatnonzero(ok & (hashes[spot] == least))
            if not len(at):
                continue
            alone, own = hot[spot[at]], least[at]
            joined = np.zeros(len(at), bool)
            joined[1:] = (at[1:] == at[:-1] + 1) & (own[1:] == own[:-1]) & ~alone[1:]
            lead = np.flatnonzero(~joined)
            place = np.arange(len(at)) - np.repeat(lead, np.diff(np.r_[lead, len(at)]))
            # At most so many windows that the first and the last hold all words.
            lead = np.flatnonzero(place % window == 0)
            begin, n = at[lead], np.diff(np.r_[lead, len(at)])
            one = grams(word, window, 1)
            key = mix(one[begin] * np.uint64(BASE) + one[begin + n - 1] + n.astype(np.uint64))
            route = np.where(alone[lead], one[begin], own[lead])
            size = n + window - 1
            start = begin - np.r_[0, np.cumsum(n_words)][doc[begin] - first]
            row = (key, route, doc[begin], start.astype(np.int64), size.astype(np.uint8))
            if words:
                w = word[ragged(begin, size)]
                row += ((w >> np.uint64(32)).astype(np.uint32), (w >> np.uint64(16)).astype(np.uint16))
            rows.append(row)
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.uint8, np.uint32, np.uint16)[: 7 if words else 5]
        columns = [_join([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        rows.clear()
        key, route, doc, start, size = columns[:5]
        order = np.lexsort((start, ids[doc], key))
        self.key, self.route, self.doc, self.start, self.size = (x[order] for x in (key, route, doc, start, size))
        self.head = np.flatnonzero(_heads(self.key))
        if words:
            own = size.astype(np.int64)
            self.offset = (np.cumsum(own) - own)[order]
            self.planes = columns[5:]


def _marked(window: int, anchor: int, n_buckets: int):
    def run(key, table, answers):
        ids, texts = _load(table)
        found = Segments(ids, texts, _keys_of(answers), window, anchor, words=True)
        rows: list[tuple] = []
        for b, at in split_by(_bucket(found.route[found.head], n_buckets), n_buckets):
            own = found.head[at]
            where = ragged(found.offset[own], found.size[own].astype(np.int64))
            rows.append(
                (b, at.astype(np.uint32).tobytes(), found.size[own].tobytes(), _narrow(ids[found.doc[own]]), found.start[own].astype(np.uint32).tobytes())
                + tuple(p[where].tobytes() for p in found.planes)
            )
        part = key[0].as_py()
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        arrays = [pa.array(columns[0], pa.int32()), pa.array([part] * len(rows), pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]]
        del found, rows, columns, texts
        trim()
        return pa.table(arrays, names=["bucket", "part", "own", "size", "docs", "start", "high", "low"])

    return run


SEGMENTS = "bucket int, part int, own binary, size binary, docs binary, start binary, high binary, low binary"
FACTORS = "part int, own binary, at binary, length binary, source binary, word binary"


def _narrow(ids: np.ndarray) -> bytes:
    """Integers as an offset, a width and the differences in that width."""
    low = int(ids.min())
    spread = ids.astype(np.uint64) - np.uint64(low % (1 << 64))
    width = next(w for w in (1, 2, 4, 8) if int(spread.max()) < 1 << (8 * w))
    return np.array([low, width], np.int64).tobytes() + spread.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    low, width = np.frombuffer(data[:16], np.int64).tolist()
    return (np.frombuffer(data[16:], f"<u{width}").astype(np.uint64) + np.uint64(low % (1 << 64))).astype(np.int64)


def longest_matches(words: np.ndarray, sizes: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of segments laid end to end, ordered by document: the length of the longest stretch from it, within its segment,
    that a segment of an earlier document has too (0: shorter than ``window``), and that stretch's first word in the earliest such document.
    """
    total = int(sizes.sum())
    until = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)
    doc = np.repeat(docs, sizes)
    length, source = np.zeros(total, np.uint8), np.zeros(total, np.int32)
    at = np.flatnonzero(until - np.arange(total, dtype=np.int32) >= window).astype(np.int32)
    gram = np.zeros(len(at), np.uint64)
    for j in range(window):
        gram = gram * np.uint64(BASE) + words[at + j]
    size = window
    while len(at):
        hashed = mix(gram)
        order = np.argsort(hashed, kind="stable")
        head = _heads(hashed[order])
        group = np.empty(len(at), np.int32)
        group[order] = np.cumsum(head) - 1
        # Words are ordered by document and the sort is stable, so a group's first is its earliest.
        first = at[order[head]][group]
        hit = doc[first] < doc[at]
        if not hit.any():
            break
        length[at[hit]], source[at[hit]] = size, first[hit]
        alive = np.zeros(int(group.max()) + 1, bool)
        alive[group[hit]] = True
        more = alive[group] & (until[at] - at > size)
        gram, at = gram[more] * np.uint64(BASE) + words[at[more] + size], at[more]
        size += 1
    return length, source


def parse(length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Greedy parse of each segment: the words at which its factors begin.

    The first word with a match begins a factor, the longest there is; of the
    words inside it and right behind it the next whose match reaches beyond its
    end begins the next one (a window that straddles the boundary), and so on.
    Ends never fall from one match to the next, so these are the matches that end
    later than the match before them.
    """
    at = np.flatnonzero(length)
    segment = np.repeat(np.arange(len(sizes)), sizes)[at]
    end = at + length[at]
    return at[_heads(segment, end)]


def _factored(window: int):
    def run(key, table):
        """The factors of one reference block's segments, by part."""
        column = lambda c: table.column(c).to_pylist()
        parts = column("part")
        whole = lambda c, kind: _join([np.frombuffer(b, kind) for b in column(c)], kind)
        own, size, start = whole("own", np.uint32), whole("size", np.uint8).astype(np.int64), whole("start", np.uint32)
        docs = np.concatenate([_wide(b) for b in column("docs")])
        part = np.repeat(np.arange(len(parts)), [len(b) // 4 for b in column("own")])
        order = np.lexsort((own, part, docs))
        where = ragged((np.cumsum(size) - size)[order], size[order])
        words = (whole("high", np.uint32)[where].astype(np.uint64) << np.uint64(16)) | whole("low", np.uint16)[where]
        del where, table
        own, size, start, docs, part = (x[order] for x in (own, size, start, docs, part))
        length, source = longest_matches(words, size, docs, window)
        del words
        at = parse(length, size)
        first = np.cumsum(size) - size
        mine = np.searchsorted(first, at, "right") - 1
        theirs = np.searchsorted(first, source[at], "right") - 1
        rows = []
        for p, i in split_by(part[mine], len(parts)):
            m, t = mine[i], theirs[i]
            rows.append(
                (parts[p], own[m].tobytes(), (at[i] - first[m]).astype(np.uint8).tobytes(), length[at[i]].tobytes(), docs[t].tobytes())
                + ((start[t] + (source[at[i]] - first[t])).astype(np.uint32).tobytes(),)
            )
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        trim()
        return pa.table(
            [pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=["part", "own", "at", "length", "source", "word"]
        )

    return run


def _chained(doc: np.ndarray, start: np.ndarray, length: np.ndarray, source: np.ndarray, word: np.ndarray):
    """Factors ordered by document and start; those that go on in the same source where they meet are one."""
    order = np.lexsort((start, word - start, source, doc))
    doc, start, length, source, word = (x[order] for x in (doc, start, length, source, word))
    stop = (doc << 32) + start + length
    new = _heads(doc, source, word - start)
    # Within a source and diagonal the factors come by start, so the farthest end so far is the last one's.
    new[1:] |= (doc[1:] << 32) + start[1:] > stop[:-1]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(start)] - 1 if len(head) else head
    doc, begin, source, word, length = doc[head], start[head], source[head], word[head], (start + length)[last] - start[head]
    order = np.lexsort((source, begin, doc))
    return tuple(x[order] for x in (doc, begin, length, source, word))


def _lists(kind: pa.DataType, rows: int, doc: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """A list column of structs from columns ordered by row."""
    offsets = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
    fields = [pa.array(c, f.type) for c, f in zip((c.astype(f.type.to_pandas_dtype()) for c, f in zip(columns, kind, strict=True)), kind, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def _parsed(window: int, anchor: int):
    def run(key, table, told):
        late = pc.is_valid(told.column("own"))
        shared, answers = _keys_of(told.filter(pc.invert(late))), told.filter(late)
        ids, texts = _load(table)
        found = Segments(ids, texts, shared, window, anchor, words=False)
        size = np.diff(np.r_[found.head, len(found.key)])
        least = np.repeat(found.head, size)
        later = np.flatnonzero(ids[found.doc] > ids[found.doc[least]])
        # A document of this part has the whole segment earlier.
        here = (found.doc[later], found.start[later], found.size[later].astype(np.int64), ids[found.doc[least[later]]], found.start[least[later]])
        # For the earliest of equal segments the block's factors count.
        whole = lambda c, kind: _join([np.frombuffer(b, kind) for b in answers.column(c).to_pylist()], kind).astype(np.int64)
        own, at, length, source, word = whole("own", np.uint32), whole("at", np.uint8), whole("length", np.uint8), whole("source", np.int64), whole("word", np.uint32)
        order = np.argsort(own, kind="stable")
        own, at, length, source, word = (x[order] for x in (own, at, length, source, word))
        early = np.flatnonzero(ids[found.doc] == ids[found.doc[least]])
        group = (np.repeat(np.arange(len(found.head)), size))[early]
        low = np.searchsorted(own, group)
        n = np.searchsorted(own, group, "right") - low
        pick, who = ragged(low, n), np.repeat(early, n)
        there = (found.doc[who], found.start[who] + at[pick], length[pick], source[pick], word[pick])
        doc, start, length, source, word = _chained(*(np.concatenate(x).astype(np.int64) for x in zip(here, there, strict=True)))
        n_words = found.n_words
        del found, answers, told
        begin, end = (doc << 32) + start, (doc << 32) + start + length
        reach = np.maximum.accumulate(end) if len(end) else end
        cut = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]]) if len(begin) else np.zeros(0, int)
        row, left, right = doc[cut], start[cut], reach[np.r_[cut[1:], len(reach)] - 1] - (doc[cut] << 32) if len(cut) else start[cut]
        removed = np.bincount(row, right - left, len(texts)).astype(np.int64)
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        for i in np.flatnonzero(removed):
            words = texts[i].translate(PLAIN).split()
            out, last = [], 0
            for s, e in zip(left[edges[i] : edges[i + 1]].tolist(), right[edges[i] : edges[i + 1]].tolist(), strict=True):
                out += words[last:s]
                last = e
            texts[i] = b" ".join(out + words[last:])
        columns = {
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(n_words),
            "n_removed": pa.array(removed),
            "spans": _lists(SPAN, len(texts), row, left, right),
            "factors": _lists(FACTOR, len(texts), doc, start, length, source, word),
            "text": pa.array(texts, pa.binary()).view(pa.string()),
        }
        if "row" in table.column_names:
            columns["row"] = table.column("row")
        del texts
        trim()
        return pa.table(columns)

    return run


def part_of(parts: int) -> Column:
    """Part of a row. Rows equal in doc_id and text are dealt too: those of one run of 256 rows of an input partition stay together."""
    return F.pmod(F.xxhash64("doc_id", "text", F.shiftright(F.monotonically_increasing_id(), 8)), F.lit(parts)).cast("int")


def substring_dedup(
    docs: DataFrame, *, window: int = 13, anchor: int = 5, part_bytes: int = 8 << 20, hot: int = 4096, rows: bool = False
) -> DataFrame:
    """Remove every word that a window starting in an earlier document covers.

    ``docs`` has doc_id and text; other columns are ignored. Words are the runs
    of anything but space and 0x09-0x0D, unchanged. A window is ``window``
    consecutive words; a word goes if a window that covers it also starts in a
    document with a smaller doc_id, judged on the input. Rows with the same
    doc_id are not earlier than each other and each gives a row; a null doc_id
    is later than all others. A null text has no words and stays null; a text
    of fewer words than the window loses nothing. Copies keep their first one.

    Texts are dealt once into parts of about ``part_bytes`` by doc_id, text and place in the input, and only
    anchors and segments travel between parts: equal ones once for each part, so
    a passage that a third of all rows share costs one entry a part. An anchor
    with more than ``hot`` segments has its windows dealt one by one. Words travel
    as 48 bits, so windows that differ in one word only are taken for equal with a
    chance of 2^-48; others practically never.

    Returns doc_id, n_words, n_removed, spans (half-open word ranges removed),
    factors (first word, length, source document and word in it, of the parse)
    and text (unchanged if nothing goes, else the kept words joined by one space);
    with ``rows`` also row, a struct of the input row's columns other than text.
    """
    if not 1 < anchor < window <= 128:
        raise ValueError("anchor must be between 2 and window - 1, window 128 at most")
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts_for(text_bytes(docs), part_bytes)
    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        part_of(parts).alias("part"),
        *[F.struct(*[c for c in docs.columns if c != "text"]).alias("row")] * rows,
    )
    result = StructType.fromDDL(RESULT)
    if rows:
        result.add(dealt.schema["row"])
    # The same columns each time, so that the texts are dealt once.
    by_part = lambda: dealt.groupBy("part")
    anchors = by_part().applyInArrow(_anchors(window, anchor, parts), "bucket int, part int, keys binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors(hot), "part int, keys binary")
    marked = by_part().cogroup(shared.groupBy("part")).applyInArrow(_marked(window, anchor, parts), SEGMENTS)
    factors = marked.groupBy("bucket").applyInArrow(_factored(window), FACTORS)
    told = shared.unionByName(factors, allowMissingColumns=True)
    return by_part().cogroup(told.groupBy("part")).applyInArrow(_parsed(window, anchor), result)
