"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the bag of its runs of ``shingle`` words. For each distinct
shingle with multiplicity w the signature looks at a Poisson process over time
and weight, cut into dyadic layers of the integer weights: [0, 1), [1, 2),
[2, 4), [4, 8) and so on. A layer has points at a rate of its width for each
register; a point counts if its weight is below w. A register keeps its first
point, so two registers agree with the probability of the weighted Jaccard
similarity sum(min) / sum(max), at a cost in layers (log w), not copies (w).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import FOLD, blocks, checkpointed, grams, mix, small_batches, words_of

BANDS, ROWS = 21, 6


def bags(texts: list[bytes | None], shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles (hashed) and how often each occurs; fewer words than a shingle are one."""
    out = []
    for first, last in blocks(texts):
        words, n_words = words_of(texts[first:last], FOLD)
        every, at = grams(words, shingle), 0
        for n in n_words.tolist():
            own = every[at : at + n - shingle + 1] if n >= shingle else grams(words[at : at + n], n) if n else every[:0]
            out.append(np.unique(own, return_counts=True))
            at += n
    return out


def signatures(found: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: one row of ``registers`` point identities for each bag that is not empty (others: zeros)."""
    sizes = np.array([len(k) for k, _ in found])
    doc = np.repeat(np.arange(len(found)), sizes)
    keys = np.concatenate([k for k, _ in found]) if len(found) else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in found]) if len(found) else np.zeros(0, np.int64)
    total = np.bincount(doc, counts, len(found)) if len(doc) else np.zeros(len(found))
    layers, low, layer = [], 0, 0
    while len(counts) and (counts > low).any():
        at = np.flatnonzero(counts > low)
        width = max(1, low)
        seed = mix(keys[at] + np.uint64((0xA24BAED4963EE407 * (layer + 1)) % (1 << 64)))
        layers.append((doc[at], seed, counts[at], np.full(len(at), low), np.full(len(at), width)))
        low, layer = low + width, layer + 1
    best = np.full(len(found) * registers, np.inf)
    who = np.zeros(len(found) * registers, np.uint64)
    open_ = np.flatnonzero(total > 0)
    reach = (np.log(registers) + 6) / np.maximum(total, 1)
    while len(open_):
        again = np.zeros(len(found), bool)
        again[open_] = True
        for d, seed, count, lo, width in layers:
            on = again[d]
            d, seed, count, lo, width = d[on], seed[on], count[on], lo[on], width[on]
            time, i = np.zeros(len(d)), 0
            while len(d):
                u = mix(seed + np.uint64((0x9FB21C651E98DF25 * (i + 1)) % (1 << 64)))
                time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (registers * width)
                near = time <= reach[d]
                d, seed, count, lo, width, time, u = d[near], seed[near], count[near], lo[near], width[near], time[near], u[near]
                v = mix(u)
                weight = lo + ((v >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
                ok = weight < count
                slot = d[ok] * registers + (v[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
                t, point = time[ok], mix(v[ok])
                np.minimum.at(best, slot, t)
                first = best[slot] == t
                who[slot[first]] = point[first]
                i += 1
        unfilled = np.isinf(best.reshape(len(found), registers)).any(axis=1)
        open_ = open_[unfilled[open_]]
        reach[open_] *= 2
    return who.reshape(len(found), registers)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(1, int(a[1].sum()) + int(b[1].sum()) - common)


SIGNED = "doc_id bigint, hash bigint, bag binary, bands array<bigint>"


def bag_key(bag: tuple[np.ndarray, np.ndarray]) -> bytes | None:
    """128 bits that equal bags share; None for an empty bag."""
    if not len(bag[0]):
        return None
    own = mix(bag[0] ^ np.uint64(0x5851F42D4C957F2D)) + bag[1].astype(np.uint64)
    return np.array([mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)]).tobytes()


def _signed(shingle: int):
    def run(batches):
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), bags(batch.column(1).to_pylist(), shingle)
            banded = signatures(found).reshape(len(found), BANDS, ROWS)
            hashed = np.zeros((len(found), BANDS), np.uint64)
            for j in range(ROWS):
                hashed = mix(hashed * np.uint64(0xD1342543DE82EF95) + banded[:, :, j] + np.uint64(j + 1))
            keys = [bag_key(b) for b in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column(2), pa.array(keys, pa.binary()), pa.array(hashed.view(np.int64).tolist(), pa.list_(pa.int64()))],
                names=["doc_id", "hash", "bag", "bands"],
            )

    return run


def _content(shingle: int):
    def run(batches):
        for batch in batches:
            found = bags(batch.column(1).to_pylist(), shingle)
            # Rows of one doc_id whose other texts have an equal hash would be met here too; they have another bag.
            own = [(key, b) for key, b in zip(batch.column(0).to_pylist(), found, strict=True) if bag_key(b) == key]
            data = [k.tobytes() + c.astype("<u4").tobytes() for _, (k, c) in own]
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in own], pa.binary()), pa.array(data, pa.binary())], names=["bag", "content"])

    return run


def _measured(batches):
    def parse(data: bytes):
        n = len(data) // 12
        return np.frombuffer(data, np.uint64, n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)

    for batch in batches:
        s = [overlap(parse(a), parse(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "s"])


def _read(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and multiplicities of bags laid end to end, and each bag's number of shingles."""
    sizes = np.array([len(c) // 12 for c in contents], np.int64)
    keys = [np.frombuffer(c, np.uint64, len(c) // 12) for c in contents]
    counts = [np.frombuffer(c, "<u4", len(c) // 12, len(c) // 12 * 8).astype(np.int64) for c in contents]
    return np.concatenate(keys), np.concatenate(counts), sizes


def _blockwise(threshold: float):
    """Links between two blocks of one bucket: for each bag of the left one link into every class that it touches."""

    def run(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            keys, counts, sizes = _read(right.column("content").to_pylist())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            mass = np.bincount(owner, counts, len(sizes))
            order = np.argsort(keys, kind="stable")
            keys, counts, owner = keys[order], counts[order], owner[order]
            bags_, roots = right.column("bag").to_pylist(), right.column("root").to_pylist()
            for a, root, content in zip(*(left.column(c).to_pylist() for c in ("bag", "root", "content")), strict=True):
                own, n, _ = _read([content])
                first = np.searchsorted(keys, own)
                size = np.searchsorted(keys, own, "right") - first
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                common = np.bincount(owner[at], np.minimum(counts[at], np.repeat(n, size)), len(mass))
                seen = {root}
                for i in np.flatnonzero(common / np.maximum(1, n.sum() + mass - common) >= threshold):
                    if roots[i] not in seen:
                        seen.add(roots[i])
                        out.append((a, bags_[i]))
        return pa.table([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def similarities(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Exact similarity of pairs (a, b) of bags."""
    left = contents.select(F.col("bag").alias("a"), F.col("content").alias("content_a"))
    right = contents.select(F.col("bag").alias("b"), F.col("content").alias("content_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "content_a", "content_b")
    return both.mapInArrow(_measured, "a binary, b binary, s double")


def components(edges: DataFrame, *, rows_a_file: int = 50_000) -> DataFrame:
    """Connected components of edges (a, b): node and its component's least node.

    Alternating star contraction: in turn each node's larger, then smaller
    neighbours are tied to the least neighbour, until nothing changes. Minima
    are combined before a shuffle and joins on a node with very many edges are
    split by adaptive execution; each round is checkpointed, in about one file
    for ``rows_a_file`` edges.
    """

    def turn(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return small.where("a != b").distinct()

    def mark(pairs: DataFrame):
        return pairs.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        now = checkpointed(turn(now).coalesce(max(8, -(-seen[0] // rows_a_file))))
        if (told := mark(now)) == seen:
            break
        seen = told
    return now.select(F.col("a").alias("bag"), F.col("b").alias("root"))


def text_rows(source: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of chosen rows (bag, doc_id, hash): bag, text."""
    same = (source["hash"] == chosen["hash"]) & source["doc_id"].eqNullSafe(chosen["doc_id"])
    return source.join(chosen, same).select("bag", "text")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, few_rows: int = 8, block_rows: int = 512) -> DataFrame:
    """Class of near-duplicates of each document.

    ``docs`` has doc_id and text; other columns are ignored. Two documents are
    linked if the weighted Jaccard similarity of their bags of ``shingle``-word
    runs (letters A-Z lower-cased, punctuation dropped) is ``threshold`` or
    more; classes are the connected components. Documents with equal bags are
    one vertex, so copies never form pairs. Fewer words than a shingle make one
    shingle; a document without words (null, empty) is alone.

    Candidates share one of 21 bands of 6 registers (at 0.8 a pair is found with
    probability 0.998). In each bucket one member, chosen by a hash of the band,
    is compared with all others, so a bucket of n costs n - 1 comparisons. What
    that leaves unlinked (loose) is compared with the other members of its bucket: in
    buckets of at most ``few_rows`` as pairs, unless they are in one class already
    or the triangle inequality of the distance 1 - similarity shows that they
    cannot be linked; in larger ones block by block (``block_rows`` bags), where
    no pair leaves the task but one link of a bag into each other class. So every
    link between different bags of a bucket shows in the classes.

    Returns one row per input row: doc_id, class_id (least doc_id of its class)
    and class_size (rows in the class). A null doc_id never names a class unless
    the class has no other.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))
    signed = checkpointed(source.mapInArrow(_signed(shingle), SIGNED))
    vertices = signed.where("bag is not null").groupBy("bag").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("bands").alias("bands")
    )
    banded = vertices.select("bag", F.posexplode("bands").alias("band", "hash"))
    lead = F.min(F.struct(F.xxhash64("bag", "band").alias("h"), F.col("bag").alias("hub")))
    hubs = banded.groupBy("band", "hash").agg(lead.alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = checkpointed(
        banded.join(hubs, ["band", "hash"]).select("band", "hash", "bag", F.col("lead.hub").alias("hub")).where("bag != hub")
    )
    pairs = members.select(F.col("hub").alias("a"), F.col("bag").alias("b")).distinct()
    wanted = pairs.select(F.col("a").alias("bag")).unionByName(pairs.select(F.col("b").alias("bag"))).distinct()
    # A row is told by its doc_id and its text's hash, so that each wanted bag meets one text (or its equal rows), whatever the ids are.
    chosen = signed.join(wanted, "bag", "left_semi").groupBy("bag").agg(F.min(F.struct("doc_id", "hash")).alias("own")).select("bag", "own.doc_id", "own.hash")
    texts = text_rows(source, chosen)
    contents = checkpointed(
        texts.mapInArrow(_content(shingle), "bag binary, content binary").groupBy("bag").agg(F.any_value("content").alias("content"))
    )
    first = checkpointed(similarities(pairs, contents))
    linked = first.where(F.col("s") >= threshold).select("a", "b")
    roots = checkpointed(components(linked))

    reach = 1 - threshold
    told = checkpointed(
        members.join(first.select(F.col("a").alias("hub"), F.col("b").alias("bag"), "s"), ["hub", "bag"])
        .join(roots, "bag", "left")
        .select("band", "hash", "bag", (1 - F.col("s")).alias("d"), F.coalesce("root", "bag").alias("root"))
    )
    loose = F.col("d") > reach
    open_ = told.groupBy("band", "hash").agg(F.count("*").alias("n"), F.count_if(loose).alias("n_loose")).where("n_loose > 0 AND n > 1")
    buckets = told.join(open_.select("band", "hash", "n", "n_loose"), ["band", "hash"])
    few = buckets.where(F.col("n") <= few_rows)
    left = few.where(loose).select("band", "hash", F.col("bag").alias("a"), F.col("d").alias("d_a"), F.col("root").alias("root_a"))
    near = F.abs(F.col("d_a") - F.col("d")) <= reach + 1e-12
    apart = (F.col("root_a") != F.col("root")) & (~loose | (F.col("a") < F.col("bag")))
    same = (left["band"] == few["band"]) & (left["hash"] == few["hash"])
    more = left.join(few, same & near & apart).select("a", F.col("bag").alias("b")).distinct()
    second = similarities(more, contents).where(F.col("s") >= threshold).select("a", "b")

    # Loose bags go to all blocks of the bucket, all bags to the blocks of loose ones: with few loose bags the contents grow with n.
    count = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    place = lambda c, salt: F.pmod(F.xxhash64("bag", F.lit(salt)), count(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    many = buckets.where(F.col("n") > few_rows)
    # Aliases, as both sides come from one table.
    inner = [F.col(c).alias(c) for c in ("band", "hash", "bag", "root", "content")]
    one = many.where(loose).join(contents, "bag").select(*inner, place("n_loose", 1).alias("i"), each("n").alias("j"))
    two = many.join(contents, "bag").select(*inner, place("n", 2).alias("j"), each("n_loose").alias("i"))
    block = ["band", "hash", "i", "j"]
    third = one.groupBy(*block).cogroup(two.groupBy(*block)).applyInArrow(_blockwise(threshold), "a binary, b binary")
    roots = components(linked.unionByName(second).unionByName(third))

    tied = vertices.select("bag", "least", "n").join(roots, "bag", "left").withColumn("root", F.coalesce("root", "bag"))
    named = tied.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    classes = tied.select("bag", "root").join(named, "root").select("bag", "class_id", "class_size")
    return signed.select("doc_id", "bag").join(classes, "bag", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size")
    )
