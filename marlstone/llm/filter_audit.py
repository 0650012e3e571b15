"""Interaction of corpus filters over a packed bitmap index.

Rows are indexed in blocks. A block has one bitset for each filter (failing
rows), each label (rows that have it) and each part (its rows). For any set of
filters, rows of a part that none of them removes are counted by AND-NOT and
popcount; sums of these counts over all blocks answer every order of the
filters, so no order ever looks at a row.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import checkpoint_folder

LETTERS = "ABCDE"
INDEX = "n_rows bigint, filters array<binary>, labels array<binary>, parts array<struct<part:string,first:int,bits:binary>>"


def failures(text: Column) -> dict[str, Column]:
    """Conditions A to D of a text (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    # The words are made once for both conditions that need them.
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))[0]
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "counts": counts,
        "C": F.lit(100).cast("bigint") * capitals > F.lit(3).cast("bigint") * F.length(whole),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row's part, filters A to E and labels: part, A, B, C, D, E, good, toxic.

    One pass over the texts writes narrow rows to the shared folder. Copies meet
    as a 256-bit hash with its least doc_id, combined before the shuffle; only
    hashes that two rows share are looked up, as are labels, from tables that
    are written first, so that adaptive execution can split a hot key.
    """
    spark, folder = docs.sparkSession, checkpoint_folder(docs.sparkSession)
    rules = failures(F.col("text"))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("lang", F.lit("")).cast("string").alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"),
        rules["counts"].alias("counts"), rules["C"].alias("C"), rules["D"].alias("D"),
    )
    n, different = F.col("counts.n").cast("bigint"), F.col("counts.different").cast("bigint")
    narrow = narrow.select("doc_id", "part", "hash", (n < 200).alias("A"), (100 * different < 50 * n).alias("B"), "C", "D")
    narrow.write.parquet(f"{folder}/flags")
    rows = spark.read.schema(narrow.schema).parquet(f"{folder}/flags")
    copies = rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("hash", "first_id")
    # Few files, about one for a million rows.
    files = max(8, rows.count() >> 20)
    copies.coalesce(files).write.parquet(f"{folder}/copies")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    known.coalesce(files).write.parquet(f"{folder}/labels")
    copies = spark.read.schema("hash binary, first_id bigint").parquet(f"{folder}/copies")
    known = spark.read.schema("doc_id bigint, good boolean, toxic boolean").parquet(f"{folder}/labels")
    told = rows.join(copies, "hash", "left").join(known, "doc_id", "left")
    return told.select(
        "part", "A", "B", "C", "D",
        F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def _pack(column: np.ndarray) -> bytes:
    return np.packbits(column, bitorder="little").tobytes()


def _indexed(n_filters: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(object)
            different, part = np.unique(names.astype(str), return_inverse=True)
            # By part, so that a part's bitset only spans its own bytes.
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(len(different) + 1)).tolist()
            sets = [_pack(batch.column(i).to_numpy(zero_copy_only=False).astype(bool)[order]) for i in range(1, batch.num_columns)]
            parts = []
            for name, lo, hi in zip(different.tolist(), cuts[:-1], cuts[1:], strict=True):
                own = np.zeros((hi + 7) // 8 * 8 - lo // 8 * 8, bool)
                own[lo % 8 : lo % 8 + hi - lo] = True
                parts.append({"part": name, "first": lo // 8, "bits": _pack(own)})
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.struct([("part", pa.string()), ("first", pa.int32()), ("bits", pa.binary())])))
            values = ([n], [sets[:n_filters]], [sets[n_filters:]], [parts])
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["n_rows", "filters", "labels", "parts"])

    return run


def bitmap_index(rows: DataFrame, *, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """The index of boolean columns: one row a block (an Arrow batch of a partition) with its packed bitsets. Null is false; a null part is the empty string."""
    columns = [F.coalesce(F.col(part), F.lit("")).alias("part")] + [F.coalesce(c, F.lit(False)).alias(f"b{i}") for i, c in enumerate([*filters, *labels])]
    return rows.select(*columns).mapInArrow(_indexed(len(filters)), INDEX)


def _counted(n_filters: int):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sets = [np.frombuffer(b, np.uint8) for b in row["filters"]]
                masks = [np.frombuffer(b, np.uint8) for b in row["labels"]]
                union = [np.zeros_like(sets[0])]
                for subset in range(1, 1 << n_filters):
                    low = (subset & -subset).bit_length() - 1
                    union.append(union[subset & (subset - 1)] | sets[low])
                for own in row["parts"]:
                    bits, at = np.frombuffer(own["bits"], np.uint8), slice(own["first"], own["first"] + len(own["bits"]))
                    counts = total.setdefault(own["part"], np.zeros((1 << n_filters, 1 + len(masks)), np.int64))
                    for subset, gone in enumerate(union):
                        left = bits & ~gone[at]
                        counts[subset, 0] += np.bitwise_count(left).sum(dtype=np.int64)
                        for j, m in enumerate(masks):
                            counts[subset, j + 1] += np.bitwise_count(left & m[at]).sum(dtype=np.int64)
                # What many parts gather leaves in pieces, so that a task never holds them all.
                if len(total) > 10_000:
                    yield _rows(total)
                    total = {}
        yield _rows(total)

    return run


def _rows(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    parts = list(total)
    alive = [total[p].tolist() for p in parts]
    kind = pa.list_(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(alive, kind)], names=["part", "alive"])


def survivors(index: DataFrame, *, n_filters: int) -> DataFrame:
    """Rows that no filter of a set removes: part, subset (bit i: filter i), alive array (all rows, then those with each label), summed over the blocks."""
    counted = index.mapInArrow(_counted(n_filters), "part string, alive array<array<bigint>>")
    single = counted.select("part", F.posexplode("alive").alias("subset", "alive")).select("part", "subset", F.posexplode("alive").alias("label", "n"))
    summed = single.groupBy("part", "subset", "label").agg(F.sum("n").alias("n"))
    return summed.groupBy("part", "subset").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("own")).select("part", "subset", F.col("own.n").alias("alive"))


def audit(index: DataFrame, *, filters: list[str], labels: list[str]) -> DataFrame:
    """Every order of the filters, step by step, for each part.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, one
    ``<label>_lost`` for each label, and shapley (the filter's removals summed over
    all orders). Zero rows stay; a table without rows has no parts. All orders are
    told, so the filters are few (``2^n`` sets and ``n!`` orders).
    """
    n = len(filters)
    if not 0 < n <= 8:
        raise ValueError("an audit takes one to eight filters")
    spark, full = index.sparkSession, (1 << n) - 1
    alive = survivors(index, n_filters=n).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", "alive"))).alias("alive"))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, f, before))
            before |= 1 << f
    steps = spark.createDataFrame(steps, "filter_order string, step int, f int, before int")
    # A set S of filters stands before a given one in |S|! (n - 1 - |S|)! orders.
    weights = [[(s, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) if not s >> f & 1] for f in range(n)]
    sets = F.array(*[F.struct(F.lit(f).alias("f"), F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(w).cast("bigint").alias("weight")) for s, w in own]).alias("sets")) for f, own in enumerate(weights)])
    at = lambda subset, label=0: F.get(F.element_at("alive", subset), F.lit(label))
    bit = F.pow(F.lit(2), F.col("f")).cast("int")
    shapley = F.aggregate("sets", F.lit(0).cast("bigint"), lambda total, x: total + x["weight"] * (at(x["subset"]) - at(x["subset"].bitwiseOR(bit))))
    per_filter = alive.select("part", "alive", F.inline(sets)).select("part", "alive", "f", shapley.alias("shapley"))
    every = per_filter.join(F.broadcast(steps), "f").withColumn("after", F.col("before").bitwiseOR(bit))
    removed = at(F.col("before")) - at(F.col("after"))
    fails = at(F.lit(0)) - at(bit)
    lost = [(at(F.col("before"), i) - at(F.col("after"), i)).alias(f"{name}_lost") for i, name in enumerate(labels, 1)]
    return every.select(
        "part", "filter_order", "step",
        at(F.col("after")).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (at(F.lit(full) - bit) - at(F.lit(full))).alias("unique_fails"), *lost, "shapley",
    )


def audit_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of five filters over documents by ``lang`` (null: empty string).

    A: under 200 words. B: less than half of the words are different. C: more
    than 3 % capitals. D: any of ``#$%&*|``. E: the text stands under a smaller
    doc_id too, in the whole table. ``docs`` has doc_id, text and lang, ``labels``
    doc_id, quality and toxic; other columns are ignored. A null text is empty. A
    null doc_id is no smaller id than any and has no labels, so such a row never
    fails E. Rows of one doc_id are rows of their own; equal ids are not smaller.
    Several labels of one doc_id: one that is 1 is enough.
    """
    names = {"filters": list(LETTERS), "labels": ["good", "toxic"]}
    # The index is read once here, so it is not kept.
    return audit(bitmap_index(flagged(docs, labels), **names), **names)
