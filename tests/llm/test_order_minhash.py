import hashlib
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import order_minhash
from marlstone.llm.order_minhash import fingerprint, fingerprint_edits, likeness, with_next


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x & (1 << 64) - 1))[0]


def xx(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def brute(text, k=2, least=2):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    mers = [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    seen, entries = {}, []
    for place, mer in enumerate(mers):
        key = xx(*mer) >> 30
        number = seen[key] = seen.get(key, -1) + 1
        entries.append(((xx(key, number) >> 30) if number else key, place))
    registers = {}
    for h, place in sorted(entries):
        registers.setdefault(h >> 28, []).append((place, h))
    out = {}
    for r, own in registers.items():
        ordered = [h & (1 << 34) - 1 for _, h in sorted(own[:least])]
        out[r % 64] = xx(*ordered) & (1 << 32) - 1
    return out


def as_text(registers, order=None):
    # Registers come in the order of their signed names.
    return "".join(f"{r:02x}{registers[r]:08x}" for r in sorted(registers, key=lambda r: r - 64 if r >= 32 else r))


def alike(a, b):
    return len(a.items() & b.items()) / len(a.keys() | b.keys()) if a or b else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, xx(r[1])))
    out = []
    for j, (i, t) in enumerate(rows):
        after = rows[(j + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, b = brute(t), brute(edited), brute(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(e), round(alike(a, e), 9), round(alike(a, b), 9)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeéß漢𝔘"), rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(rng.integers(1, 400))) for _ in range(30)]
    texts += [None, "", "  \n ", "one", "one two", "x", "a a a a a a a a a", "a b " * 300, texts[3], texts[3] + " end", "z" * 5000, texts[1] * 30, None, ""]
    ids = [*range(100, 100 + len(texts) - 6), 100, 100, None, None, -7, 101]
    table = docs(texts, ids)
    got = fingerprint_edits(table).collect()
    assert sorted([(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=repr) == expected(list(zip(ids, texts, strict=True)))
    assert fingerprint_edits(table.where("false")).count() == 0
    (single,) = fingerprint_edits(table.where("doc_id = 103")).collect()
    assert single.near_next == 1.0


def test_many_equal_rows_and_few_bounds(spark):
    """A third of the rows are equal; however rows are dealt, each has its next one."""
    rows = [(7, "same text here")] * 300 + [(i, f"text {i * i % 97} of {i}") for i in range(600)]
    table = spark.createDataFrame([(n, i, xx(t), t) for n, (i, t) in enumerate(rows)], "row bigint, doc_id bigint, hash bigint, text string").repartition(5)
    order = sorted(((i, xx(t), n, t) for n, (i, t) in enumerate(rows)))
    want = sorted((order[j][2], order[(j + 1) % len(order)][3]) for j in range(len(order)))
    for sizes in ({}, {"most_ranges": 3}, {"sampled": 40}):
        got = with_next(table, ["text"], size=1000, **sizes)
        assert sorted((r.row, r.next_text) for r in got.collect()) == want


def test_order_counts(spark):
    """A text whose halves change places keeps its bag of k-mers, not its fingerprint."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 1000)]
    variants = [words, words[500:] + words[:500], words[:990] + ["new"] * 10, [f"o{x}" for x in range(1000)]]
    table = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(variants)], "i int, text string").withColumn("f", fingerprint(F.col("text")))
    base = table.where("i = 0").select(F.col("f").alias("g"))
    near = {r.i: r.n for r in table.crossJoin(base).select("i", likeness(F.col("f"), F.col("g")).alias("n")).collect()}
    assert near[0] == 1 and near[2] > 0.9 and near[1] < 0.75 and near[3] == 0
    bag = table.withColumn("f", fingerprint(F.col("text"), least=1)).crossJoin(table.where("i = 0").select(fingerprint(F.col("text"), least=1).alias("g")))
    assert {r.i: r.n for r in bag.select("i", likeness(F.col("f"), F.col("g")).alias("n")).collect()}[1] > 0.9


def test_no_python_on_the_main_path(spark, sf001):
    df = fingerprint_edits(spark.read.parquet(f"{sf001}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "udf" not in open(order_minhash.__file__).read()
