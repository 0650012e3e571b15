"""URL filter: host and path rules, then the likelihood ratio of two character models.

Both models are variable-order Markov models of bytes: the chance of a byte
after its k predecessors is mixed with the chance after k - 1 of them, down to
a uniform one, by Bayesian smoothing. A chance depends on a byte and its ORDER
predecessors only, so the models are a distributed table of such grams, which
are their own keys: no two contexts share a count, and the table grows with
the urls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import checkpointed, parts_for

#: Longest context; a gram has one byte more and is a bigint.
ORDER = 5
#: How many observations the shorter context's chance weighs.
PRIOR = 4.0

#: The rules that the query applies (fixed values).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, lower), F.regexp_extract(url, pattern, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path) that fits, as a struct of rule and verdict, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        out = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts (an end mark included) its gram, and its text."""
    raw = np.frombuffer(b"".join(b"\x02" * ORDER + t + b"\x03" for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes + ORDER) - sizes
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        gram = gram << 8 | raw[at - k]
    return gram, np.repeat(np.arange(len(texts)), sizes)


COUNTED = "chunk int, gram bigint, allowed bigint, blocked bigint"


def _counted(table: pa.Table) -> pa.Table:
    gram, owner = _grams(table.column("string").to_pylist())
    keys, which = np.unique(gram, return_inverse=True)
    columns = [np.full(len(keys), table.column("chunk")[0].as_py(), np.int32), keys]
    for kind in ("allowed", "blocked"):
        columns.append(np.bincount(which, table.column(kind).to_numpy()[owner], len(keys)).astype(np.int64))
    return pa.table(columns, names=["chunk", "gram", "allowed", "blocked"])


def _scored(key, left: pa.Table, right: pa.Table) -> pa.Table:
    texts = left.column("string").to_pylist()
    if not texts:
        return left.select(["string", "own", "n", "held"]).append_column("score", pa.array([], pa.float64()))
    gram, owner = _grams(texts)
    keys, ratio = right.column("gram").to_numpy(), right.column("ratio").to_numpy()
    order = np.argsort(keys)
    found = ratio[order][np.searchsorted(keys[order], gram)]
    score = np.bincount(owner, found, len(texts)) / np.bincount(owner, minlength=len(texts))
    return left.select(["string", "own", "n", "held"]).append_column("score", pa.array(score))


def ratios(grams: DataFrame) -> DataFrame:
    """Log-likelihood ratio of each gram's last byte after the others: gram, ratio.

    ``grams`` has gram (distinct) and its counts, allowed and blocked. Counts of
    shorter contexts are sums over the grams that end alike.
    """
    kinds = ("allowed", "blocked")
    lower = None
    for k in range(ORDER + 1):
        own = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(*[F.sum(c).alias(c) for c in kinds])
        own = own.withColumn("context", F.shiftright("gram", 8)).withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)))
        whole = own.groupBy("context").agg(*[F.sum(c).alias(f"all_{c}") for c in kinds])
        # At most 256 contexts of one byte and 65,536 pairs of bytes.
        own = own.join(F.broadcast(whole) if k < 2 else whole, "context")
        if lower is None:
            own = own.select("*", *[F.lit(1 / 256).alias(f"low_{c}") for c in kinds])
        else:
            own = own.join(F.broadcast(lower) if k < 3 else lower, "shorter")
        chance = {c: (F.col(c) + PRIOR * F.col(f"low_{c}")) / (F.col(f"all_{c}") + PRIOR) for c in kinds}
        last = own.select("gram", *[chance[c].alias(f"low_{c}") for c in kinds])
        lower = last.withColumnRenamed("gram", "shorter")
    return last.select("gram", (F.log("low_allowed") - F.log("low_blocked")).alias("ratio"))


def filter_urls(pages: DataFrame, *, rules=RULES, bins: int = 4000, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Verdict on every url: its longest fitting rule's, else that of the models.

    ``pages`` has page_id and url; other columns are ignored. Urls that a rule
    decides are the models' accepted and rejected examples: four fifths of them
    (by a hash of host and path) are all counted, the rest calibrate the
    threshold, which makes the two error rates most alike, in ``bins`` steps of
    score from -10 to 10. The score is the log-likelihood of host and path under
    the accepted model less that under the rejected one, per byte.

    Different strings of host and path are dealt by hash into chunks of about
    ``chunk_bytes``. Only a chunk's different grams travel: their counts to the
    models' table, and their ratios back to the chunk. Nothing that grows with
    the urls is gathered on the driver or broadcast.

    Null and urls without `://` have an empty host and path, no rule, and are
    blocked. With examples of one kind only, all that no rule decides are
    treated as that kind; with none, they are allowed. Repeated rows each give a
    row. Returns page_id, host, path, rule, verdict, score.
    """
    host, path = parts_of(F.col("url"))
    told = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("match", matched_rule(F.col("host"), F.col("path"), rules))
    told = told.select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("own"),
        F.concat("host", "path").cast("binary").alias("string"),
    )
    # A string has one host and one path, so all its rows are decided alike.
    strings = told.groupBy("string").agg(F.first("own").alias("own"), F.count("*").alias("n"))
    strings = strings.withColumn("held", F.pmod(F.xxhash64("string"), F.lit(5)) == 0)
    size = strings.select(F.sum(F.length("string") + 1)).first()[0] or 0
    parts = parts_for(size, chunk_bytes)
    counts = [F.when(~F.col("held") & (F.col("own") == v), F.col("n")).otherwise(0).alias(c) for c, v in (("allowed", "allow"), ("blocked", "block"))]
    strings = checkpointed(strings.select("*", *counts, F.pmod(F.xxhash64("string", F.lit(1)), F.lit(parts)).cast("int").alias("chunk")))
    counted = checkpointed(strings.groupBy("chunk").applyInArrow(_counted, COUNTED))
    grams = checkpointed(counted.groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    told_back = counted.select("chunk", "gram").join(ratios(grams), "gram")
    scored = checkpointed(
        strings.groupBy("chunk").cogroup(told_back.groupBy("chunk")).applyInArrow(_scored, "string binary, own string, n bigint, held boolean, score double")
    )
    step = F.floor((F.least(F.greatest("score", F.lit(-10.0)), F.lit(10.0)) + 10) * (bins / 20)).cast("int").alias("bin")
    held = scored.where("held and own is not null").select((F.col("own") == "block").alias("blocked"), step, "n")
    spread = held.groupBy("blocked", "bin").agg(F.sum("n").alias("n")).toArrow()
    threshold = calibrated(spread.column("blocked").to_numpy(False), spread.column("bin").to_numpy(), spread.column("n").to_numpy(), bins)
    judged = F.when(F.col("host") == "", "block").when(F.col("score") >= threshold, "allow").otherwise("block")
    out = told.join(scored.select("string", "score"), "string")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", judged).alias("verdict"), "score")


def calibrated(blocked: np.ndarray, step: np.ndarray, n: np.ndarray, bins: int) -> float:
    """Score from which urls are allowed: where as large a share of either kind is on the wrong side."""
    by_kind = [np.bincount(step[blocked == k], n[blocked == k], bins + 1) for k in (False, True)]
    if not by_kind[0].sum() or not by_kind[1].sum():
        return float("inf") if by_kind[1].sum() else float("-inf")
    allowed_below = np.r_[0, np.cumsum(by_kind[0])] / by_kind[0].sum()
    blocked_above = 1 - np.r_[0, np.cumsum(by_kind[1])] / by_kind[1].sum()
    wrong = np.maximum(allowed_below, blocked_above)
    best = np.flatnonzero(wrong == wrong.min())
    return float(best.mean()) * 20 / bins - 10
