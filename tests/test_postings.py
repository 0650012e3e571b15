"""The persisted postings index against scoring of all documents."""

import math
import random
import re

import pytest

from marlstone.operators import postings as P

WORD = re.compile(r"\w+")


def brute(docs, questions, n, k1=1.2, b=0.75):
    words = {i: WORD.findall((t or "").lower()) for i, t in docs}
    average = sum(map(len, words.values())) / max(1, len(words))
    out = {}
    for qid, text in questions:
        terms = set(WORD.findall(text.lower()))
        df = {t: sum(t in w for w in words.values()) for t in terms}
        score = {}
        for i, w in words.items():
            for t in terms:
                if tf := w.count(t):
                    idf = math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                    score[i] = score.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / average))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:n]
        if best:
            out[qid] = [(i, round(s, 8)) for i, s in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        assert r.rank == len(out.setdefault(r.qid, [])) + 1
        out[r.qid].append((r.doc_id, round(r.score, 8)))
    return out


QUESTIONS = [(1, "common rare7"), (2, "common"), (3, "rare3 rare4 rare5 Rare3"), (4, "nowhere"), (5, ""), (6, "same text")]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    out = [(i, " ".join(rng.choices(["Common", "a", "b", "c", f"rare{i % 40}"], k=rng.choice([3, 10, 60, 300])))) for i in range(400)]
    return out + [(1000 + i, "same text") for i in range(60)] + [(2000, None), (2001, ""), (2002, "common " * 500), (2003, "...")]


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, term string, tf int").repartition(3)


def test_segments_and_merge(spark, docs, table, tmp_path):
    path, asked = str(tmp_path / "index"), spark.createDataFrame(QUESTIONS, "qid int, text string")
    for which in ("doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2"):
        P.add_segment(table.where(which), path, range_rows=20)
    want = brute(docs, QUESTIONS, 10)
    assert found(P.search(spark, path, asked, 10)) == want
    assert found(P.search(spark, path, asked, 10, first_ranges=1)) == want
    totals = {r.term: (r.df, r.cf) for r in P.term_totals(spark, path).collect()}
    P.merge_segments(spark, path, range_rows=20)
    assert P.segments(spark, path).count() == 1
    assert found(P.search(spark, path, asked, 10)) == want
    assert {r.term: (r.df, r.cf) for r in P.term_totals(spark, path).collect()} == totals
    assert totals["same"] == (60, 60) and totals["common"][1] == sum(WORD.findall((t or "").lower()).count("common") for _, t in docs)


def test_only_the_terms_buckets_of_live_segments_are_read(spark, table, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "index")
    first = P.add_segment(table.where("doc_id < 1000"), path)
    second = P.add_segment(table.where("doc_id >= 1000"), path)
    asked = spark.createDataFrame([("same",), ("rare7",)], "term string")
    buckets = {r.b for r in asked.select(P.bucket_of(asked.term).alias("b")).collect()}
    plan = lambda: P.blocks_of(spark, path, asked)._jdf.queryExecution().executedPlan().toString()
    # What the scan may open: these partitions only.
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan())[1]
    assert len(buckets) == 2 and {int(x) for x in re.search(r"bucket#\d+ IN \(([\d, ]+)\)", filters)[1].split(",")} == buckets
    assert first in filters and second in filters
    merged = P.merge_segments(spark, path)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan())[1]
    assert merged in filters and first not in filters and second not in filters
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_bounds_skip_ranges(spark, table, tmp_path, monkeypatch):
    path, asked, kept = str(tmp_path / "index"), spark.createDataFrame([(1, "rare7 common")], "qid int, text string"), []
    P.add_segment(table, path, range_rows=10)
    original = P.reaching

    def counted(ranges, threshold):
        out = original(ranges, threshold)
        kept.append((ranges.count(), out.count()))
        return out

    monkeypatch.setattr(P, "reaching", counted)
    P.search(spark, path, asked, 3).collect()
    ((every, read),) = kept
    assert 0 <= read < every / 2


def test_no_documents(spark, table, tmp_path):
    path = str(tmp_path / "none")
    P.add_segment(table.where("false"), path)
    asked = spark.createDataFrame(QUESTIONS, "qid int, text string")
    assert P.search(spark, path, asked).count() == 0 and P.term_totals(spark, path).count() == 0
    P.add_segment(table.where("doc_id > 1999"), path)
    assert found(P.search(spark, path, asked)) == brute([(2000, None), (2001, ""), (2002, "common " * 500), (2003, "...")], QUESTIONS, 20)
    assert P.search(spark, path, asked.where("false")).count() == 0
