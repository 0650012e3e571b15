"""The inverted file of vectors against exact search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval as R
from marlstone.operators.vector_index import build_index, fit_centres, search_index

SCHEMA = "vec_id bigint, embedding array<float>, list int, score double"


def exact(rows, asked, k):
    unit = lambda v: np.asarray(v, np.float32).astype(np.float64) / max(np.linalg.norm(np.asarray(v, np.float32).astype(np.float64)), 1e-300)
    kept = [(i, unit(v)) for i, v in rows if i is not None and v]
    out = {}
    for q, v in asked:
        s = sorted((-round(float(unit(v) @ u), 9), i) for i, u in kept)
        out[q] = [i for n, i in s if n <= 0][:k]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(25)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in rng.choice(middles)]) for i in range(3000)]
    # A third is one vector; nulls and empty ones are no rows of the index.
    rows += [(10_000 + i, rows[0][1]) for i in range(1500)] + [(20_000, None), (20_001, []), (None, rows[1][1])]
    return rows, spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], SCHEMA).repartition(4)


def test_exact_search_in_blocks(spark, table):
    rows, df = table
    asked = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    want = exact(rows, [(i, v) for i, v in rows if i is not None and i % 100 == 0 and v], 7)
    for sizes in ({}, {"block_rows": 300, "question_rows": 9}):
        got = {}
        for r in R.vector_top_k(df.where("size(embedding) > 0 and vec_id is not null"), asked.where("size(embedding) > 0"), 7, **sizes).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.vec_id)
        assert got == want


def test_recall_and_rows(spark, table, tmp_path):
    rows, df = table
    path = str(tmp_path / "index")
    build_index(df, path, lists=40, block_rows=200)
    assert spark.read.parquet(f"{path}/vectors").count() == 4500
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding").where("size(embedding) > 0")
    want = exact(rows, [(i, v) for i, v in rows if i is not None and i % 50 == 0 and v], 20)
    got = {}
    for r in search_index(spark, path, asked, 20, question_rows=11).orderBy("qid", "rank").collect():
        assert r.score >= 0 and r.rank == len(got.setdefault(r.qid, [])) + 1
        got[r.qid].append(r.vec_id)
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    # All lists: exact.
    every = {}
    for r in search_index(spark, path, asked, 20, probes=40).orderBy("qid", "rank").collect():
        every.setdefault(r.qid, []).append(r.vec_id)
    assert every == want
    # Grouped vectors need few lists, and only those are read.
    probes = spark.read.parquet(f"{path}/probes").first()["probes"]
    assert probes < 20
    one = search_index(spark, path, asked.limit(1), 5, probes=1)
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ (= \d+|IN )", one._jdf.queryExecution().executedPlan().toString())


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    build_index(none, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, embedding array<float>")
    assert search_index(spark, str(tmp_path / "none"), asked, 3).count() == 0
    build_index(spark.createDataFrame([(1, [1.0, 0.0], 1, 0.0)], SCHEMA), str(tmp_path / "one"))
    assert [r.vec_id for r in search_index(spark, str(tmp_path / "one"), asked, 3).collect()] == [1]
    assert search_index(spark, str(tmp_path / "one"), asked.where("false"), 3).count() == 0


def test_recall_of_the_query(spark):
    from marlstone import registry

    sf = "/root/testdata/sf0.01"
    ranked = lambda name: {(r.qid, r.vec_id) for r in registry.queries()[name](spark, sf).where("rank <= 20").collect()}
    want = ranked("f2_vector_top_k")
    assert len(want & ranked("f2_ann_top_k")) >= 0.9 * len(want)


def test_centres_have_length_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = fit_centres(x, 12)
    assert centres.shape == (12, 8) and np.allclose(np.linalg.norm(centres, axis=1), 1)


def test_routed_questions_come_in_bounded_batches():
    """a batch of questions that each probe half of the lists is not repeated for all of them at once."""
    import numpy as np
    import pandas as pd

    from marlstone.operators import vector_index

    rng = np.random.default_rng(3)
    centres, asked = rng.normal(size=(2_500, 4)), rng.normal(size=(40, 4))
    frames = list(vector_index.routed_rows(pd.DataFrame({"qid": range(40), "embedding": list(asked)}), centres, 2_000))
    assert max(map(len, frames)) <= vector_index.ROUTED_ROWS and sum(map(len, frames)) == 40 * 2_000
    score = asked / np.linalg.norm(asked, axis=1, keepdims=True) @ centres.T
    got = pd.concat(frames).groupby("qid")["list"].agg(set)
    assert all(got[q] == set(np.argsort(-score[q])[:2_000]) for q in range(40))
    many = pd.Series(list(rng.normal(size=(2_100, 4))))
    assert (vector_index.nearest_list(many, centres) == (np.stack(many) @ centres.T).argmax(axis=1)).all()


def test_a_question_goes_once_to_lists_that_share_a_block():
    """40 questions that probe 30 of 50 lists make a row a group, not one a list; lists without vectors are left out."""
    import pandas as pd

    from marlstone.operators import vector_index

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 4))
    groups = vector_index.list_groups({i: 1_000 if i != 7 else 9_000 for i in range(49)}, 50)
    held = [sum(1_000 if i != 7 else 9_000 for i in range(49) if groups[i] == g) for g in range(groups.max() + 1)]
    assert groups[49] == -1 and (groups == groups[7]).sum() == 1 and max(held) == 9_000 and len(held) == 14
    (routed,) = vector_index.routed_rows(pd.DataFrame({"qid": range(40), "embedding": list(rng.normal(size=(40, 4)))}), centres, 30)
    sent = vector_index.grouped_rows(routed, 30, groups)
    assert not sent.duplicated(["qid", "group"]).any() and len(sent) <= 40 * 14
    want = {(q, i) for q, i in zip(routed["qid"], routed["list"]) if i != 49}
    assert {(q, i) for q, own in zip(sent["qid"], sent["lists"]) for i in own} == want
    assert all(groups[i] == g for g, own in zip(sent["group"], sent["lists"]) for i in own)


def test_an_index_has_a_file_a_list_unless_it_is_large(spark, table, tmp_path):
    """40 lists of about 40 rows had 23 files each with blocks of 200 rows; only the third of all rows that is one vector needs several."""
    _, df = table
    build_index(df, str(tmp_path / "index"), lists=40, block_rows=200)
    files = [str(p.parent.name) for p in (tmp_path / "index" / "vectors").glob("*/*.parquet")]
    assert len(files) < 120


def test_fitting_holds_few_scores_at_once():
    """F2: lists and probes are fitted on the driver without scores of all sampled vectors at once."""
    import tracemalloc

    from marlstone.operators import vector_index

    rng = np.random.default_rng(6)
    sample = rng.normal(size=(20_000, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    tracemalloc.start()
    centres = fit_centres(sample, 400, rounds=1)
    probes = vector_index.fit_probes(sample, centres, recall=0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and 1 < probes < 400
