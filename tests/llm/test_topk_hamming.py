import random

import numpy as np

from marlstone.llm.topk_hamming import Index, sign_codes, top_k


def expected(rows, k):
    bits = [(i, [x is not None and x > 0 for x in v]) for i, v in rows if i is not None and v]
    out = []
    for q, a in bits:
        if q % 20 == 0:
            near = sorted((sum(x != y for x, y in zip(a, b, strict=True)), i) for i, b in bits if i != q and len(a) == len(b))
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def test_random_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(400, None), (401, []), (None, rows[1][1]), (420, [None, 1.0]), (421, [1.0, None])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id bigint, embedding array<float>, distance int")
    codes = sign_codes(table)
    got = top_k(codes, codes.where("id % 20 = 0"), k=5, index_rows=70, query_rows=6)
    assert sorted((r.query_id, r.rank, r.id, r.distance) for r in got.collect()) == expected(rows, 5)
    assert top_k(codes.where("false"), codes.where("false")).count() == 0


def test_radius_is_proven():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 8), np.uint8)
    index, key = Index(codes), np.arange(500)
    for q in rng.integers(0, 256, (20, 8), np.uint8):
        d = np.bitwise_count(codes ^ q).sum(axis=1)
        best, dist = index.search(q, key, 7)
        assert best.tolist() == np.lexsort((key, d))[:7].tolist() and dist.tolist() == np.sort(d)[:7].tolist()


def test_repeated_ids_hide_no_neighbour(spark):
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(16)]
    hot, near = vector(), [vector() for _ in range(6)]
    # 20: often with one code; 40: with many codes; 60: both.
    rows = [(20, hot)] * 30 + [(i, hot) for i in (3, 5, 5, 5, 90)] + [(40, v) for v in near] * 2 + [(40, vector()) for _ in range(40)]
    rows += [(60, hot)] * 9 + [(60, vector()) for _ in range(20)] + [(i, vector()) for i in range(100, 140)] + [(7, near[0]), (8, near[0])] * 4
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    codes = sign_codes(table)
    for sizes in ({}, {"index_rows": 50, "query_rows": 20}):
        got = top_k(codes, codes.where("id % 20 = 0"), k=5, **sizes)
        assert sorted((r.query_id, r.rank, r.id, r.distance) for r in got.collect()) == expected(rows, 5)
