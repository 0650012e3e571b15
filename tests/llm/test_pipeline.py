import zlib

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm.packing import tokenizer_path

from .test_decontaminate import expected as hits
from .test_near_dedup import bags, overlap
from .test_substring_dedup import WORD


def brute(rows, toxic, items):
    rows = [r for r in sorted(rows) if r[0] not in toxic]
    found, kept = bags([t.encode() for _, t in rows], 5), []
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(found[i][0]) and overlap(found[i], found[j]) >= 0.8:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    rows = [r for n, r in enumerate(rows) if parent[n] == n]
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        if any(gone):
            t = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        if not w or not all(gone):
            out.append((i, t))
    return [(i, t) for i, t in out if not hits(t, items)[1]]


def test_stages_against_brute_force(spark, sf001):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    after = corpus_pipeline.toxicity(spark, docs, sf001)
    assert after.columns == docs.columns
    toxic = {r.doc_id for r in docs.select("doc_id").exceptAll(after.select("doc_id")).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    kept = brute([(r.doc_id, r.text) for r in docs.collect()], toxic, items)
    got = corpus_pipeline.run(spark, sf001).collect()
    assert sorted({r.doc_id for r in got}) == sorted(i for i, _ in kept)
    whole = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in kept}
    for r in got:
        own = whole[r.doc_id][2048 * r.piece : 2048 * (r.piece + 1)]
        assert (r.start, r.length, r.ids_crc32) == (2048 * r.piece, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))


def test_stage_columns_and_empty_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf001)
        assert out.columns == docs.columns and out.count() == 0


def test_repeated_and_null_ids_are_rows_of_their_own(spark, sf001, docs, monkeypatch):
    from marlstone.llm import toxicity

    monkeypatch.setattr(toxicity, "train", lambda *a, **k: (b"", b"", [0.1] * 5 + [0.9] * 5))
    monkeypatch.setattr(toxicity, "measured", lambda texts, *a: [9 * (b"toxic" in (t or b"")) for t in texts])
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    texts = [None, "", text(1), text(2), text(3), text(4), text(4) + " tail", text(5), text(5), text(6) + " toxic"]
    ids = [None, 7, None, None, 7, 7, None, 8, 8, 7]
    item = spark.read.parquet(f"{sf001}/benchmark.parquet").orderBy("item_id").first().text
    table = docs([*texts, item], [*ids, 7])
    have = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    every = sorted((i or -1, t or "") for i, t in zip([*ids, 7], [*texts, item], strict=True))
    after = corpus_pipeline.toxicity(spark, table, sf001)
    assert have(after) == [r for r in every if "toxic" not in r[1]]
    after = corpus_pipeline.near_dedup(spark, after, sf001).localCheckpoint()
    want = [(-1, ""), (-1, text(1)), (-1, text(2)), (7, ""), (7, text(3)), (7, text(4)), (8, text(5)), (7, item)]
    assert have(after) == sorted(want)
    after = corpus_pipeline.substrings(spark, after, sf001)
    assert after.columns == table.columns and have(after) == sorted(want)
    assert have(corpus_pipeline.decontamination(spark, after, sf001)) == sorted(want[:-1])
