import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm.packing import best_two_fit, grouped, pack, packed_pieces, token_pieces, tokenizer_path
from marlstone.llm.token_output import best_fit_decreasing, matrix, packed_sequences


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=2, max_size=40))
def test_plan_uses_every_piece_once(counts):
    counts = np.array([0, *counts])
    used = np.zeros_like(counts)
    for pattern, times in best_two_fit(counts):
        assert times > 0 and sum(n * k for n, k in pattern) <= len(counts) - 1
        for n, k in pattern:
            used[n] += k * times
    assert (used == counts).all()


def test_two_replace_one():
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = [1, 1, 2]  # 6 + 3 leaves 1; 6 + 2 + 2 fills the bin
    assert best_two_fit(counts)[0][0] == [(6, 1), (2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing(lengths):
    bins = best_fit_decreasing(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    free, number = [], 0  # plain version: least room that suffices
    for n in sorted(lengths, reverse=True):
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(50 - n)
            number += 1
        else:
            free[free.index(fit)] = fit - n
    assert len(bins) == number


TEXTS = [None, "", "Hello world", "it's 12 O'Clock", "ÉTÉ straße ² ﬁ e\u0301 Σίσυφος", "a <|endoftext|> b\tc\u00a0d\r\ne", "word " * 5000, "x" * 9000, "same", "same", "日本語 テキスト %%% $$$"]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_are_the_tokenizers_ids(docs, tokenizer):
    pieces = defaultdict(list)
    for r in token_pieces(docs(TEXTS), tokenizer_path(), keep_ids=True).collect():
        pieces[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        own, ids = sorted(pieces[i], key=lambda r: r.piece), ids_of(tokenizer, t)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == ids
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)


def test_places_are_gapless(docs):
    rows = packed_pieces(docs(TEXTS * 3), tokenizer_path(), size=512).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    total = sum(r.length for r in rows)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(by) <= -(-total // 512) + 1
    assert packed_pieces(docs([]), tokenizer_path()).count() == 0


def test_matrices_give_the_ids_back(docs, tokenizer):
    found = defaultdict(dict)
    for r in packed_sequences(docs(TEXTS), tokenizer_path(), size=256, pad_id=7).collect():
        ids, positions = matrix([r.ids], 256)[0], matrix([r.positions], 256)[0]
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 7).all() and not positions[r.n_tokens :].any()
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found[d][p] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for i, t in enumerate(TEXTS):
        assert [x for p in sorted(found[i]) for x in found[i][p]] == ids_of(tokenizer, t)
    assert packed_sequences(docs([]), tokenizer_path()).count() == 0


def test_equal_rows_and_clashing_columns(spark):
    """Any number of equal rows is dealt over all groups; columns of any name stay, but for the two results."""
    names = "doc_id, length, rank, row, own, group, n, before, sequence_id, offset".split(", ")
    rows = [(7, 5, *"abcdef", -1, -2)] * 20_000 + [(i, 1 + i % 16, *"ghijkl", None, None) for i in range(500)]
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` {'bigint' if n in ('doc_id', 'length', 'sequence_id', 'offset') else 'string'}" for n in names)).repartition(3)
    got = pack(table, size=16, rows_a_group=1000)
    assert got.columns == names
    places = [(r.sequence_id, r.offset, r.length) for r in got.collect()]
    assert len(places) == len(rows) and len({p[:2] for p in places}) == len(places)
    at = defaultdict(int)
    for s, o, n in sorted(places):
        assert o == at[s]
        at[s] += n
        assert at[s] <= 16
    assert sorted(r[2:8] for r in got.collect()) == sorted(r[2:8] for r in rows)
    from pyspark.sql import functions as F

    largest = grouped(table.select("length", F.monotonically_increasing_id().alias("row")), 20).where("length = 5").groupBy("group").count().agg(F.max("count")).first()[0]
    assert largest < 2 * 20_000 / 20
